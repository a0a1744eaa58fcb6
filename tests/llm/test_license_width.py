from __future__ import annotations

import random
import time

import pytest
from brute import frame, plain_words

from foliomill.llm import patience_licenses as licenses

MIT = licenses.TEMPLATES["MIT"]


def found(spark, text):
    row = licenses.scan(frame(spark, [(1, text, "en")]), {"MIT": MIT}).collect()[0]
    return [(f["first"], f["end"], f["coverage"]) for f in row.finds]


@pytest.mark.parametrize("foreign", [10, 60, 400, 3000])
def test_a_license_spread_by_foreign_words(spark, foreign):
    parts = MIT.split()
    text = " ".join(["before", *parts[:40], *(f"x{i}" for i in range(foreign)), *parts[40:], "after"])
    n = len(plain_words(MIT))
    assert found(spark, text) == [(1, 1 + n + foreign, 1.0)]


def test_the_true_start_after_a_failed_window(spark):
    """A stray template word before a widened license; alignment at every start finds it."""
    n = len(plain_words(MIT))
    gap = [f"x{i}" for i in range(28)]
    parts = MIT.split()
    text = " ".join(["of", "y1", "y2", *parts[:40], *gap, *parts[40:]])
    words = plain_words(text)
    template = plain_words(MIT)
    assert max(len(licenses.align(words[i:], template)) for i in range(len(words))) == n
    assert found(spark, text) == [(3, 3 + n + len(gap), 1.0)]


def test_a_spread_license_between_two_close_ones(spark):
    parts = MIT.split()
    n = len(plain_words(MIT))
    spread = [*parts[:40], *(f"x{i}" for i in range(200)), *parts[40:]]
    assert found(spark, " ".join([*parts, *spread, *parts])) == [(0, n, 1.0), (n, 2 * n + 200, 1.0), (2 * n + 200, 3 * n + 200, 1.0)]


def test_common_is_the_longest_common_subsequence():
    assert licenses.common([1, 2, 9, 3, 1], [1, 2, 3]) == 3 and licenses.common([3, 2, 1], [1, 2, 3]) == 1 and licenses.common([], [1]) == 0


def plain_alignment(text, template):
    """Patience alignment by recursion, apart from the operator's: matched places on both sides."""
    out, a, b = [], 0, 0
    while a < min(len(text), len(template)) and text[a] == template[a]:
        out.append((a, a))
        a += 1
    while b < min(len(text), len(template)) - a and text[-1 - b] == template[-1 - b]:
        b += 1
    mid, goal = text[a : len(text) - b], template[a : len(template) - b]
    once = [w for w in mid if mid.count(w) == 1 and goal.count(w) == 1]
    best = [[] for _ in range(len(once) + 1)]
    for i, w in enumerate(once):
        before = max((best[j + 1] for j in range(i) if goal.index(once[j]) < goal.index(w)), key=len, default=[])
        best[i + 1] = [*before, w]
    anchors = max(best, key=len)
    if anchors:
        at, to = -1, -1
        for w in [*anchors, None]:
            i, j = (mid.index(w), goal.index(w)) if w is not None else (len(mid), len(goal))
            out += [(a + at + 1 + x, a + to + 1 + y) for x, y in plain_alignment(mid[at + 1 : i], goal[to + 1 : j])]
            out += [(a + i, a + j)] if w is not None else []
            at, to = i, j
    return out + [(len(text) - k, len(template) - k) for k in range(b, 0, -1)]


def test_alignment_against_a_plain_one():
    pick = random.Random(1)
    for _ in range(400):
        template = [pick.randrange(30) for _ in range(pick.randrange(1, 25))]
        text = [w for w in template if pick.random() < 0.8 for w in ([w] if pick.random() < 0.8 else [w, pick.randrange(100, 140)])]  # foreign words, so that anchors never cross
        got = licenses.align(text, template)
        assert all(text[i] == template[j] for i, j in got)
        assert len(got) == len(plain_alignment(text, template))


def test_edited_licenses_are_found(spark):
    """Of texts with one edited license the plain alignment of the whole text says which ones hold it."""
    pick = random.Random(2)
    parts = MIT.split()
    need = 0.9 * len(plain_words(MIT))
    rows = []
    for i in range(40):
        edited = [w for w in parts if pick.random() > pick.choice([0, 0.05, 0.2])]
        for _ in range(pick.randrange(4)):
            at = pick.randrange(len(edited))
            edited[at:at] = [f"f{pick.randrange(99)}" for _ in range(pick.randrange(6))]
        rows.append((i, " ".join([f"g{k}" for k in range(pick.randrange(50))] + edited + ["h1", "h2"]), "en"))
    got = {r.doc_id: len(r.finds) for r in licenses.scan(frame(spark, rows), {"MIT": MIT}).collect()}
    want = {i: int(len(plain_alignment(plain_words(t), plain_words(MIT))) >= need) for i, t, _ in rows}
    assert got == want and 5 < sum(want.values()) < 40


def test_scattered_words_are_no_find(spark):
    """The words of a short line far apart, and of a long text in small scraps, are no license."""
    line = licenses.TEMPLATES["MIT-line"]
    words = line.split()
    far = " ".join(" ".join([w, *(f"x{k}" for k in range(4000))]) for w in words)
    scraps = " ".join(" ".join([w, *(f"x{k}" for k in range(40))]) for w in MIT.split())
    rows = [(1, far, "en"), (2, scraps, "en"), (3, "x " * 500 + line, "en"), (4, " y ".join(words), "en")]
    got = {r.doc_id: [(f.license, f.end - f.first, f.density) for f in r.finds] for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1] == got[2] == []
    assert got[3] == [("MIT-line", 5, 1.0)] and got[4] == [("MIT-line", 9, 5 / 9)]


def test_long_legal_text_is_quick():
    """50,000 words, a third of them words of the template in random order."""
    pick = random.Random(3)
    template = list(range(len(plain_words(MIT))))
    for names in (template, [w % 40 for w in template]):
        text = [pick.choice(names) if pick.random() < 0.3 else -1 for _ in range(50_000)]
        began = time.process_time()
        assert licenses.finds(text, names, 79) == []
        assert time.process_time() - began < 3
