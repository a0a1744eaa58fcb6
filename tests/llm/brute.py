"""Plain versions of the operators' results and a table of awkward documents."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, component_id long, row long, `key` string, bucket long, spans string, text2 string"


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


STORY = " ".join(f"w{i % 37}x{i % 11}" for i in range(120))

#: Null, empty and blank texts, a null id, repeated rows, ties, a long text, text beyond ASCII, a word longer than a piece.
ODD = [
    (1, STORY + ".", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "de"),
    (5, "One two", "en"),
    (5, "One two", "en"),
    (6, "one two", "en"),
    (None, STORY + ".", "en"),
    (7, "Ünïcode ñandú 😀 中文 " * 5, "es"),
    (8, "z" * 70_000, "xx"),
    (9, STORY + " end.", "en"),
    (10, (STORY + " and on\n") * 300, "en"),
    (11, STORY.replace("w3x3", "other"), "en"),
    (12, "!!! ??? 123", "en"),
    (-13, STORY + ".", "fr"),
]


def frame(spark, rows):
    full = [(i, t, g, "s", len(t or ""), 1, 0.5, -1, -2, "k", 7, "[]", None) for i, t, g in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd(spark):
    return frame(spark, ODD).repartition(3)


def nothing(spark):
    return frame(spark, [])
