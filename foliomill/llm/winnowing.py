"""Document fingerprints by winnowing, in DataFrame expressions only.

Every run of ``k`` characters is hashed; in each window of ``w`` consecutive
hashes the least one is kept, the rightmost of equal ones, with its position.
Two texts that share a passage of ``w + k - 1`` characters share a fingerprint.

A text is cut into overlapping segments, each with all characters its windows
need, so that a long text is worked on in bounded arrays.  The minimum of ``w``
(a power of two) neighbours takes log2(w) passes over an array, each joining
minima of twice the width.  Hash and position travel in one number: the hash in
the upper bits, and below it the distance to the segment's end, so that the
least number is the rightmost of equal hashes.

Defined results: a null text is empty and has no fingerprints; a text shorter
than ``k`` has one, of itself; one with fewer than ``w`` hashes is one window.
Two texts without fingerprints are alike (1), one without is unlike any other (0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

K, W = 12, 16
SEGMENT = 2048
#: Documents in a range of doc_ids, and the most ranges there are (beyond it they hold more documents).
ROWS_PER_BLOCK, BLOCKS = 2000, 20_000
_LOCAL = 12  # bits of a place inside a segment
_PLACE = 1 << 32


def _minima(numbers: Column, w: int) -> Column:
    """Minimum of each number and its w - 1 followers (fewer at the end)."""
    width = 1
    while width < w:
        step = width
        numbers = let(numbers, lambda v, step=step: F.zip_with(v, F.slice(v, F.lit(step + 1), F.size(v)), lambda a, b: F.least(a, b)))
        width *= 2
    return numbers


def _numbers(segment: Column, k: int) -> Column:
    """Hash and reversed place of each run of k characters."""
    low = (1 << _LOCAL) - 1
    runs = F.regexp_extract_all(segment, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    return F.transform(runs, lambda run, i: F.xxhash64(run).bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(low) - i))


def _placed(numbers: Column, base: Column) -> Column:
    """place * 2^32 + upper 32 bits of the hash."""
    low = (1 << _LOCAL) - 1
    return F.transform(
        F.array_distinct(numbers),
        lambda v: (base + F.lit(low) - v.bitwiseAND(F.lit(low))) * F.lit(_PLACE) + F.shiftrightunsigned(v, 32),
    )


def fingerprints(text: Column, k: int = K, w: int = W) -> Column:
    """Kept hashes in order of place, each as place * 2^32 + hash."""
    reach = SEGMENT + w + k - 2
    segments = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{reach}}})).{{1,{SEGMENT}}}"), F.lit(1))

    def windows(segment: Column, j: Column) -> Column:
        return let(_minima(_numbers(segment, k), w), lambda m: _placed(F.slice(m, F.lit(1), F.greatest(F.lit(0), F.size(m) - (w - 1))), j.cast("bigint") * SEGMENT))

    n = F.length(text)
    one = F.array(F.array_min(_numbers(text, k)))
    return (
        F.when(n >= w + k - 1, F.array_distinct(F.flatten(F.transform(segments, windows))))
        .when(n >= k, _placed(one, F.lit(0).cast("bigint")))
        .when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(text), 32)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints, places left aside."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda v: v % F.lit(_PLACE)))
    return let(
        F.array(hashes(a), hashes(b)),
        lambda x: let(
            F.size(F.array_intersect(x[0], x[1])),
            lambda both: F.when(F.size(x[0]) + F.size(x[1]) == 0, F.lit(1.0)).otherwise(both / (F.size(x[0]) + F.size(x[1]) - both)),
        ),
    )


def _blocks(docs: DataFrame, rows: int) -> DataFrame:
    """Documents with their range of doc_ids (``block``), and again as ``guest`` in the range above if they are the last of theirs.

    The ranges are quantiles of doc_id: one array of numbers, as long as there
    are ranges, is all that passes through the driver.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    keys = docs.select(key.alias("key"))
    want = min(BLOCKS, max(1, math.ceil(keys.count() / rows)))
    cuts = keys.agg(F.percentile_approx("key", [i / want for i in range(1, want)], max(10_000, 10 * want))).first()[0] if want > 1 else []
    cuts = sorted(set(cuts or []))
    docs = docs.withColumn("key", key)
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    found = {r.block: r.top for r in keys.select("key", block.alias("block")).groupBy("block").agg(F.max("key").alias("top")).collect()}
    order = sorted(found)
    host = {found[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    home = F.struct(block.alias("block"), F.lit(False).alias("guest"))
    if not host:
        return docs.select("key", "doc_id", "text", F.lit(0).alias("block"), F.lit(False).alias("guest"))
    hosts = F.create_map(*[F.lit(int(x)) for pair in host.items() for x in pair])
    visit = F.array(home, F.struct(hosts[F.col("key")].cast("int").alias("block"), F.lit(True).alias("guest")))
    places = F.when(F.col("key").isin(list(host)), visit).otherwise(F.array(home))
    return docs.select("key", "doc_id", "text", F.explode(places).alias("_at")).select("key", "doc_id", "text", "_at.block", "_at.guest")


def edited_documents(docs: DataFrame, k: int = K, w: int = W, rows: int = ROWS_PER_BLOCK) -> DataFrame:
    """Each document's text, edited text and both fingerprints, with its likeness to the edited and to the next text.

    The next document follows in descending doc_id; the first follows the last.
    The edited text has its last third replaced by the start of the next one.
    Documents are dealt by ranges of doc_id, so that the next one is in the same
    window or is the range's guest; rows that repeat a doc_id follow each other in the
    order of their texts, null doc_ids come last.
    """
    from pyspark.sql import Window

    placed = _blocks(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rows).repartition("block")
    made = placed.withColumn("kept", fingerprints(F.col("text"), k, w))
    after = Window.partitionBy("block").orderBy("guest", F.desc("key"), "text")
    seen = made.withColumn("next_text", F.lead("text").over(after)).withColumn("next_kept", F.lead("kept").over(after)).where("not guest")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    seen = seen.select("doc_id", "text", "kept", "next_kept", n.alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"))
    # Windows that lie before the edit are those of the text itself; only the rest is worked on again.
    last = F.col("n_chars") - F.floor(F.col("n_chars") / 3).cast("int") - (w + k - 1)
    start = F.greatest(F.lit(0), last - w + 2)
    before = F.filter("kept", lambda v: F.shiftright(v, 32) <= last)
    tail = F.transform(fingerprints(F.substring("edited", start + 1, F.length("edited")), k, w), lambda v: v + start.cast("bigint") * F.lit(_PLACE))
    return seen.withColumn("edited_kept", F.array_distinct(F.concat(before, tail))).select(
        "doc_id",
        "text",
        "edited",
        "n_chars",
        "kept",
        "edited_kept",
        let(F.struct("kept", "edited_kept"), lambda x: likeness(x["kept"], x["edited_kept"])).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
    )


def digest(kept: Column) -> Column:
    """One short string for a whole fingerprint."""
    return F.sha2(F.array_join(kept.cast("array<string>"), ","), 256)
