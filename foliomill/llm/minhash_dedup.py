"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds its distinct word shingles.  A sketch has ``BANDS * ROWS``
coordinates.  In round i every shingle is thrown into a hashed coordinate with
the value (i, hash); after as many rounds as there are coordinates, round
``size + j`` throws all shingles into coordinate j, so that each one fills.  A
document stops after the first round that leaves no coordinate empty, and each
coordinate keeps its least value.  Two sketches agree in a coordinate with the
probability of the sets' similarity, as with independent minima, but the work is
about ``n + size * log(size)`` per document.

Documents with equal sets are one class and go on as one.  Classes that agree in
all rows of a band share a bucket.  First each class is compared with the
least class of each of its buckets; then the pairs that share a bucket and are
still in different components follow, except those that cannot be alike because
too many of their shingles occur nowhere else (``_shareable``).  Every link is
confirmed on the full sets.  A pair at exactly 0.8 misses all bands with a probability of
(1 - 0.8^6)^42, about 3 in a million.

Defined results: null, empty and wordless texts have an empty set and link with
nothing; a text with fewer words than a shingle has its whole word sequence as
its only shingle; rows that repeat a doc_id are one document, linked through any
of their texts; a row without doc_id is not linked, its component is null and it
is kept.  Extra columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, release, remove_table, write_buckets, write_table
from .components import components
from .textbytes import LOWER, NOT_SPACE, mix, text_bytes, text_slices, words

BANDS, ROWS = 42, 6
SHINGLE = 5
PERCENT = 80
#: Pairs of one class that go to one task.
SPREAD = 1000
#: An open bucket looks at all pairs that cross components at once if they are at most this many per class.
PARTNERS = 1000
#: Bits of the filter for documents whose sets are needed (4 MB).
SLOTS = 1 << 25
#: Bytes of sets in a bucket of their table; more sets are more buckets.
SET_BYTES = 8 << 20
MAX_SET_BUCKETS = 10_000
#: Members that a shingle may have to count as rare.
RARE = 4
BROADCAST_CLASSES = 10_000
_EMPTY = np.uint64(2**64 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within a text, and the n + 1 offsets."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    text = np.repeat(np.arange(len(n)), count)
    start = first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    value = np.minimum(n, size).astype(np.uint64)[text]
    with np.errstate(over="ignore"):
        for j in range(size):
            there = start + j < first[1:][text]
            word = np.zeros(len(start), np.uint64)
            word[there] = hashes[start[there] + j]
            value = mix(value * np.uint64(0xD6E8FEB86659FD93) + word)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(n) + 1))


def sketches(value: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """n x size sketches; a text without shingles keeps the empty mark everywhere."""
    n = len(first) - 1
    out = np.full(n * size, _EMPTY, np.uint64)
    text = np.repeat(np.arange(n), np.diff(first))
    live = np.flatnonzero(np.diff(first))
    unfilled = np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for i in range(2 * size):
            if not len(text):
                break
            h = mix(value + np.uint64(i + 1) * _STEP)
            if i < size:
                place = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            else:
                place = np.full(len(h), i - size, np.int64)
            h = mix(h)
            np.minimum.at(out, text * size + place, (np.uint64(i) << np.uint64(54)) | (h >> np.uint64(10)))
            still = (out.reshape(n, size)[live] == _EMPTY).any(axis=1)
            unfilled[live] = still
            live, keep = live[still], unfilled[text]
            value, text = value[keep], text[keep]
    return out.reshape(n, size)


def _sketched(batch: pa.RecordBatch, shingle: int) -> dict:
    data, offsets = text_bytes(batch["text"])
    counts, keys, bands = [], [], []
    with np.errstate(over="ignore"):
        for a, b in text_slices(offsets):
            hashes, _, _, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], LOWER, NOT_SPACE)
            value, first = shingles(hashes, first, shingle)
            text = np.repeat(np.arange(b - a), np.diff(first))
            key = np.zeros((2, b - a), np.uint64)
            np.add.at(key[0], text, mix(value ^ _STEP))
            np.add.at(key[1], text, mix(value + _STEP))
            rows = sketches(value, first, BANDS * ROWS).reshape(b - a, BANDS, ROWS)
            band = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], b - a, axis=0)
            for j in range(ROWS):
                band = mix(band * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, j])
            counts.append(np.diff(first))
            keys.append(key)
            bands.append(band.view(np.int64))
    n, key, band = np.concatenate(counts), np.concatenate(keys, axis=1).view(np.int64), np.concatenate(bands)
    size = np.where(n > 0, BANDS, 0)
    return {
        "doc_id": batch["doc_id"],
        "n_shingles": pa.array(n, pa.int64()),
        "k1": pa.array(key[0]),
        "k2": pa.array(key[1]),
        "bands": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(band[n > 0].ravel())),
    }


def _sets(batch: pa.RecordBatch, shingle: int) -> dict:
    data, offsets = text_bytes(batch["text"])
    out = []
    for a, b in text_slices(offsets):
        hashes, _, _, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], LOWER, NOT_SPACE)
        value, first = shingles(hashes, first, shingle)
        out.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.view(np.int64))))
    return {"id": batch["doc_id"], "set": pa.concat_arrays(out)}


def _likely(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose hashed ``key`` has its bit set by one of the ids: all that have one of them, and few others.

    The bits are SLOTS / 8 bytes in rows of 4 KB, whatever the number of ids, so
    they are broadcast; most rows then need not travel to be joined with the ids.
    (Join with the ids by an inner join: Spark would move a semi join in front of the filter.)
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)) + 1
    place = F.bitmap_bit_position(F.col("_slot"))
    maps = ids.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_part")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn("_slot", slot).withColumn("_part", F.bitmap_bucket_number("_slot")).join(F.broadcast(maps), "_part")
    return told.where(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(rows.columns)


def _set_buckets(members: DataFrame) -> int:
    """How many buckets the sets of the members are written in."""
    total = members.select("id", "n").distinct().agg(F.sum("n")).first()[0] or 0
    return min(MAX_SET_BUCKETS, max(members.sparkSession.sparkContext.defaultParallelism, -(-8 * total // SET_BYTES)))


def _known_sets(ids: DataFrame, docs: DataFrame, shingle: int, buckets: int) -> DataFrame:
    """id and set of the given documents; rows that repeat one with the same text count once.

    Hashes do not compress, so sets are several times what their texts are when shuffled.  The
    texts are dealt by id, and the sets are written where they are made, in buckets by id; a
    join on the id with rows dealt to as many ``buckets`` moves those rows only.
    """
    ids = ids.select(F.col("id").alias("doc_id")).repartition(buckets, "doc_id").distinct()
    texts = _likely(docs.select("doc_id", "text"), ids).repartition(buckets, "doc_id").join(ids, "doc_id")
    texts = texts.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).select("doc_id", "text")
    return write_buckets(map_batches(texts, lambda x: _sets(x, shingle), "id bigint, set array<bigint>"), "sets", "id", buckets)


def _shared_shingles(members: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """id, component and shingle of the members' shingles that are not of one member only, with the number of their members (docs)."""
    here = members.select("id", "component").repartition(buckets, "id").distinct()
    sets = known.join(here, "id").select("id", "component", F.explode("set").alias("shingle"))
    # Rows that repeat a doc_id with another text count twice here, which only loosens the bound.
    spread = sets.groupBy("shingle").agg(F.count("*").alias("docs"))
    return write_table(sets.join(spread.where("docs > 1"), "shingle"), "shingles")


def _shareable(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How much the members can share: (id, ``most``), and the pairs (a < b) for which that does not hold.

    ``most`` counts the shingles of a member that more than ``RARE`` members
    have.  A pair that has no rarer shingle in common cannot share more, which
    bounds its similarity from its two rows; pairs that do have one are listed,
    a shingle giving a bounded number.  Heavily edited copies of one text, which
    meet each other in many buckets, have most changes to themselves and are ruled out.
    """
    common = shared.where(F.col("docs") > RARE).groupBy("id").agg(F.count("*").alias("most"))
    rare = shared.where(F.col("docs") <= RARE)
    other = rare.select(F.col("shingle").alias("at"), F.col("id").alias("b"), F.col("component").alias("cb"))
    pairs = rare.join(other, (F.col("shingle") == F.col("at")) & (F.col("id") < F.col("b")) & (F.col("component") != F.col("cb")))
    return common, pairs.select(F.col("id").alias("a"), "b").distinct()


def _confirmed(pairs: DataFrame, known: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike.

    A document that meets thousands of others has its set copied once for every
    ``SPREAD`` of them, so its pairs are many tasks.
    """
    heavy = pairs.groupBy("a").agg(F.floor(F.count("*") / SPREAD).cast("int").alias("most")).repartition(buckets, "a")
    set_a, set_b = (known.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    left = set_a.join(heavy, "a").select("a", "set_a", F.explode(F.sequence(F.lit(0), "most")).alias("salt"))
    right = (
        pairs.join(heavy, "a")
        .withColumn("salt", F.pmod(F.xxhash64("b"), F.col("most") + 1).cast("int"))
        .repartition(buckets, "b")
        .join(set_b, "b")
        .select("a", "b", "salt", "set_b")
    )
    both = F.size(F.array_intersect("set_a", "set_b"))
    met = right.join(left, ["a", "salt"]).select("a", "b", F.size("set_a").alias("na"), F.size("set_b").alias("nb"), both.alias("both"))
    return met.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _alike(n: str, most: str, other_n: str, other_most: str, percent: int) -> Column:
    """Whether the sizes of two sets, and of what they can share, leave room for a link."""
    both = F.least(most, other_most)
    return 100 * both >= percent * (F.col(n) + F.col(other_n) - both)


def _led(members: DataFrame, leads: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of the leading classes of a bucket with its other classes, unless one component holds both."""
    met = (F.col("id") != F.col("lead.id")) & _alike("n", "most", "lead.n", "lead.most", percent)
    if "component" in members.columns:
        met &= F.col("component") != F.col("lead.component")
    leads = leads.select(F.col("bucket").alias("at"), "lead")
    return members.join(leads, (F.col("bucket") == F.col("at")) & met).select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets whose classes are not all in one component, with component, size and crossing (pairs)."""
    told = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = told.groupBy("bucket", "component").agg(F.count("*").alias("part"))
    open_ = parts.groupBy("bucket").agg(F.sum("part").alias("size"), F.sum(F.col("part").cast("double") ** 2).alias("inner"))
    crossing = (F.col("size").cast("double") ** 2 - F.col("inner")) / 2
    return told.join(open_.withColumn("crossing", crossing).where("crossing > 0").select("bucket", "size", "crossing"), "bucket")


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept, one row per document row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    table = write_table(
        map_batches(docs, lambda x: _sketched(x, shingle), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>"),
        "sketches",
    )
    usable = table.where("doc_id is not null and n_shingles > 0")
    # The least doc_id of each set. Classes with a ten-thousandth of all rows, so ten thousand at most, are broadcast.
    copies = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("top"), F.count("*").alias("rows")).where("rows > 1")
    copies = write_table(copies, "copies")
    hot = F.col("rows") * BROADCAST_CLASSES >= table.count()
    named = usable.join(F.broadcast(copies.where(hot).select("k1", "k2", F.col("top").alias("hot_top"))), ["k1", "k2"], "left")
    cold = named.where("hot_top is null").join(copies.where(~hot).select("k1", "k2", "top"), ["k1", "k2"], "left")
    ranked = named.where("hot_top is not null").withColumnRenamed("hot_top", "top").unionByName(
        cold.withColumn("top", F.coalesce("top", "doc_id")).drop("hot_top")
    )

    tops = ranked.where("top = doc_id")
    members = tops.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    # The bands are most of what moves here, so they move once.
    size = F.count("*").over(Window.partitionBy("bucket"))
    members = write_table(members.withColumn("size", size).where("size > 1").drop("size").withColumn("most", F.col("n")), "buckets")
    release(docs.sparkSession)
    buckets = _set_buckets(members)
    known = _known_sets(members, docs, shingle, buckets)
    release(docs.sparkSession)
    leads = members.groupBy("bucket").agg(F.min(F.struct("id", "n", "most")).alias("lead"))
    done = write_table(_led(members, leads, percent), "pairs")
    # A document given by several rows is linked with the least document of each of its sets.
    several = usable.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    own = ranked.join(several, "doc_id").where("top <> doc_id").select(F.col("doc_id").alias("u"), F.col("top").alias("v")).distinct()
    links = write_table(_confirmed(done, known, percent, buckets).unionByName(own), "links")
    members = members.join(leads.select("bucket", F.col("lead.id").alias("id")), ["bucket", "id"], "left_anti")
    while True:
        release(docs.sparkSession)
        labels = components(links)
        open_ = write_table(_open_buckets(members, labels).select("bucket", "id", "n", "component"), "open")
        shared = _shared_shingles(open_, known, buckets)
        release(docs.sparkSession)
        most, pairs = _shareable(shared)
        bands = open_.groupBy(F.col("id").alias("of")).agg(F.sort_array(F.collect_set("bucket")).alias("bands"))
        members = open_.drop("component").join(most, "id").where(100 * F.col("most") >= percent * F.col("n"))
        open_ = _open_buckets(members, labels).join(bands, F.col("id") == F.col("of")).drop("of")
        open_ = write_table(open_, "open")
        few = F.col("crossing") <= PARTNERS * F.col("size")
        small, large = open_.where(few), open_.where(~few)
        other = small.select("bucket", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("component").alias("cb"), F.col("bands").alias("bb"))
        met = (F.col("id") < F.col("b")) & (F.col("component") != F.col("cb")) & _alike("n", "most", "nb", "mb", percent)
        # A pair that shares several open buckets is taken in the first of them.
        met = (F.col("at") == F.col("bucket")) & met & (F.array_min(F.array_intersect("bands", "bb")) == F.col("at"))
        pairs = pairs.unionByName(small.withColumnRenamed("bucket", "at").join(other, met).select(F.col("id").alias("a"), "b"))
        # A bucket with more of them puts its least classes by a hash of their ids, about the root of its size, before all others.
        way = F.pmod(F.xxhash64("id"), F.floor(F.sqrt("size")))
        leads = large.groupBy("bucket", way.alias("way")).agg(F.min(F.struct("id", "n", "most", "component")).alias("lead"))
        pairs = pairs.unionByName(_led(large, leads, percent)).distinct().join(done, ["a", "b"], "left_anti")
        pairs = write_table(pairs, "pairs")
        remove_table(shared)
        members = large.join(leads.select("bucket", F.col("lead.id").alias("id")), ["bucket", "id"], "left_anti").select("bucket", "id", "n", "most")
        if pairs.isEmpty() and large.isEmpty():
            break
        done = done.unionByName(pairs)
        links = write_table(links.unionByName(_confirmed(pairs, known, percent, buckets)), "links")
        if large.isEmpty():
            labels = components(links)
            break
    release(docs.sparkSession)
    linked = ranked.join(labels.withColumnRenamed("node", "top"), "top", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "top").alias("component_id")
    )
    rest = table.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, without those that have a smaller doc_id in their component.

    A doc_id with several different texts is as many documents here, so that a text which is
    like no other is not lost; they come after all others in their components.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("_several"), "text").where("_several is not null")
    twice = ids.groupBy("_several").agg(F.count("*").alias("rows")).where("rows > 1").select("_several")
    several = write_table(twice, "several")
    if not several.isEmpty():
        text = F.xxhash64("text")
        texts = ids.join(several, "_several").groupBy("_several").agg(F.min(text).alias("low"), F.max(text).alias("high"))
        several = write_table(texts.where("low <> high").select("_several"), "several")
    if several.isEmpty():
        named = docs.withColumn("_one", F.col("doc_id").cast("bigint"))
    else:
        apart = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        named = docs.join(several, F.col("doc_id").cast("bigint") == F.col("_several"), "left")
        named = named.withColumn("_one", F.when(F.col("_several").isNotNull(), apart).otherwise(F.col("doc_id").cast("bigint")))
    gone = classes(named.select(F.col("_one").alias("doc_id"), "text"), shingle, percent)
    gone = gone.where("not kept").select(F.col("doc_id").alias("_one")).distinct()
    return named.join(gone, "_one", "left_anti").select(docs.columns)
