"""Hard negatives by exact integer products of anchors and candidates.

Vectors are brought to integers (``floor(SCALE * x)``).  Anchors and candidates are
dealt into blocks of a bounded number of bytes by a hash of their row number, and a
cell of one anchor block and one candidate block is one group of a cogroup.  A cell
multiplies tiles of both by Strassen's recursion on int64, padding odd sides with a
zero row or column; all additions are exact.  Each anchor keeps a short sorted list,
a heap of fixed depth, and lists are merged from tile to tile, then over cells by
a window whose rows per anchor are the cells times the list's depth.

Two rounds: the first multiplies inside each label and finds an anchor's positives;
the second multiplies across labels and fills, for each positive, the window of
scores from ``LOW`` percent of the positive's score up to that score.  So a pair of
rows is multiplied once.  One label, vector or vec_id with a third of all rows is
spread over the blocks like any other.

Defined results: a row with null vec_id, label or vector, or with a null or
non-finite component, takes no part; shorter vectors count as filled up with zeros,
an empty vector scores 0; rows that repeat a vec_id are rows of their own, and
each of them that is an anchor gives its own rows; ties follow the smaller vec_id;
components beyond 64 bits take the nearest end and products wrap; a negative positive
score leaves no room for a negative; extra columns take no part; no rows, no result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

SCALE = 256
POSITIVES, NEGATIVES, LOW = 5, 5, 80
#: Bytes of the vectors in a block of candidates or anchors.
BLOCK_BYTES = 16 << 20
#: Candidates below which a block is not split further to use all cores.
LEAST_BLOCK = 1024
TILE_ANCHORS, TILE_CANDIDATES = 512, 4096
LEAF = 32
_NONE = np.iinfo(np.int64).min


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The plain product; in doubles where every partial sum is a whole number they hold exactly."""
    if _largest(a) * _largest(b) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two int64 matrices with seven half-size products per level; wraps like int64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    with np.errstate(over="ignore"):
        p1 = strassen(a11 + a22, b11 + b22, leaf)
        p2 = strassen(a21 + a22, b11, leaf)
        p3 = strassen(a11, b12 - b22, leaf)
        p4 = strassen(a22, b21 - b11, leaf)
        p5 = strassen(a11 + a12, b22, leaf)
        p6 = strassen(a21 - a11, b11 + b12, leaf)
        p7 = strassen(a12 - a22, b21 + b22, leaf)
        out = np.empty((2 * i, 2 * l), np.int64)
        out[:i, :l] = p1 + p4 - p5 + p7
        out[:i, l:] = p3 + p5
        out[i:, :l] = p2 + p4
        out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Best:
    """For each of ``n`` owners the ``depth`` first (score falling, id rising) of all it was offered."""

    def __init__(self, n: int, depth: int) -> None:
        self.score = np.zeros((n, depth), np.int64)
        self.id = np.zeros((n, depth), np.int64)
        self.size = np.zeros(n, np.int64)

    def offer(self, owner: int, score: np.ndarray, ids: np.ndarray) -> None:
        held, depth = int(self.size[owner]), self.score.shape[1]
        if held:
            if held == depth:
                able = score >= self.score[owner, -1]
                score, ids = score[able], ids[able]
            score = np.concatenate([self.score[owner, :held], score])
            ids = np.concatenate([self.id[owner, :held], ids])
        if len(score) > 64:
            least = np.partition(score, len(score) - depth)[len(score) - depth]
            able = score >= least
            score, ids = score[able], ids[able]
        first = np.lexsort((ids, ~score))[:depth]  # ~x falls as x rises and knows no overflow
        self.size[owner] = len(first)
        self.score[owner, : len(first)], self.id[owner, : len(first)] = score[first], ids[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, score and id of everything kept."""
        owner = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        return owner, self.score[owner, place], self.id[owner, place]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _tiles(anchors: pa.Table, others: pa.Table, width: int):
    """(first anchor, first candidate, scores) of each tile of a cell."""
    left, right = _matrix(anchors["v"], width), _matrix(others["v"], width).T
    for a in range(0, left.shape[0], TILE_ANCHORS):
        for b in range(0, right.shape[1], TILE_CANDIDATES):
            yield a, b, strassen(left[a : a + TILE_ANCHORS], np.ascontiguousarray(right[:, b : b + TILE_CANDIDATES]))


def _positives(anchors: pa.Table, others: pa.Table, width: int, depth: int) -> pa.Table:
    """The best candidates of each anchor in one cell of one label."""
    row, own = others["row_no"].to_numpy(), anchors["row_no"].to_numpy()
    ids = others["vec_id"].to_numpy()
    best = Best(len(own), depth)
    for a, b, scores in _tiles(anchors, others, width):
        rows_, ids_ = row[b : b + scores.shape[1]], ids[b : b + scores.shape[1]]
        for i, score in enumerate(scores):
            other = rows_ != own[a + i]
            best.offer(a + i, score[other], ids_[other])
    owner, score, ids = best.rows()
    return pa.table({"row_no": own[owner], "anchor_id": anchors["vec_id"].to_numpy()[owner], "positive_id": ids, "positive_score": score})


def _negatives(anchors: pa.Table, others: pa.Table, width: int, depth: int, low: int) -> pa.Table:
    """The best candidates of another label in the window of each anchor and positive in one cell."""
    label, ids, own = others["label"].to_numpy(), others["vec_id"].to_numpy(), anchors["label"].to_numpy()
    goals = anchors["goals"].combine_chunks()
    first, goal = goals.offsets.to_numpy(), goals.flatten().to_numpy()
    least = np.array([-(-low * p // 100) for p in goal.tolist()], np.int64)
    best = Best(len(goal), depth)
    for a, b, scores in _tiles(anchors, others, width):
        labels_, ids_ = label[b : b + scores.shape[1]], ids[b : b + scores.shape[1]]
        for i, score in enumerate(scores):
            k = np.arange(first[a + i], first[a + i + 1])
            if not len(k):
                continue
            able = np.flatnonzero((score >= least[k].min()) & (score <= goal[k].max()) & (labels_ != own[a + i]))
            score = score[able]
            for j in k:
                inside = (score >= least[j]) & (score <= goal[j])
                if inside.any():
                    best.offer(j, score[inside], ids_[able[inside]])
    owner, score, ids = best.rows()
    anchor = np.repeat(np.arange(len(own)), np.diff(first))[owner]
    return pa.table(
        {
            "row_no": anchors["row_no"].to_numpy()[anchor],
            "place": (owner - first[anchor] + 1).astype(np.int32),
            "negative_id": ids,
            "negative_score": score,
        }
    )


def integers(rows: DataFrame) -> DataFrame:
    """vec_id, label and the integer vector ``v`` of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    given = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    given = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    return given.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double"))).alias("v"))


def mine(
    rows: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says of a row of ``integers`` whether it is an anchor.
    """
    spark = rows.sparkSession
    table = write_table(integers(rows).withColumn("row_no", F.monotonically_increasing_id()), "vectors")
    n, width, chosen = table.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(anchor)).first()
    block = max(1, block_bytes // (8 * max(1, width)))
    spread = min(spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_BLOCK))
    blocks, anchor_blocks = max(1, math.ceil(n / block), spread), max(1, math.ceil(chosen / block))

    def block_of(many: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("row_no", F.lit(seed)), F.lit(many)).cast("int")

    def every(many: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(many - 1)))

    others = table.withColumn("b", block_of(blocks, 1)).withColumn("a", every(anchor_blocks))
    # Columns of their own, as both sides of a cogroup come from one table.
    anchors = table.where(anchor).toDF(*table.columns).withColumn("a", block_of(anchor_blocks, 2))

    def cells(of: DataFrame, by: list[str], function, schema: str) -> DataFrame:
        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            return function(left, right)

        return of.withColumn("b", every(blocks)).groupBy(*by).cogroup(others.groupBy(*by)).applyInArrow(cell, schema)

    found = cells(
        anchors,
        ["label", "a", "b"],
        lambda x, y: _positives(x, y, width, positives),
        "row_no bigint, anchor_id bigint, positive_id bigint, positive_score bigint",
    )
    in_order = Window.partitionBy("row_no").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= positives)
    found = write_table(found, "positives")

    goals = found.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("goals"))
    aimed = anchors.join(goals.select("row_no", F.col("goals.positive_score").alias("goals")), "row_no")
    met = cells(aimed, ["a", "b"], lambda x, y: _negatives(x, y, width, negatives, low), "row_no bigint, place int, negative_id bigint, negative_score bigint")
    in_order = Window.partitionBy("row_no", "place").orderBy(F.desc("negative_score"), "negative_id")
    met = met.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= negatives)
    return met.join(found, ["row_no", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
