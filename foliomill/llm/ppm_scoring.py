"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts of up to ``ORDER`` bytes, pretrained on all
training texts (A-Z lowered).  A symbol that its longest context has seen
costs its share there, less half an occurrence, which each different symbol
leaves to the escape (method D); one that it has not seen costs the escape and is
then sought in the next shorter context, without the symbols that the longer one
has already ruled out; below the empty context all symbols left are equally likely.  Every text
starts in a context of start marks and ends with an end symbol, so scores of all
texts together are probabilities.

Counting covers all training texts: n-grams and words are summed per batch and
then per key.  Every context of the training texts counts, at any size.  Those with a
share of at least ``TRIE_SHARE`` of all training symbols, hence at most
``1 / TRIE_SHARE`` per order, are compiled into a table of costs and next contexts (eight
bytes per context and symbol seen), which is broadcast.  A symbol whose whole context
is not among them is looked up as an n-gram: the costs of all those n-grams are computed
in parts that hold every context with the same last ``LOW`` bytes (contexts of up to
``LOW`` bytes are at hand everywhere); the n-grams with a share of at least
``GRAM_SHARE`` of all symbols are broadcast, the rest is joined.

For comparison there is a unigram score with one added to each count.  Words
with a share of at least ``WORD_SHARE``, hence at most ``1 / WORD_SHARE`` of
them, are broadcast; the many rare ones are joined, which no frequent word can
skew.

Defined results: a null text is empty: no words, one end token.  Without
training texts all counts are 0.  Each row is scored by itself, rows that repeat a
doc_id too; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches, write_table
from .textbytes import LOWER, NOT_SPACE, text_bytes, text_slices, words

ORDER = 5
#: Least share of a context in all training symbols: none, every context seen counts.
CONTEXT_SHARE = 0.0
TRIE_SHARE = 2.0**-15
GRAM_SHARE = 2.0**-21
LOW = 3
#: What each different symbol of a context leaves to the escape.
LEFT = 0.5
WORD_SHARE = 2.0**-21
START, END = 254, 255  # byte values that UTF-8 never has
END_WORD = np.uint64(0x5851F42D4C957F2D)
_SYMBOLS = 255  # bytes 0 to 253 and the end
_CHUNK = 512
_SLICE = 4 << 20


def _symbols(data: np.ndarray, offsets: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with start marks before and an end symbol after each text, and where each text's own symbols start."""
    n = len(offsets) - 1
    out = np.full(len(data) + n * (before + 1), START, np.uint8)
    at = offsets[:-1] + np.arange(n) * (before + 1) + before
    shift = np.repeat(at - offsets[:-1], np.diff(offsets))
    out[np.arange(len(data)) + shift] = LOWER[data]
    out[at + np.diff(offsets)] = END
    return out, at


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _counted(batch: pa.RecordBatch) -> dict:
    """Counts of the batch: kind 0 for n-grams of ORDER + 1 symbols, kind 1 for words."""
    data, offsets = text_bytes(batch["text"])
    grams, gram_counts, tokens, token_counts = [], [], [], []
    for a, b in text_slices(offsets):
        piece, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        symbol, _ = _symbols(piece, at, ORDER)
        gram = np.zeros(len(symbol) - ORDER, np.uint64)
        for j in range(ORDER + 1):
            gram = (gram << np.uint64(8)) | symbol[j : j + len(gram)].astype(np.uint64)
        key, count = np.unique(gram[symbol[ORDER:] != START], return_counts=True)
        grams.append(key)
        gram_counts.append(count)
        key, count = np.unique(words(piece, at, LOWER, NOT_SPACE)[0], return_counts=True)
        tokens.append(key)
        token_counts.append(count)
    gram, gram_count = _summed(grams, gram_counts)
    word, word_count = _summed([*tokens, np.array([END_WORD])], [*token_counts, np.array([batch.num_rows])])
    return {
        "kind": pa.array(np.repeat([0, 1], [len(gram), len(word)]), pa.int8()),
        "key": pa.array(np.concatenate([gram, word]).view(np.int64)),
        "n": pa.array(np.concatenate([gram_count, word_count]), pa.int64()),
    }


def _counted_all(batch: pa.RecordBatch) -> dict:
    """``_counted`` of the rows to learn from with ``times``, and n-grams of the others with n = 0."""
    parts = []
    for learn in (True, False):
        rows = batch.filter(pc.equal(batch["learn"], learn))
        if rows.num_rows:
            made = _counted(rows)
            part = pa.RecordBatch.from_pydict(made | {"times": made["n"]})
            if not learn:
                part = part.filter(pc.equal(part["kind"], 0))
                part = part.set_column(2, "n", pa.array(np.zeros(part.num_rows, np.int64)))
            parts.append(part)
    return {name: pa.chunked_array([x[name] for x in parts]).combine_chunks() for name in ("kind", "key", "n", "times")}


@dataclass
class Level:
    """Contexts of one length with the symbols that follow them; a cell is a context and a symbol."""

    cells: np.ndarray  # sorted
    count: np.ndarray  # in the training texts, may be 0
    below: np.ndarray  # probability of the symbol after the context has escaped
    share: np.ndarray  # probability of the symbol, shorter contexts standing in for a context that was not seen
    context: np.ndarray  # sorted
    total: np.ndarray
    kinds: np.ndarray
    at: np.ndarray  # place of each cell's context

    @classmethod
    def build(cls, order: int, cells: np.ndarray, count: np.ndarray, shorter: Level | None, least: float) -> Level:
        """``cells`` hold all symbols of each context; ``shorter`` holds the cells one byte shorter."""
        context, at = np.unique(cells >> 8, return_inverse=True)
        count, seen = count.astype(float), count > 0
        total = np.bincount(at, weights=count, minlength=len(context))
        kinds = np.bincount(at[seen], minlength=len(context))
        if shorter is None:
            below = np.full(len(cells), 1.0 / max(1, _SYMBOLS - int(seen.sum())))
            instead = below
        else:
            up = np.searchsorted(shorter.cells, cells & ((1 << 8 * order) - 1))
            over = np.searchsorted(shorter.context, context & ((1 << 8 * (order - 1)) - 1))
            whole = shorter.total[over] - np.bincount(at[seen], weights=shorter.count[up[seen]], minlength=len(context))
            of = np.maximum(1, whole)
            escape = np.where(whole > 0, LEFT * (shorter.kinds[over] - kinds) / of, 1.0)
            rest = np.where(seen, 0, shorter.count[up])
            below = np.where(rest > 0, (rest - LEFT) / of[at], escape[at] * shorter.below[up])
            instead = shorter.share[up]
        share = np.where(seen, count - LEFT, LEFT * kinds[at] * below) / np.maximum(1, total)[at]
        return cls(cells, count, below, np.where(total[at] >= max(1.0, least), share, instead), context, total, kinds, at)


def _costs(key: np.ndarray, n: np.ndarray, low: list[Level], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Cost (log10) of each n-gram's last symbol and the count of the context before it.

    With an n-gram, all that share the last LOW bytes of its context are there.
    """
    level = low[-1]
    for order in range(len(low), ORDER + 1):
        cells, place = np.unique(key & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        level = Level.build(order, cells, np.bincount(place, weights=n, minlength=len(cells)), level, least)
    return np.log10(level.share[place]), level.total[level.at[place]]


@dataclass
class Trie:
    """Costs (log10) and next contexts by context and column; a column is a symbol of the training texts."""

    column: np.ndarray  # of each of 256 symbols
    cost: np.ndarray
    follow: np.ndarray
    start: int
    whole: int  # first context of ORDER bytes

    @classmethod
    def build(cls, cells: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        """``cells[o]``: sorted keys (context of o bytes, symbol) and their counts; all symbols of a context are there."""
        seen = (cells[0][0] & 255).astype(np.int64)
        column = np.full(256, len(seen), np.int64)
        column[seen] = np.arange(len(seen))
        width = len(seen) + 1  # the last column: any one symbol that was never seen
        counts, keys, costs, follows, unseen = [], [], [], [], []
        for order, (key, n) in enumerate(cells):
            context = np.unique(key >> 8) if order else np.zeros(1, np.int64)
            count = np.zeros((len(context), width))
            count[np.searchsorted(context, key >> 8), column[key & 255]] = n
            total, kinds = count.sum(axis=1, keepdims=True), (count > 0).sum(axis=1, keepdims=True)
            if order:
                up = np.searchsorted(keys[-1], context & ((1 << 8 * (order - 1)) - 1))
                rest = np.where(count > 0, 0, counts[-1][up])
                whole, fresh = rest.sum(axis=1, keepdims=True), (rest > 0).sum(axis=1, keepdims=True)
                of = np.maximum(1, whole)
                escape = np.where(whole > 0, LEFT * fresh / of, 1.0)
                below = np.where(rest > 0, (rest - LEFT) / of, escape * unseen[-1][up])
            else:
                below = np.full((1, width), 1.0 / max(1, _SYMBOLS - len(seen)))
            share = np.where(count > 0, count - LEFT, LEFT * kinds * below) / np.maximum(1, total) if total.any() else below
            costs.append(np.log10(np.maximum(share, 1e-300)).astype(np.float32))
            counts.append(count)
            keys.append(context)
            unseen.append(below)
        first = np.cumsum([0, *[len(k) for k in keys]])
        byte = np.append(seen, 0)
        for order, context in enumerate(keys):
            if order:
                up = np.searchsorted(keys[order - 1], context & ((1 << 8 * (order - 1)) - 1))
                follow = follows[-1][up].copy()
            else:
                follow = np.zeros((1, width), np.int32)
            if order + 1 < len(keys) and len(keys[order + 1]):
                longer = (context[:, None] << 8) | byte[None, :]
                at = np.minimum(np.searchsorted(keys[order + 1], longer), len(keys[order + 1]) - 1)
                there = keys[order + 1][at] == longer
                there[:, -1] = False
                follow[there] = (first[order + 1] + at)[there]
            follows.append(follow)
        start = 0
        for order in range(1, len(keys)):
            mark = int.from_bytes(bytes([START]) * order, "big")
            at = np.searchsorted(keys[order], mark)
            if at < len(keys[order]) and keys[order][at] == mark:
                start = int(first[order] + at)
        return cls(column, np.concatenate(costs), np.concatenate(follows).astype(np.int32), start, int(first[ORDER]))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text's symbols in contexts of the trie, and text and n-gram of each other symbol.

        Texts are cut into chunks that are walked in step; a chunk inside a text
        first reads the ORDER symbols before it, which fix its context.
        """
        symbol, at = _symbols(data, offsets, ORDER)
        column = self.column[symbol]
        size = np.diff(offsets) + 1
        parts = -(-size // _CHUNK)
        text = np.repeat(np.arange(len(size)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = at[text] + part * _CHUNK
        length = np.minimum(_CHUNK, size[text] - part * _CHUNK)
        order = np.argsort(-length, kind="stable")
        text, part, begin, length = text[order], part[order], begin[order], length[order]
        state = np.where(part > 0, 0, self.start).astype(np.int64)
        inner = np.flatnonzero(part > 0)
        for j in range(-ORDER, 0):
            state[inner] = self.follow[state[inner], column[begin[inner] + j]]
        width, cost, follow = self.cost.shape[1], self.cost.ravel(), self.follow.ravel()
        total = np.zeros(len(text))
        other = np.zeros(len(symbol), bool)
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        for j, n in enumerate(live.tolist()):
            cell = state[:n] * width + column[begin[:n] + j]
            short = state[:n] < self.whole
            total[:n] += np.where(short, 0, cost[cell])
            other[begin[:n] + j] = short
            state[:n] = follow[cell]
        place = np.flatnonzero(other)
        gram = np.zeros(len(place), np.int64)
        for j in range(-ORDER, 1):
            gram = (gram << 8) | symbol[place + j]
        return np.bincount(text, weights=total, minlength=len(size)), np.searchsorted(at, place, side="right") - 1, gram


@dataclass
class Model:
    trie: Trie
    words: np.ndarray  # sorted hashes of frequent words
    worth: np.ndarray  # log10(count + 1)
    grams: np.ndarray  # sorted frequent n-grams beside the trie
    costs: np.ndarray
    tokens: int
    vocabulary: int


def count(docs: DataFrame, learn: Column) -> DataFrame:
    """kind, key, n, times: n-grams (kind 0) of all documents and words (kind 1) of those for which ``learn`` holds.

    ``n`` counts the documents for which ``learn`` holds, ``times`` all of them.
    """
    made = map_batches(docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn")), _counted_all, "kind tinyint, key bigint, n bigint, times bigint")
    return write_table(made.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("times").alias("times")), "counts")


def _fetched(df: DataFrame, value: str = "n") -> tuple[np.ndarray, np.ndarray]:
    got = df.select("key", value).toArrow()
    key, n = got["key"].to_numpy(), got[value].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _cells(grams: DataFrame, order: int) -> DataFrame:
    return grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))


def gram_costs(grams: DataFrame, symbols: int) -> DataFrame:
    """key, times, cost of the n-grams whose context is not in the trie."""
    low: list[Level] = []
    for order in range(LOW):
        low.append(Level.build(order, *_fetched(_cells(grams, order)), low[-1] if low else None, CONTEXT_SHARE * symbols))
    shared = grams.sparkSession.sparkContext.broadcast(low)

    def made(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(part)
        key = rows["key"].to_numpy()
        cost, total = _costs(key, rows["n"].to_numpy(), shared.value, CONTEXT_SHARE * symbols)
        rare = total < max(1.0, TRIE_SHARE * symbols)
        return pa.RecordBatch.from_pydict({"key": key[rare], "times": rows["times"].to_numpy()[rare], "cost": cost[rare]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            end = batch["end"].to_numpy()
            cut = int(np.searchsorted(end, end[-1]))
            if held and (cut or held[-1]["end"][-1].as_py() != end[0]):
                yield made([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield made([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield made(held)

    dealt = grams.select(F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * LOW) - 1)).alias("end"), "key", "n", "times")
    dealt = dealt.repartition("end").sortWithinPartitions("end")
    return write_table(map_arrow(dealt, run, "key bigint, times bigint, cost double"), "costs")


def learn(counts: DataFrame) -> tuple[Model, DataFrame]:
    """The model to broadcast, with the frequent contexts, n-grams and words; and key, times, cost of n-grams beside the trie."""
    sums = (F.sum("n").alias("n"), F.sum("times").alias("times"), F.count("*").alias("keys"))
    kinds = {r.kind: r for r in counts.groupBy("kind").agg(*sums).collect()}
    symbols, tokens = (kinds[k].n if k in kinds else 0 for k in (0, 1))
    grams = counts.where("kind = 0")
    cells = []
    for order in range(ORDER + 1):
        cell = _cells(grams.where("n > 0"), order)
        if order:
            cell = cell.withColumn("context", F.shiftright("key", 8))
            kept = cell.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= TRIE_SHARE * symbols)
            cell = cell.join(F.broadcast(kept.select("context")), "context")
        cells.append(_fetched(cell))
    costs = gram_costs(grams, symbols)
    often = _fetched(costs.where(F.col("times") >= GRAM_SHARE * (kinds[0].times if 0 in kinds else 0)), "cost")
    head = counts.where((F.col("kind") == 1) & (F.col("n") >= WORD_SHARE * tokens))
    key, n = _fetched(head)
    order = np.argsort(key.view(np.uint64))
    worth = np.log10(n[order] + 1.0)
    model = Model(Trie.build(cells), key.view(np.uint64)[order], worth, *often, int(tokens), int(kinds[1].keys) if 1 in kinds else 0)
    rest = costs.where(F.col("times") < GRAM_SHARE * (kinds[0].times if 0 in kinds else 0))
    return model, rest


def _looked_up(text: np.ndarray, key: np.ndarray, n: int, known: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: sum of ``worth`` and number of the keys in ``known``; text, key and times of each other key."""
    distinct, inverse = np.unique(key, return_inverse=True)
    place = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
    there = known[place] == distinct if len(known) else np.zeros(len(distinct), bool)
    value = worth[place] if len(known) else np.zeros(len(distinct))
    head = there[inverse]
    sums = np.bincount(text[head], weights=value[inverse[head]], minlength=n)
    pair, times = np.unique((text[~head] << 32) | inverse[~head], return_counts=True)
    return sums, np.bincount(text[head], minlength=n), pair >> 32, distinct[pair & 0xFFFFFFFF].view(np.int64), times


def _scored(batch: pa.RecordBatch, model: Model) -> dict:
    """Per text: score and base score of what is broadcast, tokens and number of frequent words, and the other n-grams and words with their counts."""
    data, offsets = text_bytes(batch["text"])
    scores, tokens, sums, known, ends, rare = [], [], [], [], [np.zeros(1, np.int64)], []
    for a, b in text_slices(offsets, _SLICE):
        piece, at, n = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], b - a
        score, text, gram = model.trie.score(piece, at)
        more, _, gram_text, gram, gram_times = _looked_up(text, gram, n, model.grams, model.costs)
        scores.append(score + more)
        hashes, _, _, first = words(piece, at, LOWER, NOT_SPACE)
        hashes = np.insert(hashes, first[1:], END_WORD)
        first = first + np.arange(n + 1)
        text = np.repeat(np.arange(n), np.diff(first))
        total, often, word_text, word, word_times = _looked_up(text, hashes, n, model.words, model.worth)
        tokens.append(np.diff(first))
        sums.append(total)
        known.append(often)
        text = np.concatenate([gram_text, word_text])
        order = np.argsort(text, kind="stable")
        kind = np.repeat(np.array([0, 1], np.int8), [len(gram), len(word)])
        rare.append([x[order] for x in (kind, np.concatenate([gram, word]), np.concatenate([gram_times, word_times]))])
        ends.append(ends[-1][-1] + np.searchsorted(text[order], np.arange(1, n + 1)))
    kind, key, times = (np.concatenate(x) for x in zip(*rare, strict=True))
    lists = pa.StructArray.from_arrays([pa.array(kind, pa.int8()), pa.array(key, pa.int64()), pa.array(times, pa.int32())], ["kind", "key", "times"])
    return {
        "doc_id": batch["doc_id"],
        "held_out": batch["held_out"],
        "n_tokens": pa.array(np.concatenate(tokens), pa.int64()),
        "head_score": pa.array(np.concatenate(scores).astype(float)),
        "head_sum": pa.array(np.concatenate(sums).astype(float)),
        "head_known": pa.array(np.concatenate(known), pa.int64()),
        "rare": pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), lists),
    }


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows that are not held out.
    """
    counts = count(docs, ~held_out)
    model, costs = learn(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, head_score double, head_sum double, head_known bigint, rare array<struct<kind:tinyint,key:bigint,times:int>>"
    made = map_batches(docs.select("doc_id", held_out.alias("held_out"), "text"), lambda x: _scored(x, shared.value), schema)
    made = write_table(made.withColumn("row", F.monotonically_increasing_id()), "scores")
    tail = made.select("row", F.explode("rare").alias("of")).select("row", "of.kind", "of.key", "of.times")
    rare = counts.where((F.col("kind") == 1) & (F.col("n") < WORD_SHARE * model.tokens)).select("kind", "key", F.log10(F.col("n") + 1.0).alias("value"))
    rare = rare.unionByName(costs.select(F.lit(0).cast("tinyint").alias("kind"), "key", F.col("cost").alias("value")))
    word, value = F.col("kind") == 1, F.col("times") * F.col("value")
    found = tail.join(rare, ["kind", "key"]).groupBy("row").agg(
        F.sum(F.when(word, value)).alias("tail_sum"), F.sum(F.when(word, F.col("times"))).alias("tail_known"), F.sum(F.when(~word, value)).alias("tail_score")
    )
    each = float(np.log10(model.tokens + model.vocabulary + 1))
    none = F.lit(0)
    return made.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", none)).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", none) - F.col("n_tokens") * each).alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_score", none)).alias("score"),
    )
