"""Filtering URLs by stated rules and by association rules mined from them.

A stated rule has a host and a path; it fits its host and all subdomains where the
path starts with its own, and the longest one that fits decides.  URLs that a stated
rule decides are labelled examples: their tokens and their label are one transaction,
Spark's FP-growth counts the frequent combinations of all transactions, and
combinations that lead to a label are kept if support and confidence suffice, they
have at most ``TOKENS`` tokens, and no part of them leads to the label as surely.  The other
URLs are judged by the surest mined rule whose tokens they all have, found through
an inverted index from a rule's rarest token to the rule; without one they are allowed.

A URL has one token for each of eight places (host, its last label, its last two,
its first; first directory; shape of the last segment; names of the query's
parameters; whether it has a fragment), so a transaction has at most nine items,
and at most ``sum(C(8, i)) / SUPPORT`` = 9,200 combinations of up to three tokens can be frequent at any
number of URLs: that bounds the mined rules, which are sent to the tasks.

Defined results: a null URL, and one without ``://``, has an empty host and path, fits
no stated rule and has tokens like any other; rows that repeat a page_id or a URL are judged
one by one and all count as examples; ties between mined rules go to the larger
support, the fewer tokens, the first tokens in order; without examples every URL that
no rule decides is allowed; columns that the result also has are replaced, others take no part.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import spread_small_input
from .common import map_batches, write_table

ALLOW, BLOCK = "allow", "block"
#: Least share of the examples that have a rule's tokens and label; least confidence; most tokens.
SUPPORT, CONFIDENCE, TOKENS = 0.01, 0.8, 3
_LABEL = "label="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Stated:
    """A rule of an allow or block list."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mined:
    """Tokens that lead to a verdict."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: int

    @property
    def order(self) -> tuple:
        return (-self.confidence, -self.support, len(self.tokens), self.tokens, self.verdict)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: str | Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    url = F.col(url) if isinstance(url, str) else url
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: str | Column) -> Column:
    """One token for each place of a URL that it has."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    label = F.split(host(url), r"\.")
    segment = F.split(path(url), "/")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)))), "&")
    last = F.regexp_replace(F.element_at(segment, -1), "[0-9]+", "0")

    def token(name: str, value: Column, there: Column) -> Column:
        return F.when(there, F.concat(F.lit(name + "="), value))

    return F.array_compact(
        F.array(
            token("host", host(url), host(url) != ""),
            token("top", F.element_at(label, -1), F.size(label) > 1),
            token("site", F.concat_ws(".", F.slice(label, -2, 2)), F.size(label) > 2),
            token("sub", F.element_at(label, 1), F.size(label) > 2),
            token("dir", F.get(segment, F.lit(1)), F.size(segment) > 2),
            token("leaf", last, F.size(segment) > 1),
            token("query", names, query != ""),
            token("fragment", F.lit("yes"), F.locate("#", _rest(url)) > 0),
        )
    )


def stated(rules: list[Stated]) -> Column:
    """The place in ``rules`` of the longest rule that fits the columns host and path, or null."""
    out = None
    for i, rule in sorted(enumerate(rules), key=lambda x: (-len(x[1].text), -len(x[1].host), x[0])):
        fits = ((F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))) & F.startswith("path", F.lit(rule.path))
        out = F.when(fits, F.lit(i)) if out is None else out.when(fits, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def learn(examples: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = TOKENS) -> list[Mined]:
    """Rules from examples (tokens, label), the surest first."""
    baskets = examples.where(F.col("label").isNotNull()).select(
        F.array_append(F.array_distinct("tokens"), F.concat(F.lit(_LABEL), F.col("label"))).alias("items")
    )
    baskets = spread_small_input(baskets)
    if baskets.isEmpty():
        return []
    frequent = write_table(
        FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0)
        .fit(baskets)
        .freqItemsets.select(
            F.array_sort(F.filter("items", lambda x: ~F.startswith(x, F.lit(_LABEL)))).alias("tokens"),
            F.array_max(F.filter("items", lambda x: F.startswith(x, F.lit(_LABEL)))).alias("label"),
            "freq",
        )
        .where((F.size("tokens") > 0) & (F.size("tokens") <= most)),
        "itemsets",
    )
    whole = frequent.where("label is null").select("tokens", F.col("freq").alias("all"))
    sure = frequent.where("label is not null").join(whole, "tokens").withColumn("confidence", F.col("freq") / F.col("all"))
    found = [
        Mined(tuple(r.tokens), r.label[len(_LABEL) :], r.confidence, r.freq) for r in sure.where(F.col("confidence") >= confidence).collect()
    ]
    return sorted(pruned(found), key=lambda x: x.order)


def pruned(rules: list[Mined]) -> list[Mined]:
    """Without those of which a part leads to the same verdict as surely."""
    known = {(x.tokens, x.verdict): x.confidence for x in rules}
    return [
        x
        for x in rules
        if not any(
            known.get((part, x.verdict), -1.0) >= x.confidence
            for size in range(1, len(x.tokens))
            for part in itertools.combinations(x.tokens, size)
        )
    ]


class Index:
    """From the rarest token of each rule to the rules, in order."""

    def __init__(self, rules: list[Mined]) -> None:
        use: dict[str, int] = {}
        for rule in rules:
            for token in rule.tokens:
                use[token] = use.get(token, 0) + 1
        self.known = frozenset(use)
        self.rules: dict[str, list[Mined]] = {}
        for rule in sorted(rules, key=lambda x: x.order):
            self.rules.setdefault(min(rule.tokens, key=lambda t: (use[t], t)), []).append(rule)

    def match(self, tokens: frozenset[str]) -> Mined | None:
        """The first rule in order whose tokens are all there."""
        found = []
        for token in tokens:
            found += next(([rule] for rule in self.rules.get(token, ()) if tokens.issuperset(rule.tokens)), [])
        return min(found, key=lambda x: x.order, default=None)


def _matched(batch: pa.RecordBatch, index: Index) -> dict:
    seen: dict[frozenset[str], Mined | None] = {}
    out = []
    for listed in batch["tokens"].to_pylist():
        tokens_ = index.known.intersection(listed)
        if tokens_ not in seen:
            seen[tokens_] = index.match(tokens_)
        out.append(seen[tokens_])
    return {
        "page_id": batch["page_id"],
        "host": batch["host"],
        "path": batch["path"],
        "place": batch["place"],
        "mined": pa.array([x and " ".join(x.tokens) for x in out], pa.string()),
        "mined_verdict": pa.array([x and x.verdict for x in out], pa.string()),
        "confidence": pa.array([x and x.confidence for x in out], pa.float64()),
    }


def judged(pages: DataFrame, rules: list[Stated], support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (tokens of the mined rule that fits) and its confidence."""
    pages = pages.select("page_id", "url")
    parts = pages.select("page_id", host("url").alias("host"), path("url").alias("path"), tokens("url").alias("tokens")).withColumn("place", stated(rules))
    verdicts, texts = F.array(*(F.lit(x.verdict) for x in rules)), F.array(*(F.lit(x.text) for x in rules))
    mined = learn(parts.where("place is not null").select("tokens", F.get(verdicts, F.col("place")).alias("label")), support, confidence)
    index = Index(mined)
    kind = pages.schema["page_id"].dataType.simpleString()
    told = map_batches(parts, lambda x: _matched(x, index), f"page_id {kind}, host string, path string, place int, mined string, mined_verdict string, confidence double")
    return told.select(
        "page_id",
        "host",
        "path",
        F.get(texts, F.col("place")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("place")), F.col("mined_verdict"), F.lit(ALLOW)).alias("verdict"),
        "mined",
        "confidence",
    )
