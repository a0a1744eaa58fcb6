"""Captured scanner capability XML to rows, in one pass over each document.

Element names count without prefix and case.  The source of a value is told by the
names on its path: ``adf_duplex`` before ``adf_simplex``, ``film`` and ``platen``, else
``default``.  A document that is not well-formed, has a document type or nests deeper
than ``DEPTH`` gives one error row and no values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 128
#: Parts of element names that tell a source, by precedence.
SOURCES = (
    ("adf_duplex", ("adfduplex", "duplexadf")),
    ("adf_simplex", ("adfsimplex", "simplexadf", "feeder", "adf")),
    ("film", ("film", "transparen")),
    ("platen", ("platen", "flatbed")),
    ("default", ()),
)
#: The same for the text of an input-source element.
INPUT_SOURCES = (("platen", ("platen", "flatbed")), ("adf_duplex", ("duplex",)), ("adf_simplex", ("adf", "feed")), ("film", ("film", "transparen")))
_DEFAULT = len(SOURCES) - 1
_TEXTS = {"colormode": "color_mode", "documentformat": "format", "documentformatext": "format"}
_LIMITS = {"maxwidth": "max_width", "maxscanwidth": "max_width", "maxheight": "max_height", "maxscanheight": "max_height"}
_BOUNDS = [f"{b}_{a}" for a in ("x", "y") for b in ("min", "max", "step")]
_FIELDS = {"source": pa.string(), "kind": pa.string(), "ordinal": pa.int32(), "value": pa.string()} | {n: pa.int64() for n in ("x", "y", *_BOUNDS)}
_SCHEMA = "source string, kind string, ordinal int, value string, " + ", ".join(f"{n} bigint" for n in ("x", "y", *_BOUNDS))


def _number(text: str) -> int | None:
    found = re.fullmatch(r"\s*\+?([0-9]+)\s*", text)
    return int(found[1]) if found and int(found[1]) < 1 << 32 else None


def _told(name: str, kinds: tuple) -> int | None:
    return next((k for k, (_, parts) in enumerate(kinds) if any(p in name for p in parts)), None)


class _Reader:
    """What one document says, gathered while it is read."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.source = [_DEFAULT]  # least source on the path, element by element
        self.texts: list[list[str]] = []
        self.found: dict[tuple[int, str], list[dict]] = {}
        self.limits: dict[tuple[int, str], int | None] = {}
        self.seen: dict[int, None] = {}  # sources in order of appearance
        self.make: str | None = None
        self.pair: dict[str, int | None] | None = None
        self.range: dict[str, int | None] | None = None

    def start(self, name: str, _: dict) -> None:
        if len(self.names) >= DEPTH:
            raise ValueError("nested too deeply")
        name = name.rpartition(":")[2].lower()
        told = _told(name, SOURCES)
        self.names.append(name)
        self.source.append(min(self.source[-1], _DEFAULT if told is None else told))
        self.texts.append([])
        if name in ("resolution", "discreteresolution"):
            self.pair = {}
        elif name == "resolutionrange":
            self.range = {}

    def text(self, data: str) -> None:
        if self.texts:
            self.texts[-1].append(data)

    def refuse(self, *_: object) -> None:
        raise ValueError("document type not allowed")

    def add(self, kind: str, row: dict) -> None:
        self.found.setdefault((self.source[-1], kind), []).append(row)

    def end(self, _: str) -> None:
        name, text = self.names[-1], "".join(self.texts.pop())
        at = self.source[-1]
        self.seen.setdefault(at)
        if name in _TEXTS:
            value = text.strip()
            known = self.found.get((at, _TEXTS[name]), ())
            if value and all(value.lower() != r["value"].lower() for r in known):
                self.add(_TEXTS[name], {"value": value})
        elif name == "makeandmodel":
            self.make = text.strip() or None
        elif name == "inputsource":
            told = _told(text.lower(), INPUT_SOURCES)
            if told is not None:
                self.seen.setdefault([n for n, _ in SOURCES].index(INPUT_SOURCES[told][0]))
        elif name in _LIMITS:
            self.limits[at, _LIMITS[name]] = _number(text)
        elif name in ("xresolution", "yresolution") and self.pair is not None:
            self.pair[name[0]] = _number(text)
        elif name in ("resolution", "discreteresolution"):
            pair, self.pair = self.pair or {}, None
            if pair.get("x") and pair.get("y"):
                self.add("discrete", pair)
        elif name in ("min", "max", "step") and self.range is not None and len(self.names) > 1:
            axis = {"xresolutionrange": "x", "yresolutionrange": "y"}.get(self.names[-2])
            if axis:
                self.range[f"{name}_{axis}"] = _number(text)
        elif name == "resolutionrange":
            made, self.range = self.range or {}, None
            if all(made.get(f"min_{a}") and (made.get(f"max_{a}") or 0) >= made[f"min_{a}"] for a in "xy"):
                row = made | {f"step_{a}": made.get(f"step_{a}") or 1 for a in "xy"}
                if row not in self.found.get((at, "range"), ()):
                    self.add("range", row)
        self.names.pop()
        self.source.pop()

    def rows(self) -> Iterator[dict]:
        for k, source in enumerate(self.seen):
            yield {"source": SOURCES[source][0], "kind": "source", "ordinal": k}
        for (source, kind), rows in self.found.items():
            for k, row in enumerate(rows):
                yield {"source": SOURCES[source][0], "kind": kind, "ordinal": k, **row}
        for (source, kind), value in self.limits.items():
            if value is not None:
                yield {"source": SOURCES[source][0], "kind": kind, "ordinal": 0, "x": value}
        if self.make is not None:
            yield {"kind": "make_and_model", "ordinal": 0, "value": self.make}


def read_document(xml: str | None) -> list[dict]:
    """The rows of one document, or one of the kind ``error`` with the reason as value."""
    reader, parser = _Reader(), expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.text
    parser.StartDoctypeDeclHandler = reader.refuse
    try:
        if xml is None:
            raise ValueError("no document")
        parser.Parse(xml.encode(), True)
    except (expat.ExpatError, ValueError) as error:
        return [{"kind": "error", "ordinal": 0, "value": str(error)}]
    return list(reader.rows())


def capability_rows(documents: DataFrame, xml: str = "xml", key: str = "device") -> DataFrame:
    """Everything the documents say: key, source, kind, ordinal, value, x, y and the bounds of ranges.

    ``kind`` is source (one row per source that occurs) | color_mode | format (value; equal
    spellings of one source in any case once) | discrete (x, y; neither zero) | range (0 < min <= max, a missing or
    zero step is one) | max_width | max_height (x) | make_and_model (value, without source) | error (value, the reason).
    """
    kind = documents.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_document(x) for x in batch["_xml"].to_pylist()]
            owner = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            rows = [row for rows in found for row in rows]
            columns = {name: pa.array([row.get(name) for row in rows], kind_) for name, kind_ in _FIELDS.items()}
            yield pa.RecordBatch.from_pydict({key: batch[key].take(owner), **columns})

    return documents.select(key, F.col(xml).alias("_xml")).mapInArrow(read, f"`{key}` {kind}, {_SCHEMA}")


def capability_values(documents: DataFrame, xml: str = "xml", key: str = "device") -> DataFrame:
    """Text values: device, source, kind (color_mode | format), ordinal, value."""
    rows = capability_rows(documents, xml, key)
    return rows.where(F.col("kind").isin("color_mode", "format")).select(key, "source", "kind", "ordinal", "value")


def capability_resolutions(documents: DataFrame, xml: str = "xml", key: str = "device") -> DataFrame:
    """Resolutions: device, source, kind (discrete | range), ordinal, x, y, min_x, max_x, step_x, min_y, max_y, step_y."""
    rows = capability_rows(documents, xml, key)
    return rows.where(F.col("kind").isin("discrete", "range")).drop("value")


def capability_sources(documents: DataFrame, xml: str = "xml", key: str = "device") -> DataFrame:
    """device, source, make_and_model, max_width, max_height, error: one row per source that a document names,
    by a path or by an input-source element, and one row without source for a document that cannot be read."""
    rows = capability_rows(documents, xml, key).where(F.col("kind").isin("source", "max_width", "max_height", "make_and_model", "error"))
    found = rows.groupBy(key).agg(
        F.max(F.when(F.col("kind") == "make_and_model", F.col("value"))).alias("make_and_model"),
        F.max(F.when(F.col("kind") == "error", F.col("value"))).alias("error"),
        # At most three rows per source, of five sources.
        F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "kind", "x"))).alias("found"),
    )
    each = found.withColumn("source", F.explode_outer(F.array_distinct(F.col("found.source"))))

    def limit(kind: str):
        there = F.filter("found", lambda r: (r["source"] == F.col("source")) & (r["kind"] == kind))
        return F.get(there, F.lit(0))["x"].alias(kind)

    return each.select(key, "source", "make_and_model", limit("max_width"), limit("max_height"), "error")
