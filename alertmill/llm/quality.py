"""Quality rules whose thresholds follow each language and source.

Per document a handful of integer measures is taken. For every (language,
source) group and measure a quantile sketch is built: counts of values whose
low bits are cleared so that ``SKETCH_BITS`` leading bits stay (relative error
below 2^-(SKETCH_BITS-1)). Sketches merge by adding counts, so partial
aggregation, any order of merging and coarser groups all give the same sketch.
A group with fewer than ``MIN_DOCUMENTS`` documents uses the merged sketch of
its language, and that of all documents if the language is as small.

The fence of a measure is its group's median plus ``reach`` times the distance
between the quartiles, or times ``spread`` where that is larger, so that a
group of like documents does not turn on documents that differ by a trifle.

Defined cases: a null or empty text has no words and fails; null languages and
sources are groups of their own; repeated rows are judged alike, each on its
own; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm import words as W
from alertmill.llm.common import join_small, packed
from alertmill.session import settle

MIN_WORDS = 50
MIN_DOCUMENTS = 100
SKETCH_BITS = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_upper"]


@dataclass(frozen=True)
class Rule:
    """A measure in thousandths: ``top`` per ``bottom``, fenced above and, if asked, below."""

    name: str
    top: str
    bottom: str
    spread: int
    reach: int
    below: bool = False


RULES = (
    Rule("word_length", "word_chars", "n_words", spread=300, reach=6, below=True),
    Rule("symbols", "n_symbols", "n_words", spread=20, reach=10),
    Rule("dup_lines", "n_dup_lines", "n_lines", spread=45, reach=10),
    Rule("repeats", "n_repeat_words", "n_words", spread=45, reach=10),
    Rule("capitals", "n_upper", "word_chars", spread=20, reach=10),
)


def _counts(part: W.Slice) -> dict[str, np.ndarray]:
    data, offsets = part.data, part.offsets
    starts, ends, bounds = W.word_spans(part)
    inside = ~W.IS_SPACE[data]
    raw = W.byte_prefix(data, lower=False)
    out = {
        "n_words": np.diff(bounds),
        "word_chars": W.per_row(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": W.per_row(_SYMBOL[data], offsets),
        "n_upper": W.per_row((data >= 65) & (data <= 90), offsets),
    }
    cuts = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data)) if len(begin) else begin
    end = end - (data[end - 1] == 10) if len(begin) else end
    full = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=full[1:])
    wordy = full[end] > full[begin]
    begin, end = begin[wordy], end[wordy]
    lines = np.searchsorted(begin, offsets)
    keys = W.salted(W.spans_hash(raw, begin, end), lines)
    _, firsts = np.unique(keys, return_index=True)
    first = np.zeros(len(keys), np.int64)
    first[firsts] = 1
    out["n_lines"] = np.diff(lines)
    out["n_dup_lines"] = out["n_lines"] - W.per_row(first, lines)

    hashes = W.spans_hash(raw, starts, ends)
    runs, run_bounds = W.shingles(hashes, bounds, 3)
    keys = W.salted(runs, run_bounds)
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(len(hashes), bool)
    if len(twice):
        hit = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
        # the run that is r-th of its row begins at the r-th word of that row
        shift = (bounds[:-1] - run_bounds[:-1])[W.row_of(run_bounds)]
        at = np.flatnonzero(hit) + shift[hit]
        for j in range(3):
            covered[at + j] = True
    out["n_repeat_words"] = W.per_row(covered, bounds)
    return out


_SCHEMA = "struct<" + ",".join(f"{c}: bigint" for c in COUNTS) + ">"


def measure_texts(texts: pa.Array) -> pa.Array:
    parts = [_counts(part) for part in W.slices(texts)]
    columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=COUNTS)


def text_counts(text: Column) -> Column:
    """The counts of ``COUNTS`` as one struct; only the text goes to Python."""

    @F.arrow_udf(_SCHEMA)
    def counts(texts: pa.Array) -> pa.Array:
        return measure_texts(texts)

    return counts(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * 50)


def cleared(value: Column) -> Column:
    """The value without its bits beyond the leading ``SKETCH_BITS``: its cell of the sketch."""
    spare = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    size = F.expr("1L") * F.pow(F.lit(2.0), spare).cast("bigint")
    return value - value % size


def sketch(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per (keys, measure, cell). Adding them merges sketches."""
    cells = [F.struct(F.lit(r.name).alias("measure"), cleared(F.col(r.name)).alias("cell")) for r in RULES]
    return (
        measures.select(*keys, F.explode(F.array(*cells)).alias("c"))
        .groupBy(*keys, "c.measure", "c.cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Lower quartile, median, upper quartile and size of each sketch; a sketch has a bounded number of cells."""
    by = Window.partitionBy(*keys, "measure")
    cum = sketches.withColumn("total", F.sum("n").over(by)).withColumn("cum", F.sum("n").over(by.orderBy("cell")))
    at = {q: F.min(F.when(F.col("cum") * 4 >= F.col("total") * k, F.col("cell"))) for k, q in enumerate(("q1", "q2", "q3"), 1)}
    return cum.groupBy(*keys, "measure").agg(*[e.alias(q) for q, e in at.items()], F.max("total").alias("total"))


def fences(measures: DataFrame) -> DataFrame:
    """One row per (lang, source): ``<measure>_low`` and ``<measure>_high``."""
    own = settle(sketch(measures, ["lang", "source"]), "sketches")
    levels = []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        q = quartiles(merge(own, keys), keys)
        rows = q.groupBy(*keys) if keys else q.groupBy()
        picks = []
        for r in RULES:
            for c in ("q1", "q2", "q3"):
                picks.append(F.max(F.when(F.col("measure") == r.name, F.col(c))).alias(f"{r.name}_{c}_{level}"))
        levels.append(rows.agg(*picks, F.max("total").alias(f"n_{level}")))
    groups, langs, whole = levels
    langs = langs.withColumnRenamed("lang", "lang_1")
    table = groups.join(langs, F.col("lang").eqNullSafe(F.col("lang_1")), "left").join(F.broadcast(whole), F.lit(True), "left")

    def pick(name: str) -> Column:
        return (
            F.when(F.col("n_0") >= MIN_DOCUMENTS, F.col(f"{name}_0"))
            .when(F.col("n_1") >= MIN_DOCUMENTS, F.col(f"{name}_1"))
            .otherwise(F.col(f"{name}_2"))
        )

    bounds = []
    for r in RULES:
        q1, q2, q3 = (pick(f"{r.name}_{q}") for q in ("q1", "q2", "q3"))
        width = F.greatest(q3 - q1, F.lit(r.spread)) * r.reach
        bounds.append((q2 + width).alias(f"{r.name}_high"))
        if r.below:
            bounds.append((q2 - width).alias(f"{r.name}_low"))
    return table.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *bounds)


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` must hold ``_c``, the struct of counts, ``lang`` and ``source``."""
    return docs.withColumns(
        {r.name: F.expr(f"_c.{r.top} * 1000 div greatest(_c.{r.bottom}, 1)") for r in RULES}
    )


def judged(docs: DataFrame) -> DataFrame:
    """Add ``kept`` to measured rows (see ``with_measures``) by the fences of all of them."""
    limits = fences(docs)
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    ok = ~base_failed(F.col("_c.n_words"), F.col("_c.n_repeat_words"))
    for r in RULES:
        ok = ok & (F.col(r.name) <= F.col(f"{r.name}_high"))
        if r.below:
            ok = ok & (F.col(r.name) >= F.col(f"{r.name}_low"))
    return join_small(docs, limits, on).withColumn("kept", ok)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, and the measures."""
    slim = docs.select("doc_id", "lang", "source", text_counts(F.col("text")).alias("_c"))
    rows = judged(settle(with_measures(slim), "measures"))
    return rows.select(
        "doc_id",
        *[F.col(f"_c.{c}").alias(c) for c in BASE],
        base_failed(F.col("_c.n_words"), F.col("_c.n_repeat_words")).alias("base_failed"),
        "kept",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with all their columns."""
    own = packed(docs).select("_doc", "_doc.lang", "_doc.source", text_counts(F.col("_doc.text")).alias("_c"))
    rows = judged(settle(with_measures(own), "measures"))
    return rows.filter("kept").select("_doc.*")
