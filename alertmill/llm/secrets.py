"""Secret scan: fixed patterns, and strings that a battery of tests cannot tell from random ones.

Patterns (``PATTERNS``) give the base spans. The battery looks at runs of
encoding characters with a letter and a digit. For each the encoding is
inferred (hex, base 32, base 64) and its code values are tested:

- chi-squared uniformity over the alphabet, standardised with the exact mean
  and variance of uniform draws;
- the runs test of values in the lower and upper half of the alphabet;
- lag-one serial correlation.

The score is the sum of the three departures, low for random strings. Its null
distribution is that of the corpus's own long words, which hold letters only:
the p-value of a score is the share of words, not longer than the string's
length band, that score as low. Shorter words look more random than longer
ones, so this errs towards silence. Within each length band the
Benjamini-Hochberg rule at ``RATE`` decides. Scores are counted in cells of
1/``CELLS``, so bands, p-values and cuts come from small grouped counts.

Defined cases: a null or empty text has no span; spans of one kind do not
overlap, those of different kinds may, except that random spans which touch a
base span are not added; repeated rows are scanned each on its own; an empty
table gives an empty result. Positions are code points, ends exclusive. Columns
other than doc_id and text are not read. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm.common import numbered, packed
from alertmill.session import settle

MARK, MARK_TWIN = "", ""
RATE = 0.05
CELLS = 4
MIN_RANDOM = 16
BANDS = (16, 20, 28, 40, 64)

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> pattern; a match of assign also needs MIN_VALUE characters in its second group.
PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    # looked at from the start of a run only, so that a long run is read once
    "random": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}",
}
KINDS = list(PATTERNS)
MIN_VALUE = 6
_LONG_WORD = r"[A-Za-z]{16,}"
_ALPHABETS = (
    ("[0-9a-f]+", "0123456789abcdef"),
    ("[0-9A-F]+", "0123456789ABCDEF"),
    ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (".+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def _possible(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match of the kind passes."""
    if kind == "assign":
        low = F.lower(text)
        return low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    if kind == "access":
        return text.contains("AKIA")
    return text.rlike("[0-9]") if kind == "random" else F.lit(True)


def _segments(kind: str, text: Column) -> Column:
    """The text cut at both ends of each match: segments at odd places are matches. Null without a match."""
    marked = F.when(_possible(kind, text), F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}"))
    return F.when(marked.contains(MARK), F.split(marked, MARK))


def matches(docs: DataFrame) -> DataFrame:
    """Rows (_row, doc_id, kind, start, end, value), and one with a null kind for each document; ``_row`` may be given."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # the marks' own characters become others of the same length that no pattern matches
    plain = F.when(text.contains(MARK), F.translate(text, MARK, MARK_TWIN)).otherwise(text)
    number = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    rows = docs.select("doc_id", number.alias("_row"), plain.alias("text"))
    cuts = [F.struct(F.lit(k).alias("kind"), _segments(k, F.col("text")).alias("segments")) for k in KINDS]
    always = F.struct(F.lit(None).cast("string").alias("kind"), F.array(F.lit("")).alias("segments"))
    found = rows.select("_row", "doc_id", F.explode(F.array(always, *cuts)).alias("c")).filter("c.segments IS NOT NULL")
    parts = found.select("_row", "doc_id", "c.kind", F.posexplode("c.segments").alias("place", "value"))
    parts = parts.select(
        "_row", "doc_id", "kind", "place", F.length("value").alias("size"), F.when(F.col("place") % 2 == 1, F.col("value")).alias("value")
    )
    # one shuffle of slim rows: the parts of one text and kind
    end = F.sum("size").over(Window.partitionBy("_row", "kind").orderBy("place"))
    spans = parts.withColumn("end", end).filter(F.col("value").isNotNull() | F.col("kind").isNull())
    good = F.col("kind").isNull() | (F.col("kind") != "assign") | (F.length(F.regexp_extract("value", _ASSIGN, 2)) >= MIN_VALUE)
    return spans.filter(good).select("_row", "doc_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def band(size: Column) -> Column:
    out = F.lit(0)
    for b in BANDS[1:]:
        out = out + (size >= b).cast("int")
    return out


def battery(rows: DataFrame) -> DataFrame:
    """Add band and cell of the score of ``value`` (at least ``MIN_RANDOM`` encoding characters)."""
    plain = F.translate("value", "-_", "+/")
    alphabet = F.lit(None)
    for pattern, letters in reversed(_ALPHABETS):
        alphabet = F.when(plain.rlike(f"^{pattern}$"), F.lit(letters)).otherwise(alphabet)
    rows = rows.withColumn("_v", plain).withColumn("_alphabet", alphabet)
    codes = F.expr("transform(regexp_extract_all(_v, '(.)', 1), c -> cast(locate(c, _alphabet) - 1 as double))")
    rows = rows.withColumn("_x", codes).withColumn("_n", F.size("_x").cast("double")).withColumn("_a", F.length("_alphabet").cast("double"))
    rows = rows.withColumn("_equal", F.expr("aggregate(transform(array_distinct(_x), d -> cast(size(filter(_x, x -> x = d)) as double)), 0D, (s, c) -> s + c * c)"))
    rows = rows.withColumn("_chi", (F.col("_equal") * F.col("_a") / F.col("_n") - F.col("_n") - F.col("_a") + 1) / F.sqrt(2 * (F.col("_a") - 1) * (1 - 1 / F.col("_n"))))
    rows = rows.withColumn("_up", F.expr("transform(_x, x -> x >= _a / 2)"))
    rows = rows.withColumn("_n1", F.expr("cast(size(filter(_up, u -> u)) as double)")).withColumn("_n2", F.col("_n") - F.col("_n1"))
    rows = rows.withColumn("_runs", F.expr("1D + size(filter(sequence(1, size(_up) - 1), i -> _up[i] != _up[i - 1]))"))
    both = 2 * F.col("_n1") * F.col("_n2")
    mean, variance = both / F.col("_n") + 1, both * (both - F.col("_n")) / (F.col("_n") * F.col("_n") * (F.col("_n") - 1))
    # a string within one half of the alphabet has a single run, which random strings do not
    rows = rows.withColumn("_rz", F.when(variance > 0, F.abs(F.col("_runs") - mean) / F.sqrt(variance)).otherwise(F.sqrt("_n")))
    rows = rows.withColumn("_mean", F.expr("aggregate(_x, 0D, (s, x) -> s + x) / _n"))
    rows = rows.withColumn("_var", F.expr("aggregate(_x, 0D, (s, x) -> s + (x - _mean) * (x - _mean))"))
    lag = F.expr("aggregate(sequence(1, size(_x) - 1), 0D, (s, i) -> s + (_x[i] - _mean) * (_x[i - 1] - _mean))")
    rows = rows.withColumn("_sz", F.when(F.col("_var") > 0, F.abs(lag / F.col("_var")) * F.sqrt("_n")).otherwise(F.sqrt("_n")))
    score = F.greatest(F.col("_chi"), F.lit(0.0)) + F.col("_rz") + F.col("_sz")
    out = rows.withColumn("band", band(F.length("value"))).withColumn("cell", F.floor(score * CELLS).cast("int"))
    return out.drop("_v", "_alphabet", "_x", "_n", "_a", "_equal", "_chi", "_up", "_n1", "_n2", "_runs", "_rz", "_mean", "_var", "_sz")


def cuts(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """(band, cut): the highest cell that is still a discovery. ``words`` has ``times``, how often a word occurs."""
    spark = candidates.sparkSession
    bands = spark.range(len(BANDS)).select(F.col("id").cast("int").alias("band"))
    null = words.groupBy("band", "cell").agg(F.sum("times").alias("w")).select(F.col("band").alias("own"), "cell", "w")
    null = null.join(F.broadcast(bands), F.col("own") <= F.col("band")).groupBy("band", "cell").agg(F.sum("w").alias("w"))
    mine = candidates.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("c"))
    cells = mine.join(null, ["band", "cell"], "full").fillna(0, ["w", "c"])
    up, all_of = Window.partitionBy("band").orderBy("cell"), Window.partitionBy("band")
    p = (F.sum("w").over(up) + 1) / (F.sum("w").over(all_of) + 1)
    ok = p * F.sum("c").over(all_of) <= RATE * F.sum("c").over(up)
    return cells.withColumn("ok", ok).filter("ok AND c > 0").groupBy("band").agg(F.max("cell").alias("cut"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row: _row, doc_id and ``spans``, an array of (start, rank of the kind, kind, end) in order."""
    found = settle(matches(docs), "matches")
    # few bytes but much work for each: dealt evenly, not by the files they come in
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = battery(found.filter("kind = 'random'").repartition(parts, "_row", "start"))
    long_words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({_LONG_WORD})"), F.lit(1))).alias("value"))
    counted = long_words.groupBy("value").agg(F.count(F.lit(1)).alias("times"))
    cut = settle(cuts(candidates, battery(counted)), "cuts")
    random = candidates.join(F.broadcast(cut), "band").filter("cell <= cut").select("_row", "doc_id", "kind", "start", "end")
    base = found.filter("kind IS NULL OR kind != 'random'").select("_row", "doc_id", "kind", "start", "end")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    # the furthest end of the base spans that begin before this one ends
    is_random = F.coalesce(F.col("kind") == "random", F.lit(False))
    before = Window.partitionBy("_row").orderBy(F.when(is_random, F.col("end") - 1).otherwise(F.col("start")))
    reach = F.max(F.when(~is_random, F.col("end"))).over(before.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = base.unionByName(random).withColumn("reach", reach)
    touching = is_random & F.coalesce(F.col("reach") > F.col("start"), F.lit(False))
    span = F.when(F.col("kind").isNotNull() & ~touching, F.struct("start", rank.alias("rank"), "kind", "end"))
    return rows.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) AS n_{k}") for k in KINDS if k != "random"]
    return secret_spans(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(spans).alias("spans"))


def redact(docs: DataFrame, mask: str = "*") -> DataFrame:
    """All documents, every character of a span replaced by ``mask``."""
    own = numbered(packed(docs))
    found = secret_spans(own.select("_row", "_doc.doc_id", "_doc.text")).filter(F.size("spans") > 0)
    found = found.select(F.col("_row").alias("_of"), "spans")
    out = own.join(found, F.col("_row") == F.col("_of"), "left")
    cut = F.expr(
        f"aggregate(spans, _doc.text, (t, s) -> concat(substring(t, 1, cast(s.start as int)), repeat('{mask}', cast(s.end - s.start as int)),"
        " substring(t, cast(s.end as int) + 1)))"
    )
    text = F.when(F.col("spans").isNull(), F.col("_doc.text")).otherwise(cut)
    return out.select(F.col("_doc").withField("text", text).alias("_doc")).select("_doc.*")
