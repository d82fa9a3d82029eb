"""Order-dependent work without one task per key.

A plain ``Window.partitionBy(key).orderBy(time)`` sends every row of a key to
one task, and a key may hold a third of the data. Here the rows are range
partitioned by (keys, order) instead and written once, together with the
number of the partition they fell into. Each (key, part) group is then no
larger than one range partition, and results are carried from part to part
through a table with one row per (key, part).

``order`` must be unique within a key; add an id as tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.session import settle

ALL = "_all"


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Range partition by (keys, order), keep the partition number in ``_part``."""
    cols = [F.col(c) for c in [*keys, *order]]
    ranged = df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)
    return settle(ranged.withColumn("_part", F.spark_partition_id()), "spread")


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(ALL, F.lit(0)), [ALL])


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int = 0,
    after: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """Add ``_rank`` (1-based within key), ``_n`` (rows of the key), ``_part``, ``_halo``.

    With ``before``/``after`` each part also receives copies of that many
    neighbouring rows, marked ``_halo``, so that a frame of this width can be
    evaluated over ``part_window(keys)``. Drop the copies with ``core``.
    """
    df, ks = _keyed(df, keys)
    rows = spread(df, ks, order, parts)
    sizes = rows.groupBy(*ks, "_part").agg(F.count(F.lit(1)).alias("_size"))
    by_part = Window.partitionBy(*ks).orderBy("_part")
    spans = sizes.select(
        *ks,
        "_part",
        F.row_number().over(by_part).alias("_ordinal"),
        (F.sum("_size").over(by_part) - F.col("_size")).alias("_start"),
        F.sum("_size").over(by_part).alias("_end"),
        F.sum("_size").over(Window.partitionBy(*ks)).alias("_n"),
    )
    inside = Window.partitionBy(*ks, "_part").orderBy(*order)
    out = rows.join(spans, [*ks, "_part"]).withColumn("_rank", F.col("_start") + F.row_number().over(inside))
    names = [F.col(f"`{c}`") for c in (*rows.columns, "_rank", "_n")]
    plain = out.select(*names, F.lit(False).alias("_halo"))
    if before or after:
        near = F.array_union(
            F.when(F.col("_rank") > F.col("_end") - before, F.sequence(F.lit(1), F.lit(max(before, 1)))).otherwise(
                F.array().cast("array<int>")
            ),
            F.when(F.col("_rank") <= F.col("_start") + after, F.sequence(F.lit(-max(after, 1)), F.lit(-1))).otherwise(
                F.array().cast("array<int>")
            ),
        )
        target = spans.select(
            *ks,
            F.col("_part").alias("_to_part"),
            F.col("_ordinal").alias("_to"),
            F.col("_start").alias("_to_start"),
            F.col("_end").alias("_to_end"),
        )
        reach = ((F.col("_to") > F.col("_ordinal")) & (F.col("_rank") > F.col("_to_start") - before)) | (
            (F.col("_to") < F.col("_ordinal")) & (F.col("_rank") <= F.col("_to_end") + after)
        )
        copies = (
            out.withColumn("_hop", F.explode(near))
            .withColumn("_to", F.col("_ordinal") + F.col("_hop"))
            .join(target, [*ks, "_to"])
            .filter(reach)
            .withColumn("_part", F.col("_to_part"))
            .select(*names, F.lit(True).alias("_halo"))
        )
        plain = plain.unionByName(copies)
    return plain


def part_window(keys: Sequence[str]):
    """The window over one part of a key, in rank order."""
    return Window.partitionBy(*(keys or [ALL]), "_part").orderBy("_rank")


def core(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop halo copies and the bookkeeping columns, except those in ``keep``."""
    extra = [c for c in (ALL, "_part", "_halo", "_rank", "_n") if c in df.columns and c not in keep]
    return df.filter(~F.col("_halo")).drop(*extra)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running values over ``order`` to rows that carry ``_part``.

    ``sums`` adds ``name`` (inclusive running sum) and ``name_total`` (sum over
    the key); ``maxima`` adds the inclusive running maximum.
    """
    sums, maxima = sums or {}, maxima or {}
    ks = list(keys) or [ALL]
    if ALL in ks and ALL not in df.columns:
        df = df.withColumn(ALL, F.lit(0))
    for name, expr in {**sums, **maxima}.items():
        df = df.withColumn(f"_x_{name}", expr)
    parts = df.groupBy(*ks, "_part").agg(
        *[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums],
        *[F.max(f"_x_{n}").alias(f"_s_{n}") for n in maxima],
    )
    earlier = Window.partitionBy(*ks).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*ks)
    carry = parts.select(
        *ks,
        "_part",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in sums],
        *[F.max(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in maxima],
    )
    inside = Window.partitionBy(*ks, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(carry, [*ks, "_part"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_c_{n}") + F.coalesce(F.sum(f"_x_{n}").over(inside), F.lit(0)))
    for n in maxima:
        out = out.withColumn(n, F.greatest(F.col(f"_c_{n}"), F.max(f"_x_{n}").over(inside)))
    return out.drop(*[f"_x_{n}" for n in {**sums, **maxima}], *[f"_c_{n}" for n in {**sums, **maxima}])


def ladder(df: DataFrame, keys: Sequence[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """One row per distinct value with running counts.

    Ties are merged by a map-side combined count before anything is ordered.
    For each ``name`` in ``counts`` the result holds ``name`` (at this value),
    ``name_cum`` (up to and with it) and ``name_cum_total``.
    """
    df, ks = _keyed(df, keys)
    steps = df.groupBy(*ks, value).agg(*[F.sum(e).alias(n) for n, e in counts.items()])
    out = running(spread(steps, ks, [value]), ks, [value], {f"{n}_cum": F.col(n) for n in counts})
    return out.drop("_part") if keys else out.drop("_part", ALL)


#: Cells that a span of values is counted in.
CELLS = 4096


def _cell(v: Column, lo: Column, hi: Column) -> Column:
    """The cell of a value between ``lo`` and ``hi``: never falls with v, and both ends are alone at the edges.

    Infinite and NaN ends are cells of their own too, so each round parts any two different values in the end.
    """
    scale = F.when(hi / 2 - lo / 2 > 1e307, 0.5).otherwise(1.0)
    place = F.nanvl((v * scale - lo * scale) / (hi * scale - lo * scale), F.lit(0.0)) * CELLS
    inner = F.greatest(F.lit(1.0), F.least(F.lit(CELLS - 2.0), place)).cast("int")
    return F.when(v == lo, 0).when(v == hi, CELLS - 1).otherwise(inner)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per key, one column per name, by counting.

    Nothing is sorted. The span that holds a wanted rank is cut into ``CELLS``
    cells; the rows in each are counted inside the tasks; the cell with the rank
    becomes the span, down to its least and greatest value, until it holds a
    single value. Each round narrows every span 4096 times, so two or three
    rounds are usual, and what is shuffled are counts.
    """
    keyed, ks = _keyed(df.filter(F.col(value).isNotNull()), keys)
    rows = settle(keyed.select(*ks, F.col(value).cast("double").alias("_v")), "values")
    ranks = [edge(F.lit(float(p)) * (F.col("_cnt") - 1)).cast("bigint") for p in probs.values() for edge in (F.floor, F.ceil)]
    sizes = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    spans = sizes.select("*", F.lit(0).cast("bigint").alias("_before"), F.explode(F.array_distinct(F.array(*ranks))).alias("_place"))
    spans = settle(spans, "spans")
    while not (wide := spans.filter("_low < _high")).isEmpty():
        # the number of smaller values names a span
        narrow = wide.select(*ks, "_low", "_high", "_before").distinct()
        inside = rows.join(narrow, ks).filter(F.col("_v").between(F.col("_low"), F.col("_high")))
        cells = inside.groupBy(*ks, "_before", _cell(F.col("_v"), F.col("_low"), F.col("_high")).alias("_c")).agg(
            F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_l"), F.max("_v").alias("_h")
        )
        line = Window.partitionBy(*ks, "_before").orderBy("_c")
        cells = cells.withColumn("_from", F.col("_before") + F.sum("_in").over(line) - F.col("_in"))
        found = wide.join(cells, [*ks, "_before"]).filter("_place >= _from AND _place < _from + _in")
        found = found.select(*ks, "_cnt", F.col("_l").alias("_low"), F.col("_h").alias("_high"), F.col("_from").alias("_before"), "_place")
        spans = settle(spans.filter("NOT (_low < _high)").unionByName(found), "spans")
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_cnt") - 1)
        picks += [F.max(F.when(F.col("_place") == edge(at), F.col("_low"))).alias(f"_{end}_{name}") for end, edge in (("lo", F.floor), ("hi", F.ceil))]
        picks.append(F.max(at - F.floor(at)).alias(f"_f_{name}"))
    out = spans.groupBy(*keys).agg(*picks) if keys else spans.agg(*picks)
    between = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs]
    return out.select(*keys, *between)


def melt(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form (ids, feature, value), all values as double."""
    slim = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return slim.unpivot(list(ids), list(features), "feature", "value")


def feature_quantiles(
    df: DataFrame, features: Sequence[str], probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Quantiles of many columns in one job: one row per (keys, feature)."""
    return quantiles(melt(df, keys, features), [*keys, "feature"], "value", probs)


def hashed_rank(df: DataFrame, keys: Sequence[str], token: Column, id_col: str) -> DataFrame:
    """Exact rank of rows in a seeded random order: adds ``_rank`` and ``_n``.

    ``token`` is a hex digest. Its first four digits cut every key into up to
    65536 even slices, so no slice holds more than a sliver of a hot key.
    """
    df, ks = _keyed(df, keys)
    rows = df.withColumn("_token", token).withColumn("_slice", F.substring("_token", 1, 4))
    sizes = rows.groupBy(*ks, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    by_slice = Window.partitionBy(*ks).orderBy("_slice")
    spans = sizes.select(
        *ks,
        "_slice",
        (F.sum("_size").over(by_slice) - F.col("_size")).alias("_start"),
        F.sum("_size").over(Window.partitionBy(*ks)).alias("_n"),
    )
    inside = Window.partitionBy(*ks, "_slice").orderBy("_token", id_col)
    out = rows.join(spans, [*ks, "_slice"]).withColumn("_rank", F.col("_start") + F.row_number().over(inside))
    drop = ["_token", "_slice", "_start"] + ([] if keys else [ALL])
    return out.drop(*drop)


def shuffle_token(seed: int, *cols: str) -> Column:
    """Seeded digest of an id; the same text in every SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
