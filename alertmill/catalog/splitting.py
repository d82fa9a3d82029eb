"""Split, sampling and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertmill.catalog import register
from alertmill.catalog.views_sql import SCORES, WINDOWS
from alertmill.operators import splits
from alertmill.sources import views

WINDOW_ORDER = ["window_start_time", "window_id"]

PLACED = (
    WINDOWS
    + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY attack_type ORDER BY ws, window_id) AS rn,
    count(*) OVER (PARTITION BY attack_type) AS n FROM windows)
"""
)


@register(
    "chronological_split",
    f"""WITH {PLACED} SELECT window_id, CASE WHEN rn <= floor(n * 0.6) THEN 'train' ELSE 'test' END AS split
        FROM placed""",
)
def chronological_split(spark, sf_dir):
    return splits.chronological_split(views.windows(spark, sf_dir)).select("window_id", "split")


@register(
    "zone_split",
    f"""WITH {PLACED} SELECT window_id, CASE WHEN rn <= floor(n * 0.6) THEN 'A' WHEN rn <= floor(n * 0.8) THEN 'B'
        ELSE 'C' END AS zone FROM placed""",
)
def zone_split(spark, sf_dir):
    return splits.zones(views.windows(spark, sf_dir)).select("window_id", "zone")


@register(
    "random_normal_split",
    f"""WITH {WINDOWS}, t AS (SELECT window_id, count(*) OVER () AS n,
          row_number() OVER (ORDER BY md5('42:' || window_id), window_id) AS rn FROM windows WHERE label = 1)
        SELECT window_id, CASE WHEN rn <= floor(n * 0.6) THEN 'fit'
          WHEN rn <= floor(n * 0.6) + floor(n * 0.2) THEN 'calibrate' ELSE 'test' END AS part FROM t""",
)
def random_normal_split(spark, sf_dir):
    w = views.windows(spark, sf_dir).filter("label = 1")
    return splits.random_split(w, "window_id").select("window_id", "part")


@register(
    "balanced_train",
    f"""WITH {PLACED}, tr AS (SELECT window_id, attack_type,
          row_number() OVER (PARTITION BY attack_type ORDER BY md5('42:' || window_id), window_id) AS pick
          FROM placed WHERE rn <= floor(n * 0.6)),
        least AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM tr WHERE attack_type <> 'normal'
          GROUP BY attack_type))
        SELECT window_id, attack_type FROM tr, least WHERE attack_type = 'normal' OR pick <= least.c""",
)
def balanced_train(spark, sf_dir):
    train = splits.chronological_split(views.windows(spark, sf_dir)).filter("split = 'train'")
    return splits.balance(train, "window_id").select("window_id", "attack_type")


@register(
    "stratified_sample",
    f"""WITH {WINDOWS}, t AS (SELECT window_id, label, count(*) OVER (PARTITION BY label) AS n,
          row_number() OVER (PARTITION BY label ORDER BY md5('42:' || window_id), window_id) AS pick FROM windows)
        SELECT window_id, label FROM t WHERE pick <= round(n * 0.6)""",
)
def stratified_sample(spark, sf_dir):
    return splits.stratified_sample(views.windows(spark, sf_dir), ["label"], "window_id").select("window_id", "label")


@register(
    "ordered_folds",
    f"""WITH {WINDOWS} SELECT window_id, CAST(ntile(5) OVER (ORDER BY ws, window_id) AS INTEGER) AS fold
        FROM windows WHERE label = 1""",
)
def ordered_folds(spark, sf_dir):
    w = views.windows(spark, sf_dir).filter("label = 1")
    return splits.ordered_folds(w, WINDOW_ORDER).select("window_id", "fold")


@register(
    "expanding_folds",
    f"""WITH {WINDOWS}, t AS (SELECT window_id, row_number() OVER (ORDER BY ws, window_id) AS rn,
          count(*) OVER () AS n FROM windows)
        SELECT window_id, CAST(CASE WHEN rn <= n - 5 * (n // 6) THEN 0
          ELSE (rn - 1 - (n - 5 * (n // 6))) // (n // 6) + 1 END AS INTEGER) AS block FROM t""",
)
def expanding_folds(spark, sf_dir):
    return splits.expanding_folds(views.windows(spark, sf_dir), WINDOW_ORDER).select("window_id", "block")


@register(
    "tail_holdout",
    f"""WITH {WINDOWS}, t AS (SELECT window_id, row_number() OVER (ORDER BY ws DESC, window_id DESC) AS back,
          count(*) OVER () AS n FROM windows)
        SELECT window_id, CAST(back <= greatest(10, floor(n * 0.2)) AS INTEGER) AS holdout FROM t""",
)
def tail_holdout(spark, sf_dir):
    rows = splits.tail_holdout(views.windows(spark, sf_dir), WINDOW_ORDER)
    return rows.select("window_id", F.col("holdout").cast("int").alias("holdout"))


@register(
    "even_pick",
    f"""WITH {WINDOWS}, t AS (SELECT window_id, row_number() OVER (ORDER BY ws, window_id) - 1 AS i,
          count(*) OVER () AS n FROM windows WHERE label = 1)
        SELECT window_id FROM t WHERE i IN (SELECT CAST(floor(j * (m - 1) / 199) AS BIGINT)
          FROM (SELECT unnest(range(0, 200)) AS j, (SELECT max(n) FROM t) AS m))""",
)
def even_pick(spark, sf_dir):
    w = views.windows(spark, sf_dir).filter("label = 1")
    return splits.even_pick(w, WINDOW_ORDER, 200).select("window_id")


@register(
    "random_pick",
    f"""WITH {WINDOWS} SELECT window_id FROM windows WHERE label = 1
        ORDER BY md5('42:' || window_id), window_id LIMIT 200""",
)
def random_pick(spark, sf_dir):
    w = views.windows(spark, sf_dir).filter("label = 1").select("window_id")
    return splits.random_pick(w, "window_id", 200)


@register(
    "thin_normals",
    f"""WITH {SCORES}, s AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(id AS VARCHAR)),
          id) AS pick FROM scores),
        a AS (SELECT count(*) AS n FROM s WHERE y = 0)
        SELECT id, y FROM s, a WHERE y = 0 OR pick <= greatest(4 * a.n, 50)""",
)
def thin_normals(spark, sf_dir):
    return splits.thin_normals(views.scores(spark, sf_dir), "id").select("id", "y")


@register(
    "class_weights",
    f"""WITH {WINDOWS}, c AS (SELECT label, count(*) AS n FROM windows GROUP BY label)
        SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""",
)
def class_weights(spark, sf_dir):
    w = splits.class_weights(views.windows(spark, sf_dir))
    return w.withColumn("weight", F.round("weight", 6))


@register(
    "seeded_shuffle",
    f"""WITH {WINDOWS} SELECT window_id, md5('42:' || window_id) AS token FROM windows""",
)
def seeded_shuffle(spark, sf_dir):
    w = splits.shuffled(views.windows(spark, sf_dir).select("window_id"), "window_id")
    return w.withColumn("token", splits.shuffle_token(42, "window_id"))


@register("time_order", f"WITH {WINDOWS} SELECT window_id, label FROM windows ORDER BY ws, window_id")
def time_order(spark, sf_dir):
    return views.windows(spark, sf_dir).orderBy(*WINDOW_ORDER).select("window_id", "label")


@register("distinct_classes", f"WITH {WINDOWS} SELECT DISTINCT attack_type, label FROM windows")
def distinct_classes(spark, sf_dir):
    return views.windows(spark, sf_dir).select("attack_type", "label").distinct()


@register(
    "zone_union",
    f"""WITH {PLACED} SELECT attack_type, count(*) AS n, count(*) FILTER (rn <= floor(n * 0.6)) AS n_a FROM placed
        GROUP BY attack_type""",
)
def zone_union(spark, sf_dir):
    """Zone tables taken apart and put together again hold every row once."""
    z = splits.zones(views.windows(spark, sf_dir))
    whole = z.filter("zone = 'A'").unionByName(z.filter("zone = 'B'")).unionByName(z.filter("zone = 'C'"))
    return whole.groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("zone") == "A").alias("n_a")
    )
