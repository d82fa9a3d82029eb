"""The choice of columns as a whole, and byte counts, against plain Python."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertmill.operators.octets import byte_counts
from alertmill.plans import selection

FEATURES = ["strong", "copy", "weak", "noise", "flat", "mirror"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        family = ("normal", "normal", "flooding", "slow_poisoning")[i % 4]
        shift = {"normal": 0.0, "flooding": 3.0, "slow_poisoning": 2.0}[family]
        strong = float(rng.normal(shift))
        rows.append(
            (f"r{i}", int(family == "normal"), family, strong, 2 * strong + float(rng.normal(0, 0.05)),
             float(rng.normal(shift / 3)), float(rng.normal()), 1.0, float(family == "normal"))
        )
    return spark.createDataFrame(rows, ["id", "label", "family", *FEATURES])


def test_every_step_turns_its_column_down(table):
    found = {r["feature"]: r for r in selection.candidates(table, FEATURES, "id", "family").collect()}
    assert found["flat"]["stage"] == "variance"
    assert found["mirror"]["stage"] == "within_class"
    assert {found["strong"]["stage"], found["copy"]["stage"]} == {"collinear", "ranked"}
    loser = found["strong"] if found["strong"]["stage"] == "collinear" else found["copy"]
    assert loser["score"] is None
    ranked = [r for r in found.values() if r["stage"] == "ranked"]
    assert {r["feature"] for r in ranked} >= {"weak", "noise"}
    best = max(ranked, key=lambda r: r["score"])
    assert best["feature"] in ("strong", "copy") and best["score"] == pytest.approx(1.0)


def test_chosen_columns_are_places_in_order(table):
    chosen = selection.select_features(table, FEATURES, "id", k=2, replicates=50, cls="family")
    names = selection.chosen_features(chosen)
    assert names[0] in ("strong", "copy") and names[1] == "weak"
    out = {r["feature"]: r for r in chosen.collect()}
    assert out["noise"]["place"] is None and out["weak"]["frequency"] == 1.0
    rows = table.filter("label = 1").select(*names).toPandas()
    assert out["weak"]["max_pearson"] == pytest.approx(abs(rows.corr().iloc[0, 1]))


def test_no_column_left(table):
    out = selection.select_features(table, ["flat", "mirror"], "id", k=2, cls="family").collect()
    assert sorted((r["feature"], r["stage"], r["place"]) for r in out) == [("flat", "variance", None), ("mirror", "within_class", None)]


def test_a_single_column_needs_no_correlation(table):
    assert selection.chosen_features(selection.select_features(table, ["weak"], "id", k=8, replicates=20, cls="family")) == ["weak"]


@pytest.mark.parametrize("lead", [False, True])
def test_byte_counts(spark, lead):
    rng = np.random.default_rng(5)
    rows = [(("a", "b", None)[i % 3], i % 2, bytes(rng.integers(0, 256, int(rng.integers(0, 90))).astype(np.uint8))) for i in range(200)]
    rows += [("a", 0, None), ("c", 1, b""), ("a", 1, b"\x00\xff" * 3_000_000)]
    want = collections.Counter()
    for k, j, body in rows:
        if body is not None:
            want.update((k, j, x) for x in (b"\x00" + body if lead else body))
    df = spark.createDataFrame(rows, "k string, j int, body binary").repartition(3)
    got = {(r["k"], r["j"], r["byte"]): r["n"] for r in byte_counts(df, ["k", "j"], "body", lead).collect()}
    assert got == dict(want)


def test_byte_counts_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, body binary")
    assert byte_counts(empty, ["k"], "body").count() == 0
    nulls = spark.createDataFrame([("a", None)], "k string, body binary")
    assert byte_counts(nulls, ["k"], "body", lead=True).filter(F.col("n") > 0).count() == 0
