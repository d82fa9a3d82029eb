"""Captures of packets: windows of each for itself, and the sets that detectors are judged on."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertmill.operators import packets
from alertmill.plans import packet_transfer as T


def _windows(spark, counts):
    rows = [(c, i, int(c == "normal")) for c, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "capture string, window_no int, y int")
    return df.withColumn("attack_type", F.col("capture")).withColumn("window_id", F.concat_ws(":", "capture", "window_no"))


def test_sets_hold_all_attacks_and_thinned_normals(spark):
    sets = T.evaluation_sets(_windows(spark, {"normal": 500, "flood": 30, "slow": 5}))
    got = {(r["dataset"], r["y"]): r["count"] for r in sets.groupBy("dataset", "y").count().collect()}
    assert got == {("flood", 0): 30, ("flood", 1): 120, ("slow", 0): 5, ("slow", 1): 50, (T.ALL_ATTACKS, 0): 35, (T.ALL_ATTACKS, 1): 140}
    assert sets.select("dataset", "window_id").distinct().count() == sum(got.values())
    again = T.evaluation_sets(_windows(spark, {"normal": 500, "flood": 30, "slow": 5}).repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sets.collect()))


def test_fewer_normals_than_wanted_are_all_taken(spark):
    got = T.evaluation_sets(_windows(spark, {"normal": 20, "flood": 30})).filter("dataset = 'flood' AND y = 1").count()
    assert got == 20


def test_no_attack_gives_no_set(spark):
    assert T.evaluation_sets(_windows(spark, {"normal": 20})).count() == 0


def test_captures_are_cut_each_for_itself(spark):
    rows = [(c, i, "3", f"t{i % 4}", f"body {i}", str(i / 7)) for c, n in (("normal", 130), ("slow", 70)) for i in range(n)]
    names = ["capture", "seq", "mqtt.msgtype", "mqtt.topic", "mqtt.msg", "frame.time_epoch"]
    logs = spark.createDataFrame(rows, names)
    got = T.capture_windows(logs).collect()
    assert sorted((r["capture"], r["window_no"], r["y"]) for r in got) == [("normal", 0, 1), ("normal", 1, 1), ("slow", 0, 0)]
    for capture in ("normal", "slow"):
        alone = logs.filter(F.col("capture") == capture)
        want = packets.packet_rolling(packets.packet_features(packets.packet_windows(alone))).collect()
        mine = {r["window_no"]: r for r in got if r["capture"] == capture}
        for r in want:
            assert all(abs(mine[r["window_no"]][c] - r[c]) < 1e-9 for c in r.asDict())
