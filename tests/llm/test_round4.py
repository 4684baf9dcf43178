"""What the operators leave to the driver."""

import random

from pyspark.sql import functions as F

from peerpanel.llm import hard_negatives


def test_hard_negatives_leave_anchors_and_zones_off_the_driver(spark, monkeypatch):
    r = random.Random(11)
    rows = [(i, i % 3, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    data = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    plans, collected = {}, []
    stored, collect = hard_negatives.stored, type(data).collect

    def spy(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    def rows_of(df):
        collected.append(len(got := collect(df)))
        return got

    monkeypatch.setattr(hard_negatives, "stored", spy)
    monkeypatch.setattr(type(data), "collect", rows_of)
    out = hard_negatives.hard_negatives(data, lambda i: i % 10 == 0, block=16)
    # the groups of anchors are small as files only: nothing they or the anchors join is broadcast
    final = out._jdf.queryExecution().executedPlan().toString()
    for name in ("negatives-found", "negatives-windows", "negatives-floors"):
        assert plans[name] and not any("Broadcast" in p for p in plans[name]), name
    assert "Broadcast" not in final
    # zones of pieces come as arrays, not as a row per dimension
    assert max(collected) <= 8
    monkeypatch.undo()
    assert out.groupBy("anchor_id").agg(F.countDistinct("positive_id").alias("n")).where("n <> 5").count() == 0


def test_hard_negatives_send_anchors_to_parts_not_blocks(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i, i % 3, [r.gauss(0, 1) for _ in range(6)]) for i in range(600)]
    data = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    made = lambda: sorted(map(tuple, hard_negatives.hard_negatives(data, lambda i: i % 10 == 0, block=4).collect()))
    stored, names = hard_negatives.stored, []
    monkeypatch.setattr(hard_negatives, "stored", lambda df, name: names.append(name) or stored(df, name))
    got = made()
    # no table has a row per group and block; one partition of blocks is searched at a time
    assert got and "negatives-asked" not in names
    monkeypatch.setattr(hard_negatives, "PIECES", 2)      # several parts to a piece
    monkeypatch.setattr(hard_negatives, "HELD", 16)       # rows passed on in between
    assert made() == got
