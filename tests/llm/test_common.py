"""Helpers: bitmap filters and written tables."""

import random

from quireworks.llm import common


def test_matching_equals_a_semi_join(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.randrange(500), rng.choice(["a", "b", None]), i) for i in range(3000)], "k long, t string, i long")
    keys = spark.createDataFrame([(rng.randrange(500), rng.choice(["a", "b"])) for _ in range(200)], "k long, t string").distinct()
    got = sorted(r["i"] for r in common.matching(rows, keys, ["k", "t"]).collect())
    assert got == sorted(r["i"] for r in rows.join(keys, ["k", "t"], "left_semi").collect())
    marked = common.mark_possible(rows, keys, ["k", "t"], "m")
    assert marked.columns == [*rows.columns, "m"] and marked.filter("not m").join(keys, ["k", "t"], "left_semi").count() == 0
    assert marked.filter("not m").count() > 1000
    assert common.mark_possible(rows, keys.limit(0), ["k", "t"], "m").filter("m").count() == 0


def test_written_tables_can_be_dropped(spark):
    ws = common.Workspace(spark, "test")
    one = ws.save(spark.range(5), "one")
    assert one.count() == 5 and common.shared_dir(spark) in one.saved_path
    ws.drop(one)
    empty = ws.save(spark.range(0), "none")
    assert empty.count() == 0 and empty.columns == ["id"]


def test_batches_for_python_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for had, want in (("64m", str(common.BATCH_BYTES)), ("1m", "1m")):
            spark.conf.set(name, had)
            common.bound_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
