"""Operators of audits, projections and context that no query covers."""

import math

import pytest
from pyspark.sql import functions as F

from quillspan.operators import audit, context, project


def test_zip_and_order(spark):
    a, b = (spark.createDataFrame([(k, f"{p}{k}") for k in n], "k int, v string") for p, n in (("x", range(9)), ("y", range(20, 29))))
    got = audit.strict_zip(a.withColumnRenamed("v", "left"), b.select((-F.col("k")).alias("o"), F.col("v").alias("right")), ["k"], ["o"]).collect()
    assert sorted((r["left"], r["right"]) for r in got) == [(f"x{k}", f"y{28 - k}") for k in range(9)]
    with pytest.raises(ValueError):
        audit.strict_zip(a, b.limit(3), ["k"], ["k"])
    same = a.select("k", (F.col("k") * 2).alias("job"))
    assert audit.same_order(same, same, ["k"], ["k"], "job").count() == 0
    assert sorted(r["position"] for r in audit.same_order(same, same.filter("k < 7"), ["k"], ["k"], "job").collect()) == [7, 8]


def test_positions_whatever_is_read(spark):
    """Plans over few and over all columns join ranges in different ways."""
    wide = spark.range(0, 20000, 1, 8).select(F.pmod(F.col("id") * 7919, F.lit(20000)).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        p = audit.positions(wide, ["k"])
        assert p.filter(~F.col("position").eqNullSafe(F.col("k"))).filter("text is not null").count() == 0
        assert p.join(p.filter("length(text) > 0").select("k", F.col("position").alias("again")), "k").filter("position <> again").count() == 0
        assert p.orderBy("text").select("position", "k", "text").filter("position <> k or position is null").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_guarded_union(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, doc string, split string")
    old = make([(1, "a", "train"), (2, "b", "test")])
    assert audit.guarded_union(old, make([(3, "a", "train")]), ["id"], "split", "doc").count() == 3
    with pytest.raises(ValueError):
        audit.guarded_union(old, make([(2, "c", "test")]), ["id"], "split", "doc")
    with pytest.raises(ValueError):
        audit.guarded_union(old, make([(3, "a", "test")]), ["id"], "split", "doc")


def test_failures_and_safety(spark):
    rows = spark.createDataFrame([(1, []), (2, ["x"])], "id int, entities array<string>")
    failed = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert sorted(r["id"] for r in audit.empty_failures(failed, rows, ["id"], ["entities"]).collect()) == [2, 3]
    rates = spark.createDataFrame([(1.0, 1.0, 0.0, 0.0), (1.0, 0.9, 0.1, 0.0)], "coverage double, correctness double, unsupported_rate double, invalid_rate double")
    assert [r[0] for r in rates.select(audit.is_safe(rates)).collect()] == [True, False]


def test_score_and_assembly(spark):
    d = spark.createDataFrame([([0.0, 1.0, 2.0], 2, 0.5)], "z array<double>, k int, p double")
    want = math.sqrt(math.exp(2) / (1 + math.exp(1) + math.exp(2)) * 0.5)
    assert d.select(project.joint_score("z", "k", "p")).first()[0] == pytest.approx(want)
    jobs = spark.createDataFrame([(1,), (2,)], "job int")
    notes = spark.createDataFrame([(1, "b"), (1, "a")], "job int, name string")
    got = {r["job"]: [x["name"] for x in r["notes"]] for r in context.assemble(jobs, ["job"], notes=(notes, ["name"])).collect()}
    assert got == {1: ["a", "b"], 2: []}
