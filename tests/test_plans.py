"""Group aggregates and ordered scans give the same with and without splitting."""

import random

from pyspark.sql import functions as F

from gaugeline.plans.groups import attach, measure, with_group_aggs
from gaugeline.plans.ordered import Running, ordered, top_per_key


def rows(spark, n=60, seed=1):
    rng = random.Random(seed)
    # one key holds most rows
    data = [(("hot" if rng.random() < 0.6 else f"k{i % 5}"), i, float(rng.randint(0, 20))) for i in range(n)]
    return data, spark.createDataFrame(data, "key string, id bigint, v double")


def by_key(data):
    out = {}
    for k, i, v in data:
        out.setdefault(k, []).append((i, v))
    return out


def test_positions_and_running_values(spark, any_split):
    data, df = rows(spark)
    scan = ordered(df, ["key"], ["id"]).position("at").running(
        total=Running("sum", F.col("v")), before=Running("sum", F.col("v"), inclusive=False),
        top=Running("max", F.col("v")), low=Running("min", F.col("v"), backward=True),
        even=Running("last", F.when(F.col("v") % 2 == 0, F.col("v"))),
        next_even=Running("last", F.when(F.col("v") % 2 == 0, F.col("v")), backward=True))
    assert scan.split == bool(any_split)
    got = {r.id: r for r in scan.result().collect()}
    assert "_chunk" not in scan.result().columns
    for items in by_key(data).values():
        vals = [v for _, v in items]
        for at, (i, v) in enumerate(items):
            evens = [x for x in vals[:at + 1] if x % 2 == 0]
            later = [x for x in vals[at:] if x % 2 == 0]
            r = got[i]
            assert (r.at, r.total, r.before) == (at, sum(vals[:at + 1]), sum(vals[:at]))
            assert (r.top, r.low) == (max(vals[:at + 1]), min(vals[at:]))
            assert r.even == (evens[-1] if evens else None)
            assert r.next_even == (later[0] if later else None)


def test_neighbours(spark, any_split):
    data, df = rows(spark)
    scan = ordered(df, ["key"], ["id"]).neighbour(-1, left=F.col("v")).neighbour(1, right=F.col("v"))
    got = {r.id: (r.left, r.right) for r in scan.result().collect()}
    for items in by_key(data).values():
        vals = [None] + [v for _, v in items] + [None]
        for at, (i, _) in enumerate(items, start=1):
            assert got[i] == (vals[at - 1], vals[at + 1])


def test_top_per_key(spark, any_split):
    data, df = rows(spark)
    scan = ordered(df, ["key"], ["id"])
    got = {(r.key, r.id) for r in top_per_key(scan, [F.col("v").desc(), F.col("id")], 3).collect()}
    want = {(k, i) for k, items in by_key(data).items()
            for i, _ in sorted(items, key=lambda t: (-t[1], t[0]))[:3]}
    assert got == want


def test_group_aggregates(spark, any_split):
    data, df = rows(spark)
    got = {r.id: (r.n, r.mean) for r in with_group_aggs(
        df, ["key"], n=F.count("v"), mean=F.avg("v")).collect()}
    assert len(got) == len(data)
    for items in by_key(data).values():
        mean = sum(v for _, v in items) / len(items)
        for i, _ in items:
            assert got[i][0] == len(items) and abs(got[i][1] - mean) < 1e-12


def test_attach_keeps_every_row(spark, any_split):
    data, df = rows(spark)
    df = df.unionByName(spark.createDataFrame([(None, 1000, 1.0)], df.schema))
    names = df.select("key").distinct().filter("key <> 'k1'").withColumn("name", F.upper("key"))
    left = attach(df, names, ["key"], "left").collect()
    assert len(left) == len(data) + 1
    assert all(r.name == (r.key.upper() if r.key not in (None, "k1") else None) for r in left)
    assert attach(df, names, ["key"], "inner").count() == sum(1 for k, *_ in data if k != "k1")
    assert attach(df, names.select("key"), ["key"], "left_anti").count() == sum(
        1 for k, *_ in data if k == "k1") + 1


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_sizes(spark):
    _, df = rows(spark)
    sizes = measure(df, ["key"])
    assert sizes.total == 60 and sizes.largest > 20


def test_scans_grow_with_the_steps_and_not_faster(spark, any_split, tmp_path):
    _, df = rows(spark)
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert scans(with_group_aggs(df, ["key"], n=F.count("v"))) == 2
    assert scans(attach(df, df.select("key").distinct(), ["key"])) == 2
    scan = ordered(df, ["key"], ["id"])
    for step in range(4):
        scan = scan.running(**{f"s{step}": Running("sum", F.col("v"))}).neighbour(-1, **{f"n{step}": F.col("v")})
    # every step reads one settled table twice at most
    assert scans(scan.result()) <= (2 if any_split else 1)


def test_hot_key_is_split_at_run_time(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k"}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("key"), "id")
        names = df.select("key").distinct().withColumn("name", F.col("key") + 1)
        joined = attach(df, names, ["key"])
        assert joined.agg(F.sum("name")).collect()[0][0] is not None
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
