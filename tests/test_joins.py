import pytest
from pyspark.sql import functions as F

from payouts.operators.joins import first_per_key, lookup_join, lookup_joins, merge_by_key


@pytest.fixture(scope="module")
def frames(spark):
    """A third of the rows share key k0, a third have no key, the rest spread out; k1 is not in the table."""
    key = F.when(F.col("id") % 3 == 0, "k0").when(F.col("id") % 3 == 2, F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    rows = spark.range(3000).select("id", key.alias("k"), (F.col("id") % 7).alias("j"))
    dim = spark.range(60).where("id <> 1").select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), (F.col("id") * 10).alias("v"), F.lit(None).cast("int").alias("n"))
    return rows, dim


def brute(rows, dim):
    table = {r["k"]: r["v"] for r in dim.collect()}
    return sorted((r["id"], table.get(r["k"]), r["k"] in table) for r in rows.collect())


def test_lookup_join_matches_brute_force(frames):
    rows, dim = frames
    out = lookup_join(rows, dim, ["k"], flag="hit")
    assert out.columns == ["id", "k", "j", "v", "n", "hit"]
    assert sorted((r["id"], r["v"], r["hit"]) for r in out.collect()) == brute(rows, dim)


SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k",
}


@pytest.fixture
def shuffled(spark):
    before = {k: spark.conf.get(k, None) for k in SHUFFLED}
    for k, v in SHUFFLED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_and_missing_keys_are_spread_over_tasks(shuffled, tmp_path, frames):
    """A third of the rows has one key and a third none, yet no task joins that many."""
    spark = shuffled
    key = F.when(F.col("id") % 3 == 0, "k0").when(F.col("id") % 3 == 2, F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    rows = spark.range(0, 300_000, 1, 48).select("id", key.alias("k"))
    out = lookup_join(rows, frames[1], ["k"], flag="hit")
    held = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 300_000
    assert max(held) < 50_000


def test_two_column_keys_and_chains(frames):
    rows, dim = frames
    pairs = rows.where("k is not null").select("k", "j").distinct().withColumn("p", F.concat_ws("/", "k", "j"))
    out = lookup_joins(rows, [(dim, ["k"], "a"), (pairs, ["k", "j"], "b")]).collect()
    assert len(out) == 3000
    assert all(r["b"] == (r["k"] is not None) and (r["p"] == f"{r['k']}/{r['j']}" if r["b"] else r["p"] is None) for r in out)
    assert sorted((r["id"], r["v"], r["a"]) for r in out) == brute(rows, dim)


def test_first_per_key_is_planned_with_a_map_side_limit(frames):
    rows, _ = frames
    out = first_per_key(rows.where("k is not null"), ["k"], [F.col("id").desc()])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["id"] for r in out.collect()}["k0"] == 2997


def test_merge_by_key(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "k string, b int")
    assert sorted(merge_by_key(a, b, "k").collect()) == [("x", 1, None), ("y", 2, 3), ("z", None, 4)]


def test_bucketed_history_join_has_no_exchange(spark):
    from payouts.operators.history import paid_history_join, paid_summary
    from payouts.plans.settlement import paid_history_bucketed

    rows = spark.createDataFrame([(i, f" ch{i % 7}") for i in range(60)] + [(99, None)], "row_id long, nro_chassi string")
    ledger = spark.createDataFrame([(f"CH{i % 5}", float(i - 3)) for i in range(20)], "nro_chassi string, valor_comissao_total double")
    paid = paid_summary(ledger)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = paid_history_bucketed(rows, paid, 4)
        got = sorted(tuple(r) for r in joined.collect())
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert got == sorted(tuple(r) for r in paid_history_join(rows, paid).collect())
