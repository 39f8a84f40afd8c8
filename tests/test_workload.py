"""Every registered query against its SQL; work folders."""

import pytest

import __spark_entry__ as entry
from tripmart.workload import registry
from check_sql import compare, connect
from tripmart import session

QUERIES, SQL = registry.QUERIES, registry.SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, sf_dir, name):
    assert name in SQL
    assert compare(spark, con, QUERIES[name], SQL[name], sf_dir) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_python_functions_in_plans(spark, sf_dir):
    for name in ("silver_rides", "fact_rides", "audit_summary", "asof_history", "scd2_history"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_work_dir_takes_the_shared_folder(spark):
    if spark.conf.get(session.CHECKPOINT_CONF, None):
        assert session.work_dir(spark, "x").startswith(spark.conf.get(session.CHECKPOINT_CONF))
    else:
        assert session.work_dir(spark, "x").startswith("/tmp/")
    assert session.work_dir(spark, "x") != session.work_dir(spark, "x")


def test_work_dir_is_refused_on_a_cluster_without_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.work_dir(Session(), "x")


def test_rides_are_made_where_they_are_read(spark, tmp_path):
    """No layer is stored beside the line items, and parts do not grow with the table."""
    from pyspark.sql import functions as F

    from tripmart.workload import inputs

    lines = spark.range(40).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 3).alias("l_partkey"), (F.col("id") % 2).alias("l_suppkey"),
        F.lit(1).cast("int").alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.lit(9.0).alias("l_extendedprice"),
        F.lit(0.05).alias("l_discount"), F.lit(0.01).alias("l_tax"), F.lit("A").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.lit("2024-01-01").cast("timestamp_ntz").alias("l_shipdate"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    files = {f.split("/lineitem.parquet/")[0] for rows in (inputs.rides, inputs.silver_rides, inputs.fact)
             for f in rows(spark, str(tmp_path)).inputFiles()}
    assert len(files) == 1 and files.pop().endswith(str(tmp_path))
    assert inputs.fact(spark, str(tmp_path)).count() == 40
    dealt = inputs.spread(lines, "l_orderkey", rows_per_task=5)
    assert dealt.rdd.getNumPartitions() == 8 and dealt.count() == 40


def test_kept_is_computed_once(spark):
    from pyspark.sql import functions as F

    from tripmart.operators.sizing import kept

    rows = kept(spark.range(50).withColumn("x", F.rand()))
    assert sorted(rows.collect()) == sorted(rows.collect()) and rows.inputFiles()


def _ride_lines(spark, n):
    """Line items of n // 2 orders, two rows each, of five suppliers; some without an order."""
    from pyspark.sql import functions as F

    return spark.range(n).select(
        F.when(F.col("id") % 10 > 0, F.col("id") % (n // 2)).alias("l_orderkey"), (F.col("id") % 3).alias("l_partkey"),
        (F.col("id") % 5).alias("l_suppkey"), F.lit(1).cast("int").alias("l_linenumber"), F.lit(2.0).alias("l_quantity"),
        F.lit(9.0).alias("l_extendedprice"), F.lit(0.05).alias("l_discount"), F.lit(0.01).alias("l_tax"),
        F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("l_shipdate"))


def test_fact_shuffles_line_items_only(spark, tmp_path):
    """The rides of one id meet when the line items are dealt; whole rides are not shuffled again."""
    from tripmart.plans import gold
    from tripmart.workload import inputs

    _ride_lines(spark, 60).write.parquet(f"{tmp_path}/lineitem.parquet")
    fact = inputs.fact(spark, str(tmp_path))
    plan = fact._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(concat(R" in plan
    want = gold.fact_rides(inputs.silver_rides(spark, str(tmp_path)))
    assert sorted(fact.collect(), key=str) == sorted(want.collect(), key=str) and fact.count() == 27


@pytest.mark.parametrize("name", ["audit_passengers", "audit_status", "audit_summary", "audit_versions",
                                  "cancel_rate_booking_hour", "cancel_rate_pickup_city_id"])
def test_queries_on_the_fact_shuffle_rides_once(spark, sf_dir, name):
    """Every shuffle by the ride is that of the narrow line items; what follows is counted or looked up."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(concat(R") == 1
    assert "Exchange hashpartitioning(ride_id" not in plan and "Exchange RoundRobin" not in plan
    assert "Exchange hashpartitioning(l_" not in plan


def test_rides_of_a_person_are_dealt_to_few_tasks(spark, tmp_path):
    """The rows that the map side of a person dimension sends grow with the persons, not with persons times tasks."""
    from pyspark.sql import functions as F

    from tripmart.plans import gold
    from tripmart.workload import inputs

    lines = _ride_lines(spark, 2000)
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, key in (("dim_vehicle", "vehicle_id"), ("dim_driver", "driver_id"), ("dim_booker", "booker_id")):
        dealt = inputs.spread(lines, *inputs.person_keys(name), rows_per_task=20)
        tasks = dealt.select(inputs.ride_keys()[key].alias("k"), F.spark_partition_id().alias("task")).distinct().groupBy("k").agg(
            F.count("*").alias("n"))
        assert dealt.rdd.getNumPartitions() == 100 and tasks.agg(F.max("n")).first()[0] <= inputs.TASKS_PER_PERSON
        want = gold.person_dim(inputs.silver_rides(spark, str(tmp_path)), name)
        assert sorted(inputs.person_dim(spark, str(tmp_path), name).collect(), key=str) == sorted(want.collect(), key=str)
        plan = inputs.person_dim(spark, str(tmp_path), name)._jdf.queryExecution().executedPlan().toString()
        assert f"Exchange hashpartitioning(concat({key[0].upper()}" in plan


def test_stored_dimensions_are_zstd(spark, tmp_path):
    import uuid

    from tripmart.plans.tables import save_bucketed
    from tripmart.workload import inputs

    _ride_lines(spark, 60).write.parquet(f"{tmp_path}/lineitem.parquet")
    dim, name = inputs.dim(spark, str(tmp_path), "dim_booker"), f"zstd_{uuid.uuid4().hex[:8]}"
    save_bucketed(dim, name, "booker_id", 2, f"{tmp_path}/bucketed")
    for rows in (dim, spark.table(name)):
        assert rows.count() == 3 and all(f.endswith(".zstd.parquet") for f in (x.split("/")[-1].replace(".c000", "") for x in rows.inputFiles()))
    spark.sql(f"DROP TABLE {name}")


def test_rides_of_a_driver_and_of_a_booker_lie_together(spark, tmp_path):
    """What is written of rides compresses by what neighbours share, so parts have few drivers, and no row is lost for it."""
    from pyspark.sql import functions as F

    from tripmart.workload import inputs

    lines = _ride_lines(spark, 400).withColumn("l_suppkey", F.when(F.col("l_suppkey") < 4, F.hash("l_shipdate") % 100))
    lines.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    rides = inputs.rides(spark, str(tmp_path))
    want = inputs.raw_rides(lines)
    assert sorted(rides.collect(), key=str) == sorted(want.collect(), key=str) and rides.count() == 400
    placed = rides.where("driver_id IS NOT NULL").select("driver_id", F.spark_partition_id().alias("part"))
    parts = placed.groupBy("driver_id").agg(F.count_distinct("part").alias("n"))
    assert parts.where("n > 1").count() <= rides.rdd.getNumPartitions() < parts.count() // 2
    for order, first in ((inputs.BY_BOOKER, "booker_id"), (inputs.BY_DRIVER, "driver_id")):
        rows = inputs.rides(spark, str(tmp_path), order).withColumn("part", F.spark_partition_id()).collect()
        for part in {r.part for r in rows}:
            ids = [int(r[first][1:]) for r in rows if r.part == part and r[first]]
            assert ids == sorted(ids)


def test_a_hot_driver_is_cut(spark):
    from pyspark.sql import functions as F

    from tripmart.workload import inputs

    lines = _ride_lines(spark, 2000).withColumn("l_suppkey", F.lit(7))
    dealt = inputs.gathered(lines, ["l_suppkey", "l_orderkey"], ["l_orderkey"], rows_per_task=250)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 1000 and sum(sizes) == 2000


def test_ride_star_moves_the_fact_for_no_proven_small_dimension(spark, sf_dir):
    """Labels above Spark's threshold are broadcast all the same, so only the line items of the fact are shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["ride_star"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for key in ("booker_id", "driver_id", "vehicle_id"):
        assert f"BroadcastHashJoin [{key}" in plan and f"Exchange hashpartitioning({key}" not in plan
