from pyspark.sql import functions as F

from slimctx.operators.skew import salted_join


def test_salted_join_equals_plain_join(spark):
    # one key holds half of the big side; nulls must survive a left join
    big = spark.range(0, 2000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hub")).when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("path"),
        F.col("id").alias("entry"))
    small = spark.createDataFrame([("hub", 1), ("hub", 7), ("k1", 2), ("k3", 3), ("zz", 4)], "path string, v int")
    for how in ("inner", "left"):
        a = sorted(map(tuple, salted_join(big, small, ["path"], how).collect()), key=str)
        b = sorted(map(tuple, big.join(small, ["path"], how).collect()), key=str)
        assert a == b


def test_hub_with_a_third_of_all_rows_is_spread(spark):
    big = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    rows = (big.withColumn("s", F.pmod(F.xxhash64(*big.columns), F.lit(8))).filter("k = 0")
            .groupBy("s").count().collect())
    assert len(rows) == 8 and max(r["count"] for r in rows) < 2 * 10000 / 8


def test_traversal_through_a_hub(spark):
    """A hub imported by a third of all files, at default settings."""
    from conftest import make_files

    from slimctx.plans.api import CorpusIndex
    files = {"h/hub.py": "def hub():\n    return 1\n"}
    for i in range(90):
        files[f"h/m{i}.py"] = ("from .hub import hub\n\n\n" if i % 3 == 0 else "") + \
            f"def m{i}():\n    return {'hub()' if i % 3 == 0 else 1}\n"
    idx = CorpusIndex(make_files(spark, files))
    nodes = idx.graph(idx.seeds(), 2).collect()
    assert sum(r.path == "h/hub.py" and r.depth == 1 for r in nodes) == 30
    bench, _ = idx.benchmark(idx.seeds())
    assert bench.count() == 91
