import random

from helpers import Components
from pyspark.sql import functions as F

from slimctx.llm import common as C


def test_components(spark):
    rnd = random.Random(11)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    edges = chain + [(rnd.randrange(150), rnd.randrange(150)) for _ in range(110)] + [(7, 7), (-5, 3)]
    edges += [(5000, 5000 + i) for i in range(300)]
    df = spark.createDataFrame(edges + edges[:5], "a long, b long")
    c = Components({x for e in edges for x in e})
    for a, b in edges:
        c.link(a, b)
    got = {r.node: r.root for r in C.components(df).collect()}
    for n in c.up:
        assert got.get(n, n) == c.find(n)
    assert C.components(df.limit(0)).count() == 0


def test_join_unique_with_a_hot_key(spark):
    big = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    side = big.groupBy("k").agg(F.count("*").alias("w"))
    got = C.join_unique(big, side, ["k"], "w", 20000)
    assert got.count() == 20000 and got.filter("k = 0").agg(F.max("w")).first()[0] == 6667


def test_let_and_ascii_lower(spark):
    df = spark.createDataFrame([("ÀbC",), ("XYZ",), (None,)], "t string")
    assert [r[0] for r in df.select(C.ascii_lower(F.col("t"))).collect()] == ["Àbc", "xyz", None]
    assert df.select(C.let(F.lit(3), lambda x: x * x)).first()[0] == 9


def test_text_buffers_of_slices():
    import pyarrow as pa
    data, off = C.text_buffers(pa.array(["skip", "é", None, "", "ab"]).slice(1))
    assert off.tolist() == [0, 2, 2, 2, 4] and bytes(data) == "éab".encode()
