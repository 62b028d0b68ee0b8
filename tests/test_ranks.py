"""Row numbers by ranges: against a window, with a hot key, and at the edges."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.operators import ranks
from rostrum.operators import windows as N


def _hot(spark):
    key = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 70).cast("string")))
    return spark.range(5000).select(key.alias("key"), F.when(F.col("id") % 7 > 0, (F.col("id") * 7919) % 97).alias("v"), "id", F.lit("x").alias("rank"))


def test_numbers_equal_a_window(spark):
    df = _hot(spark)
    got = ranks.numbered(df, ["key"], ["v", F.col("id")], total="n")
    assert got.columns == ["key", "v", "id", "rank", "n"]
    by = W.partitionBy("key")
    want = df.withColumn("rank", F.row_number().over(by.orderBy("v", "id"))).withColumn("n", F.count(F.lit(1)).over(by))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    chunks = N.chunked(df, ["key"], ["v", "id"], 7)
    size = F.ceil(F.count(F.lit(1)).over(by) / 7)
    plain = df.withColumn("chunk", F.floor((F.row_number().over(by.orderBy("v", "id")) - 1) / size).cast("int"))
    assert sorted(map(str, chunks.collect())) == sorted(map(str, plain.collect()))


def test_hot_key_is_spread(spark):
    """No task numbers more than its share of the key that has most rows."""
    seen = []
    real = ranks.written

    def kept(df, name):
        out = real(df, name)
        seen.append((name, out))
        return out

    ranks.written = kept
    try:
        ranks.numbered(_hot(spark), ["key"], ["v", "id"]).count()
    finally:
        ranks.written = real
    ranged = next(df for name, df in seen if name == "ranges")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in ranged.groupBy("_part").count().collect()) <= 2 * 5000 / parts


def test_edges(spark):
    df = _hot(spark).limit(50)
    everything = ranks.numbered(df, [], ["id"]).orderBy("id").collect()
    assert [r["rank"] for r in everything] == list(range(1, 51))
    assert ranks.numbered(df.where("false"), ["key"], ["id"]).count() == 0
    repeated = ranks.numbered(df.withColumn("id", F.lit(1)), ["id"], ["id"]).select("rank").collect()
    assert sorted(r[0] for r in repeated) == list(range(1, 51))
