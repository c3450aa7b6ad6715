import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import ordered, quantiles
from plumbline.sources import sinks
from plumbline.streaming import state as S

SCHEMA = T.StructType([T.StructField("v", T.DoubleType()), T.StructField("k", T.StringType())])


def test_stream_in_batches_equals_the_whole(spark, tmp_path):
    rows = [(None if i % 9 == 0 else float("inf") if i % 50 == 3 else i * 1.5, f"k{i % 7}") for i in range(600)]
    inbox, seen = tmp_path / "in", []
    for part in range(4):
        spark.createDataFrame(rows[part * 150 : (part + 1) * 150], SCHEMA).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(SCHEMA).parquet(str(inbox))
        S.profile_stream(stream, str(tmp_path / "out"), ["v"], ["k"], seen.append).awaitTermination()  # goes on from its checkpoint
    assert [s["rows"] for s in seen] == [150, 300, 450, 600]
    got = {r.column_name: r for r in S.current(S.read_state(spark, str(tmp_path / "out/state"))).collect()}
    good = [v for v, _ in rows if v is not None and v != float("inf")]
    mean = sum(good) / len(good)
    v = got["v"]
    assert (v.rows, v.n, v.missing, v.inf, v["min"], v["max"]) == (600, len(good), 67, 12 - sum(1 for i in range(600) if i % 9 == 0 and i % 50 == 3), min(good), max(good))
    assert v["mean"] == pytest.approx(mean) and v.variance == pytest.approx(sum((x - mean) ** 2 for x in good) / (len(good) - 1))
    assert abs(v.p50 - sorted(good)[len(good) // 2]) < 0.05 * max(good)
    assert (got["k"].n, got["k"].unique_est) == (600, 7)


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None)], SCHEMA)
    for _ in range(2):
        S.write_batch(df, 0, str(tmp_path / "s"), ["v"], ["k"])
    assert {r.column_name: r.rows for r in S.current(S.read_state(spark, str(tmp_path / "s"))).collect()} == {"v": 2, "k": 2}


def test_late_rows_and_windows(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(minutes=m), float(m)) for m in range(0, 120, 10)], "t timestamp, v double")
    assert S.windowed_profile(df, "t", "v", "1 hour", "5 minutes").count() == 2
    assert S.windowed_profile(df, "t", "v", "1 hour", "5 minutes", slide="30 minutes").count() == 5


@pytest.mark.parametrize("n", [1, 2, 7, 20_000])
def test_exact_quantiles_of_hard_columns(spark, n):
    df = spark.range(n).select(
        (F.col("id") % 3).cast("double").alias("ties"), F.when(F.col("id") == 0, 1e300).otherwise(F.col("id") / 7).alias("far"), F.lit(4.0).alias("same"), F.exp(F.rand(5) * 60 - 30).alias("wide"), F.lit(None).cast("double").alias("none"),
    ).persist()
    at = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    names = ["ties", "far", "same", "wide"]
    got = quantiles.quantiles(df, {c: F.col(c) for c in [*names, "none"]}, at)
    want = df.agg(*[F.percentile(c, list(at)).alias(c) for c in names]).first()
    for c in names:
        assert [got[c][p] for p in at] == pytest.approx(want[c], rel=1e-12)
    assert set(got["none"].values()) == {None}
    df.unpersist()


def test_order_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select("id", (F.col("id") * 2.0).alias("up"), (-F.col("id")).cast("double").alias("down"), F.when(F.col("id") % 10 != 0, F.lit(1.0)).alias("flat"))
    got = {r.column_name: r for r in ordered.ordered_summary(df.repartition(5), ["up", "down", "flat"], ["id"]).collect()}
    assert (got["up"].mono_inc, got["up"].mono_dec, got["up"].gap_mean, got["up"].gap_std) == (True, False, 2.0, 0.0)
    assert got["down"].mono_dec and not got["down"].mono_inc
    assert got["flat"].mono_inc and got["flat"].mono_dec and got["flat"].n == 900
    assert [r.row_index for r in ordered.with_row_index(df).orderBy("id").collect()] == list(range(1000))


def test_rotation_keeps_the_newest(tmp_path):
    for i in range(5):
        (tmp_path / f"ck_{i}").write_text("x")
    assert len(sinks.rotate(tmp_path, "ck_", 2)) == 3
    assert len(list(tmp_path.iterdir())) == 2
