import json
import math

import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pyarrow.ipc
import pytest
from pyspark.sql import functions as F

import plumbline
from plumbline import cli
from plumbline.errors import ConfigurationError, PlumblineError, UnsupportedDataError
from plumbline.operators import check as K
from plumbline.operators import numeric, quantiles
from plumbline.plans import profile as P
from plumbline.plans.kinds import classify, unique_names
from plumbline.plans.together import together
from plumbline.report import format, html
from plumbline.report.glossary import MEANING
from plumbline.sources import readers, sinks
from plumbline.suite import sources

FAST = {"correlations": False}


@pytest.fixture(scope="module")
def frame():
    n = 300
    return pd.DataFrame(
        {
            "id": range(n), "amount": [None if i % 30 == 0 else (i * 37 % 101) / 4 for i in range(n)], "region": ["north", "south", None][0:2] * (n // 2), "flag": [i % 3 == 0 for i in range(n)],
            "day": pd.date_range("2024-01-01", periods=n, freq="h"), "zero_one": [i % 2 for i in range(n)], "text_day": [f"2024-02-{i % 28 + 1:02d}" for i in range(n)], "text_number": [str(i / 7) for i in range(n)], "empty": [None] * n,
        }
    )


@pytest.fixture(scope="module")
def stats(spark, frame):
    return plumbline.summarize(frame)


def test_payload_keys_and_kinds(stats):
    cols = stats["columns"]
    kinds = {c: s["type"] for c, s in cols.items()}
    assert kinds == {"id": "identifier", "amount": "numeric", "region": "categorical", "flag": "boolean", "day": "datetime", "zero_one": "boolean", "text_day": "datetime", "text_number": "numeric", "empty": "categorical"}
    assert {t: len(cols[c]) for t, c in (("numeric", "amount"), ("categorical", "region"), ("datetime", "day"), ("boolean", "flag"))} == {"numeric": 48, "categorical": 21, "datetime": 21, "boolean": 10}
    assert stats["schema_version"] == 2 and stats["dataset"]["rows_est"] == 300
    json.dumps(sinks.plain(stats), allow_nan=False)


def test_payload_values(stats, frame):
    a, want = stats["columns"]["amount"], frame["amount"].dropna()
    for got, expected in ((a["mean"], want.mean()), (a["std"], want.std()), (a["median"], want.median()), (a["q1"], want.quantile(0.25)), (a["min"], want.min()), (a["unique_est"], want.nunique())):
        assert math.isclose(got, expected, rel_tol=1e-12)
    assert (a["count"], a["missing"]) == (290, 10) and sum(a["true_histogram_counts"]) == 290
    assert stats["columns"]["day"]["avg_interval_seconds"] == 3600 and stats["columns"]["day"]["mono_inc"]
    e = stats["columns"]["empty"]
    assert (e["count"], e["missing"], e["entropy"]) == (0, 300, None)
    assert stats["columns"]["id"]["min_items"][0] == (0, 0.0)


def test_partitioning_changes_nothing(spark, frame, stats):
    df = readers.read(frame)
    for n in (1, 5):
        assert sinks.plain(plumbline.summarize(df.repartitionByRange(n, "id"), order_by=["id"])["columns"]["amount"]["median"]) == stats["columns"]["amount"]["median"]


def test_degenerate_frames(spark):
    for df in (spark.createDataFrame([], "a long, b string"), spark.createDataFrame([(1, "x")], "a long, b string"), spark.createDataFrame([(None, None)] * 3, "a double, b timestamp"), spark.range(10).select(), spark.createDataFrame([(5.0,)] * 9, "a double")):
        s = plumbline.summarize(df)
        assert s["dataset"]["rows_est"] == df.count() and len(s["columns"]) == len(df.columns)


def test_page(spark, frame):
    report = plumbline.profile(frame.head(60), title="<b>T</b>", **FAST)
    assert "&lt;b&gt;T&lt;/b&gt;" in report.html and "<b>T" not in report.html
    assert all(f'data-name="{c}"' in report.html for c in frame.columns)
    flags = [r["flag"] for r in P.flag_table(spark, report.stats).collect()]
    assert flags and all(MEANING[f].replace("'", "&#x27;") in report.html for f in flags)
    assert 'id="cards" data-size="50"' in report.html and 'contenteditable="true"' in report.html


def test_axes_units_and_shares():
    assert [format.unit(c) for c in ("price_usd", "waitMs", "kg_total", "total", "x_days", "")] == ["USD", "ms", "kg", "", "days", ""]
    s = {"true_histogram_edges": [0.0, 1.0, 2.0], "true_histogram_counts": [30, 10], "q1": 0.5, "q3": 0.9, "iqr": 0.4}
    chart = html.histogram("wait_ms", s)
    assert chart.count("<rect") == 2 and chart.count('class="fence"') == 1 and ">ms</text>" in chart and chart.endswith("</svg>")
    assert html.histogram("x", {**s, "true_histogram_edges": [], "iqr": None}) == ""
    assert html.kinds_bar({"numeric": (3, 75), "boolean": (1, 25)}).count("<rect") == 2
    with pytest.raises(ConfigurationError):
        plumbline.RenderOptions(columns_per_page=0)


def test_compare_and_check(spark, frame, stats, tmp_path):
    same = plumbline.compare(stats, stats)
    assert not same.schema.changed and same.moved == []
    other = frame.assign(amount=frame["amount"] + 100, region="west", new=1).drop(columns=["empty"]).head(200)
    now = plumbline.summarize(other, **FAST)
    diff = plumbline.compare(stats, now)
    assert list(diff.schema.added) == ["new"] and list(diff.schema.removed) == ["empty"]
    assert diff.columns["amount"].mean_shift_sigma > 1 and diff.columns["region"].values_entered == ("west",)
    assert "amount" in diff.render()
    K.write_baseline(tmp_path / "b.json", sinks.plain(stats))
    result = plumbline.check(now, str(tmp_path / "b.json"), K.Thresholds(min_rows=250, max_rows_drift_pct=10, max_age="1d", fail_on_new_column=True, fail_on_range_expansion=True, require_max_ts_advances=True, max_duplicate_pct=0.0))
    assert {f.kind for f in result.findings} >= {"rows", "schema", "distribution", "range", "freshness"}
    assert plumbline.check(stats, stats, K.Thresholds()).passed
    assert result.to_frame(spark).count() == len(result.findings)
    (tmp_path / "old.json").write_text(json.dumps({"baseline_version": 0}))
    with pytest.raises(PlumblineError):
        K.read_baseline(tmp_path / "old.json")


def test_thresholds():
    assert [K.seconds(v) for v in ("26h", "90m", "45s", "2w", 7)] == [93600, 5400, 45, 1209600, 7]
    for bad in ("soon", "5y"):
        with pytest.raises(ConfigurationError):
            K.seconds(bad)
    with pytest.raises(ConfigurationError):
        K.Thresholds.from_mapping({"nope": 1})
    assert K.Thresholds(max_unique_drift_pct=0.5).notes()


def test_sources(spark, frame, tmp_path):
    small = frame[["id", "amount", "region"]]
    table = pa.Table.from_pandas(small)
    small.to_parquet(tmp_path / "a.parquet")
    small.to_csv(tmp_path / "a.csv", index=False)
    small.to_json(tmp_path / "a.json", orient="records")
    small.to_json(tmp_path / "a.jsonl", orient="records", lines=True)
    pyarrow.feather.write_feather(table, tmp_path / "a.feather", compression="uncompressed")
    with pa.OSFile(str(tmp_path / "a.ipc"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table, max_chunksize=70)
    import duckdb

    kinds = [str(tmp_path / f"a.{s}") for s in ("parquet", "csv", "json", "jsonl", "feather", "ipc")]
    others = [small, table, table.to_batches()[0], table.to_reader(), duckdb.from_arrow(table), [small.head(150), small.tail(150)], spark.createDataFrame(table)]
    for source in (*kinds, *others):
        df = readers.read(source)
        assert df.count() == 300 and sorted(df.columns) == sorted(small.columns), source
        assert df.agg({"amount": "sum"}).first()[0] == pytest.approx(small["amount"].sum())
    assert sum(t.num_rows for t in readers.chunks(small, 128)) == 300
    for bad, error in ((str(tmp_path / "none.csv"), PlumblineError), (5, UnsupportedDataError), ("/etc/hostname", UnsupportedDataError)):
        with pytest.raises(error):
            readers.read(bad)
    with pytest.raises(ValueError):
        readers.read(None)


def test_names_options_and_forced_kinds(spark):
    assert unique_names(["a", "a", "b", "a_1", "a"]) == ["a", "a_2", "b", "a_1", "a_3"]
    df = spark.createDataFrame([(i % 2, str(i)) for i in range(200)], "a int, b string")
    assert [p.kind for p in classify(df)] == ["boolean", "numeric"]
    forced = plumbline.ComputeOptions(force_column_types={"a": "numeric", "b": "categorical"})
    assert [p.kind for p in classify(df, forced)] == ["numeric", "categorical"]
    assert [p.kind for p in classify(spark.createDataFrame([(i % 9,) for i in range(200)], "a int"))] == ["categorical"]
    for bad in ({"nope": 1}, {"sample": 0}):
        with pytest.raises(ConfigurationError):
            plumbline.summarize(df, **bad)
    with pytest.raises(ConfigurationError):
        plumbline.summarize(df, preset="slow")
    with pytest.warns(DeprecationWarning):
        assert plumbline.ReportConfig is plumbline.ProfileConfig


def test_command_line(spark, frame, tmp_path, capsys):
    path = str(tmp_path / "d.parquet")
    frame[["id", "region"]].to_parquet(path)
    assert cli.main(["summarize", path, "--quiet"]) == 0
    assert json.loads(capsys.readouterr().out)["dataset"]["rows_est"] == 300
    assert cli.main(["profile", path, "-o", str(tmp_path / "d.html"), "--quiet"]) == 0
    assert cli.main(["check", path, "--write-baseline", str(tmp_path / "b.json")]) == 0
    (tmp_path / "t.toml").write_text("[tool.x.check]\nmin_rows = 1000\n")
    assert cli.main(["check", path, "--baseline", str(tmp_path / "b.json"), "--thresholds", str(tmp_path / "t.toml"), "--json"]) == 1
    assert cli.main(["check", path, "--thresholds", str(tmp_path / "t.toml"), "--warn-only"]) == 0
    assert cli.main(["check", path, "--thresholds", str(tmp_path / "t.toml"), "--min-rows", "300", "-q"]) == 0
    assert cli.main(["check", path, "--min-rows", "301", "--fail-on-new-column", "-q"]) == 1
    assert cli.main(["check", path, "--max-age", "soon"]) == 2 and cli.main(["check", path, "--max-missing-pct", "-1"]) == 2
    assert cli.main(["--version"]) == 0 and "plumbline" in capsys.readouterr().out
    assert cli.main(["check", str(tmp_path / "none.parquet")]) == 2
    assert cli.main(["nonsense"]) == 2


def test_jobs_do_not_grow_with_columns(spark):
    def jobs(n):
        df = spark.range(500).select(*[(F.col("id") * (i + 3) % 401 + 0.5).alias(f"n{i}") for i in range(n)], *[F.concat(F.lit("t"), F.col("id") % (60 + i)).alias(f"t{i}") for i in range(n)])
        df = df.select("*", *[F.timestamp_seconds(F.col("n0") * (i + 1)).alias(f"d{i}") for i in range(n)])
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
        plumbline.summarize(df, correlations=False)
        return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before

    assert abs(jobs(1) - jobs(6)) <= 1


def test_order_of_files_of_unequal_size(spark, tmp_path):
    spark.range(0, 1000).coalesce(1).write.parquet(f"file://{tmp_path}/a")
    spark.range(1000, 100_000).coalesce(1).write.parquet(f"file://{tmp_path}/b")
    df = spark.read.parquet(f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    column = plumbline.summarize(df)["columns"]["id"]
    assert column["mono_inc"] and not column["mono_dec"] and column["type"] == "identifier"
    assert column["min_items"][0] == (0, 0.0) and column["max_items"][0] == (99_999, 99_999.0)
    dealt = plumbline.summarize(df.repartition(3))["columns"]["id"]  # has no order any more
    assert dealt["mono_inc"] is None and dealt["min_items"][0] == (None, 0.0)


def test_steps_of_all_values(spark):
    df = spark.range(225_000).select(F.when(F.col("id") < 25_000, F.col("id").cast("double")).otherwise(25_000 + 0.25 * (F.col("id") - 25_000)).alias("x"))
    (got,) = numeric.granularity(df, {"x": F.col("x")}).collect()
    assert 0.25 <= got.gran_step < 0.27  # the middle of the fullest of fifty bins from 0.25 to 1


def test_quantiles_that_need_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "READABLE", 50)
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 30_011).cast("double")).alias("x"))
    values = sorted(r.x for r in df.collect())
    at = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = quantiles.quantiles(df, {"x": F.col("x")}, at)["x"]
    assert all(math.isclose(got[p], float(pd.Series(values).quantile(p)), rel_tol=1e-12) for p in at)
    (d,) = numeric.deviations(df, {"x": F.col("x")}).collect()
    far = (pd.Series(values) - pd.Series(values).median()).abs()
    assert math.isclose(d.mad, far.median(), rel_tol=1e-12) and d.outliers_mod_zscore == int((0.6745 * far / far.median() > 3.5).sum())


def test_sources_are_read_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(readers, "HELD", 1000)
    schema = pa.schema([("i", pa.int64()), ("t", pa.string())])
    pieces = (pa.record_batch([pa.array(range(k * 100, k * 100 + 100)), pa.array(["x"] * 100)], schema=schema) for k in range(12))
    df = readers.read(pa.RecordBatchReader.from_batches(schema, pieces))
    assert df.count() == 1200 and df.agg(F.sum("i")).first()[0] == sum(range(1200))
    frames = (pd.DataFrame({"i": range(k * 100, k * 100 + 100), "u": [None] * 100 if k < 5 else [1.5] * 100}) for k in range(9))
    df = readers.read(frames)
    assert df.count() == 900 and df.agg(F.sum("u")).first()[0] == 600


def test_chunks_are_tables_of_a_size(spark):
    df = spark.range(0, 1000, numPartitions=3).select("id", F.array("id").alias("list"), F.when(F.col("id") % 2 == 0, "x").alias("t"))
    found = list(readers.chunks_with_metrics(df, 300))
    assert [m["rows"] for _, m in found] == [300, 300, 300, 100] and [m["start_row"] for _, m in found] == [0, 300, 600, 900]
    whole = pa.concat_tables([t for t, _ in found])
    assert whole.column("id").to_pylist() == list(range(1000)) and whole.column("list")[7].as_py() == [7] and whole.column("t").null_count == 500
    assert sum(t.num_rows for t in readers.chunks(df)) == 1000 and list(readers.chunks(df.limit(0), 5)) == []
    with pytest.raises(UnsupportedDataError):
        next(readers.chunks(df, 0))


def test_snapshots_and_checked_thresholds(spark, tmp_path):
    compute = plumbline.ComputeOptions(checkpoint_every_n_chunks=1, checkpoint_dir=str(tmp_path / "c"), checkpoint_max_to_keep=2, checkpoint_write_html=True, compute_correlations=False)
    plumbline.summarize(spark.range(20).select("id", F.lit("a").alias("t")), plumbline.ProfileConfig(compute=compute))
    assert len(list((tmp_path / "c").glob("*.json"))) == 2 and len(list((tmp_path / "c").glob("*.html"))) == 2
    for bad in ({"max_missing_pct": "5"}, {"min_rows": -3}, {"fail_on_new_column": "no"}, {"max_age": -1}):
        with pytest.raises(ConfigurationError):
            K.Thresholds.from_mapping(bad)
    (tmp_path / "t.txt").write_text("{}")
    with pytest.raises(ConfigurationError):
        K.Thresholds.from_file(tmp_path / "t.txt")


def test_kinds_of_texts_are_of_all_rows(spark):
    df = spark.range(0, 30_000, numPartitions=4).select(
        F.when(F.col("id") < 12_000, "2024-01-05").otherwise("none").alias("first_days"), F.when(F.col("id") < 12_000, "none").otherwise("2024-01-05 10:00:00").alias("later_times"),
        F.when(F.col("id") < 1_000, "none").otherwise("2024-01-05T10:00:00.5+01:00").alias("with_zone"), F.repeat(F.lit("1234 5"), 1_000).alias("long"), F.lit(None).cast("string").alias("nothing"), F.lit("0099-01-01").alias("too_early"),
    )
    found = {p.name: p.kind for p in classify(df)}
    assert found == {"first_days": "categorical", "later_times": "categorical", "with_zone": "datetime", "long": "categorical", "nothing": "categorical", "too_early": "categorical"}
    assert {p.kind for p in classify(df.limit(0))} == {"categorical"}
    with pytest.raises(ConfigurationError):
        plumbline.ComputeOptions(inference="wild")


def test_whole_numbers_as_texts_are_no_years(spark):
    df = spark.range(200).select(
        F.when(F.col("id") % 4 > 0, (F.col("id") + 12_000).cast("string")).alias("keys_and_gaps"), F.concat(F.lit(" +"), (F.col("id") + 1_000_000).cast("string")).alias("signed"),
        F.when(F.col("id") % 9 > 0, "20240131").otherwise("12345").alias("days"),
    )
    plans = {p.name: p for p in classify(df)}
    assert {c: p.kind for c, p in plans.items()} == {"keys_and_gaps": "categorical", "signed": "numeric", "days": "datetime"}
    assert df.select(plans["days"].values.alias("t")).filter("t is null").count() == 23


def test_positions_of_rows_that_are_sorted_over_several_partitions(spark):
    df = spark.range(0, 500_000, numPartitions=8).select(((F.col("id") * 7919) % 500_000).alias("k"))
    df = df.select("k", F.when(F.col("k") % 4_000 >= 900, F.col("k") + 0.5).alias("v"))
    summary = P.payload(df, plumbline.ComputeOptions(compute_correlations=False, order_by=["k"], chunk_size=1_000))
    assert summary["dataset"]["missing_by_position"]["v"]["chunks"] == [(a, a + 999, 900 if a % 4_000 == 0 else 0) for a in range(0, 500_000, 1_000)]
    assert summary["columns"]["v"]["max_items"] == [(i, i + 0.5) for i in range(499_999, 499_994, -1)]


def test_missing_by_position_has_all_chunks(spark):
    df = spark.range(0, 5_000, numPartitions=3).select("id", F.when(F.col("id") % 2_000 >= 450, F.col("id") + 0.5).alias("v"))
    places = P.missing_by_position(df.withColumn("__row_index", F.col("id")), ["v"], 2)
    assert places["v"]["chunks"] == [(a, a + 1, 2 if a % 2_000 < 450 else 0) for a in range(0, 5_000, 2)] and places["v"]["finding"] == "gap"
    summary = P.payload(df.select("v"), plumbline.ComputeOptions(compute_correlations=False, chunk_size=4))
    assert len(summary["dataset"]["missing_by_position"]["v"]["chunks"]) == 1_250
    drawn = html.strip(places["v"]["chunks"])
    assert drawn.count("<rect") <= 360 and "rows 0 to 13: 14<" in drawn and "rows 14 to 27: 14<" in drawn


def test_extremes_are_kept_by_tasks_before_they_are_ranked(spark):
    rows = [(i, None if i % 7 == 0 else float("nan") if i % 11 == 0 else float("-inf") if i % 13 == 0 else (i * 37 % 50) / 4 - 3, None) for i in range(3_000)]
    df = spark.createDataFrame(rows, "i long, v double, none double").repartition(5)
    found = numeric.extremes(df, {"v": F.col("v"), "none": F.col("none")}, F.col("i"))
    finite = [(v, i) for i, v, _ in rows if v is not None and math.isfinite(v)]
    want = {("v", side, k + 1, v, i) for side, sign in (("min", 1), ("max", -1)) for k, (v, i) in enumerate(sorted(finite, key=lambda r: (sign * r[0], r[1]))[:5])}
    assert {tuple(r) for r in found.collect()} == want
    unplaced = numeric.extremes(df, {"v": F.col("v")}, F.lit(None).cast("long")).collect()
    assert sorted((r.side, r.rank, r.value) for r in unplaced) == sorted((side, k, v) for _, side, k, v, _ in want) and {r.row_index for r in unplaced} == {None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and plan.index("Window ") < plan.index("MapInArrow") and "Generate" not in plan


def test_ordered_files_are_written_by_all_tasks_of_the_sort(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = sources.src_order(spark, "/root/testdata/sf0.01")
        assert len(df.inputFiles()) > 4
        assert df.filter("o_orderkey <> row_index").count() == 0 and df.agg(F.count("row_index"), F.max("row_index")).first() == (15_000, 14_999)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_jobs_together_end_before_an_error_is_raised(spark):
    ended = []
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1 / 0, lambda: ended.append(spark.range(10).count()))
    assert ended == [10] and together(spark, lambda: 1, lambda: 2) == [1, 2]


def test_long_texts_are_counted_by_digests(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "1",)] * 3 + [(long + "2",)] * 2 + [("short",)] * 4 + [(None,)], "t string")
    found = plumbline.summarize(df, correlations=False)["columns"]["t"]
    assert found["top_items"] == [("short", 4), (long + "1", 3), (long + "2", 2)] and found["unique_est"] == 3 and found["missing"] == 1
