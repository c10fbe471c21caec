"""Readers and sinks round trips, versions, and streams against batches."""

import pytest
from pyspark.sql import functions as F

from gridindex.operators import tables
from gridindex.sources import readers, sinks
from gridindex.sources.registry import Registry
from gridindex.streaming import events


def test_readers(spark, tmp_path):
    (tmp_path / "a_35.csv").write_text("H3_ID,V\nx,1\n", encoding="utf-8")
    (tmp_path / "a_41.csv").write_text("H3_ID,V\ny,2\n", encoding="utf-8")
    df = readers.with_region_from_filename(readers.read_csv_set(spark, f"{tmp_path}/a_*.csv", ["h3_id", "v"]))
    assert {(r.h3_id, r.cd_uf, r.sigla_uf) for r in df.collect()} == {("x", 35, "SP"), ("y", 41, "PR")}
    (tmp_path / "b_35.csv").write_text("V,H3_ID,more\n3,z,0\n", encoding="utf-8")  # another order, more columns
    (tmp_path / "b_41.csv").write_text("\ufeffh3_id;v\nw;4\n", encoding="utf-8")  # another delimiter and a mark
    both = readers.read_csv_set(spark, f"{tmp_path}/[ab]_*.csv", ["h3_id", "v"])
    assert {(r.h3_id, r.v, r.file_name) for r in both.collect()} == {("x", "1", "a_35.csv"), ("y", "2", "a_41.csv"), ("z", "3", "b_35.csv"), ("w", "4", "b_41.csv")}
    with pytest.raises(FileNotFoundError):
        readers.read_csv_set(spark, f"{tmp_path}/none_*.csv", ["v"])
    with pytest.raises(ValueError, match="w"):
        readers.read_csv_columns(spark, f"{tmp_path}/a_35.csv", ["w"])
    (tmp_path / "latin.csv").write_bytes("cd_mun;nome\n1;São\n".encode("latin-1"))
    assert readers.sniff_delimiter(spark, f"{tmp_path}/latin.csv") == ";"
    assert readers.read_csv_fallback(spark, f"{tmp_path}/latin.csv", ["cd_mun", "nome"]).head()[:] == ("1", "São")
    (tmp_path / "late.csv").write_bytes(b"cd_mun;nome\n" + b"1;Sao\n" * 3000 + "2;São\n".encode("latin-1"))  # the first odd byte comes late
    assert readers.read_csv_fallback(spark, f"{tmp_path}/late.csv", ["cd_mun", "nome"]).filter("cd_mun = '2'").head()[:] == ("2", "São")
    (tmp_path / "late8.csv").write_text("cd_mun,nome\n" + "1,Sao\n" * 3000 + "2,São\n", encoding="utf-8")
    assert readers.read_csv_fallback(spark, f"{tmp_path}/late8.csv", ["cd_mun", "nome"]).filter("cd_mun = '2'").head()[:] == ("2", "São")
    (tmp_path / "again.csv").write_bytes("A;1\nConta;Valor\nz\nConta;Valor\nA;1\nConta;Valor\nz\n".encode("latin-1"))  # data like the lines before the header
    assert [r[:] for r in readers.read_csv_preamble(spark, f"{tmp_path}/again.csv").collect()] == [("A", "1"), ("Conta", "Valor"), ("z", None)]
    with pytest.raises(ValueError, match="no header"):
        readers.read_csv_preamble(spark, f"{tmp_path}/again.csv", 9)
    (tmp_path / "pre.csv").write_bytes("x\ny\nz\nConta;Valor\nA;1,5\nB;2\n".encode("latin-1"))
    assert [r[:] for r in readers.read_csv_preamble(spark, f"{tmp_path}/pre.csv").orderBy("Conta").collect()] == [("A", "1,5"), ("B", "2")]
    (tmp_path / "2001.csv").write_text("lat,lon\n1,2\n")
    df, found = readers.read_years(spark, f"{tmp_path}/{{year}}.csv", 2000, 2003, ["lat", "lon"])
    assert found == [2001] and df.head().year == 2001
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    sinks.save_table(nan, f"{tmp_path}/t")
    assert sorted(r.v is None for r in readers.read_table(spark, f"{tmp_path}/t").collect()) == [False, True]
    assert readers.select_existing(nan, ["v", "w"]).columns == ["v"]


def test_versions_and_runs(spark, tmp_path):
    v = lambda n: sinks.next_version_path(spark, f"{tmp_path}/{n}").rsplit("/", 1)[1]
    assert v("result.parquet") == "result_v1.parquet" and v("result_v3.parquet") == "result_v3.parquet"
    (tmp_path / "result_v1.parquet").write_text("")
    assert v("result_v1.parquet") == "result_v2.parquet"
    for k in (2, 3):
        (tmp_path / f"result_v{k}.parquet").write_text("")
    assert v("result_v1.parquet") == "result_v4.parquet"
    (tmp_path / "other.parquet").write_text("")
    assert v("other.parquet") == "other_v1.parquet"
    df = spark.range(3)
    sinks.save_run(df, str(tmp_path), "2024")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.save_run(df, str(tmp_path), "2024")
    sinks.save_run(df, str(tmp_path), "2025_dim_x")
    assert readers.latest_run(spark, str(tmp_path), "run_id=").endswith("2024")


def test_sinks(spark, tmp_path):
    registry = Registry.from_dict({"file_prefix": "br", "dimensions": {"p": {"abbr": "IP", "indicators": {f"p{k}": {"abbr": "x", "source": {}} for k in range(8)}}}})
    df = spark.range(5).select("id", *(F.lit(0.5).alias(i.normalised) for i in registry.indicators))
    assert len(sinks.save_dimension_slices(df, registry, f"{tmp_path}", ["id"])) == 2
    with pytest.warns(UserWarning, match="bytes"):
        sinks.save_dimension_slices(df, registry, f"{tmp_path}", ["id"], limit=10)
    sinks.save_csv(df, f"{tmp_path}/marked", bom=True)
    marked = [p.read_bytes() for p in (tmp_path / "marked").glob("part-*")]
    assert marked and all(m.startswith(b"\xef\xbb\xbfid,") for m in marked)
    sinks.save_slim(df, f"{tmp_path}/slim", ["id"], [registry.indicators[0].normalised])
    assert dict(spark.read.parquet(f"{tmp_path}/slim").dtypes)["p0_x_norm"] == "float"
    assert readers.missing_inputs(spark, registry, str(tmp_path)) == [f"p{k}" for k in range(8)]
    part = spark.createDataFrame([(1, "SP"), (2, "RJ")], "v int, state string")
    sinks.save_partitioned(part, f"{tmp_path}/parts", "state")
    sinks.save_partitioned(spark.createDataFrame([(9, "SP")], "v int, state string"), f"{tmp_path}/parts", "state")
    assert {r.v for r in spark.read.parquet(f"{tmp_path}/parts").collect()} == {9, 2}
    assert sinks.remaining(part, spark.createDataFrame([("SP",)], "state string"), ["state"]).count() == 1
    fail = spark.createDataFrame([("t", "1", "x" * 900)], "timestamp string, cd_mun string, reason string")
    sinks.append_failures(fail, f"{tmp_path}/fail")
    sinks.append_failures(fail, f"{tmp_path}/fail")
    assert [len(r.reason) for r in spark.read.parquet(f"{tmp_path}/fail").collect()] == [500, 500]
    sinks.reset_failures(fail, f"{tmp_path}/fail")
    assert spark.read.parquet(f"{tmp_path}/fail").count() == 0
    sinks.save_csv(spark.createDataFrame([(0.123456,)], "v double"), f"{tmp_path}/csv", 4)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").head()[0] == "0.1235"


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    source.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    stream = events.read_stream(spark, f"{tmp_path}/in", source.schema, 1)
    for _ in range(2):  # the second run finds nothing new
        q = events.ingest_once(stream, f"{tmp_path}/out", f"{tmp_path}/check")
        q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == source.count()
    q = events.tumbling_counts(events.read_stream(spark, f"{tmp_path}/in", source.schema), "event_type").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.start, r.event_type): r.n for r in spark.table("counts").collect()}
    batch = source.withColumn("t", F.col("ts").cast("timestamp")).groupBy(F.window("t", "1 hour").alias("w"), "event_type").count()
    want = {(r.w.start, r.event_type): r["count"] for r in batch.collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 10
    points = lambda df: df.select("ts", (F.col("user_id") % 7 * 40.0).alias("x"), (F.col("user_id") % 5 * 40.0).alias("y"))
    stream = points(events.read_stream(spark, f"{tmp_path}/in", source.schema, 1))
    events.keep_exposed(stream, 25.0, 1, f"{tmp_path}/years", f"{tmp_path}/c3").awaitTermination(120)
    from gridindex.operators.spatial import recurrent_exposure

    ev = points(source).withColumn("year", F.year("ts"))
    everywhere = events.exposed_years(spark, f"{tmp_path}/years")
    plain = recurrent_exposure(ev, everywhere.select("cell_id"), 25.0, 1)
    assert {tuple(r) for r in everywhere.collect()} == {tuple(r) for r in plain.collect()}
    assert tables.union_all([spark.range(2), spark.range(3)]).count() == 5


def test_pairs_come_once_however_late(spark, tmp_path):
    """Batches out of order, a repeat a year later and one after a restart: only new pairs are written; batches are compacted."""
    import datetime as dt

    def feed(*rows):
        frame = spark.createDataFrame([(dt.datetime(y, m, 1), float(x), 0.0) for y, m, x in rows], "ts timestamp, x double, y double")
        frame.write.mode("append").parquet(f"{tmp_path}/in")
        before = {p.name for p in (tmp_path / "years").glob("batch=*")} if (tmp_path / "years").exists() else set()
        events.keep_exposed(events.read_stream(spark, f"{tmp_path}/in", frame.schema), 10.0, 0, f"{tmp_path}/years", f"{tmp_path}/check").awaitTermination(120)
        new = [p for p in (tmp_path / "years").glob("batch=*") if p.name not in before]
        return sorted((r.cell_id, r.year) for p in new for r in spark.read.parquet(str(p)).collect())

    assert feed((2020, 5, 0), (2020, 6, 0), (2021, 1, 500)) == [("0:0", 2020), ("29:0", 2021)]
    assert feed((2010, 1, 0)) == [("0:0", 2010)]  # ten years before what was seen
    assert feed((2020, 12, 0), (2010, 2, 0), (2021, 3, 500)) == []  # all seen, however long ago
    assert feed((2022, 1, 0), (2020, 1, 0)) == [("0:0", 2022)]
    want = {("0:0", 2010), ("0:0", 2020), ("0:0", 2022), ("29:0", 2021)}
    pairs = lambda: {tuple(r) for r in events.exposed_pairs(spark, f"{tmp_path}/years").select("cell_id", "year").collect()}
    assert pairs() == want
    assert events.compact_years(spark, f"{tmp_path}/years") and pairs() == want
    assert [p.name for p in (tmp_path / "years").glob("*=*")] == ["through=3"]
    assert not events.compact_years(spark, f"{tmp_path}/years")
    assert feed((2023, 1, 0)) == [("0:0", 2023)] and pairs() == want | {("0:0", 2023)}
    assert events.compact_years(spark, f"{tmp_path}/years", 1) and pairs() == want | {("0:0", 2023)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_two_sessions_never_share_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"{tmp_path}/result.parquet"
    with ThreadPoolExecutor(2) as two:
        got = list(two.map(lambda s: [sinks.next_version_path(s, path) for _ in range(12)], (spark.newSession(), spark.newSession())))
    assert sorted(readers.version_of(p)[1] for p in got[0] + got[1]) == list(range(1, 25))
    with ThreadPoolExecutor(8) as many:
        won = list(many.map(lambda _: sinks.claim(spark, f"{tmp_path}/one"), range(8)))
    assert sum(won) == 1
    assert {sinks.save_version(spark.range(k), path) for k in (1, 2)} == {f"{tmp_path}/result_v25.parquet", f"{tmp_path}/result_v26.parquet"}


def test_a_stored_merge_moves_nothing(spark):
    for name, rows in (("base", [(k,) for k in range(50)]), ("one", [(k % 40, float(k)) for k in range(90)]), ("two", [(k, 1.0) for k in range(10, 60)])):
        sinks.save_bucketed(spark.createDataFrame(rows, "cell_id long, value double" if name != "base" else "cell_id long"), f"stored_{name}", "cell_id", 4)
    out = tables.merge_stored(spark.table("stored_base"), {n: spark.table(f"stored_{n}") for n in ("one", "two")})
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    plain = tables.merge_indicators(spark.table("stored_base"), {n: spark.table(f"stored_{n}") for n in ("one", "two")})
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in plain.select(out.columns).collect()}


def test_lookup_rows_of_one_code_in_a_stated_order(spark, tmp_path):
    (tmp_path / "l.csv").write_text("cd_mun;uf;n\n12;SP;2\n0000012;AC;9\n12;AC;3\n7;RJ;1\n")
    got = readers.read_lookup(spark, f"{tmp_path}/l.csv", "cd_mun", ["uf", "n"]).collect()
    assert sorted(tuple(r) for r in got) == [("0000007", "RJ", "1"), ("0000012", "AC", "3")]


def test_of_equal_line_numbers_the_first_in_the_files_is_taken(spark, tmp_path):
    """Files are read in another order than they stand in (the larger first)."""
    import gridindex.plans.queries_sources as registered

    row = lambda k, d: (k, 1, d, d, "AR"[k % 2])
    for name, rows in (("a", [row(k, 0.1) for k in range(10)]), ("b", [row(k % 10, 0.2) for k in range(5000)])):
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double, l_tax double, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / name))
    (tmp_path / "lineitem.parquet").mkdir()
    for name in "ab":
        next((tmp_path / name).glob("part-*")).rename(tmp_path / "lineitem.parquet" / f"part-{name}.parquet")
    out = registered.aligned_indicators(spark, str(tmp_path)).collect()
    assert sorted((r.cell_id, r.disc, r.tax) for r in out) == [(k, None, 0.1) if k % 2 else (k, 0.1, None) for k in range(10)]
