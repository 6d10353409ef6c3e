import json
import os
import random
import shutil
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_core import plain_ewma
from trackspark.sources import sinks, tables
from trackspark.streaming import match


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" timestamp ,timestamp_ms,x\n10,1,a\n,2,b\nbad,,c\n")
    rows = tables.phone_beats(tables.text_table(spark, str(tmp_path / "a.csv")))
    assert sorted((r.timestamp_ms, r.x) for r in rows.collect()) == [(2.0, "b"), (10.0, "a")]
    assert dict(tables.typed_table(spark, str(tmp_path / "a.csv"), "timestamp string, timestamp_ms long, x string").dtypes)["timestamp_ms"] == "bigint"
    ref = spark.createDataFrame([("1500000", "120", "x"), (None, "1", "1")], "epoch_ns string, beat_sys string, beat_dia string")
    got = tables.reference_beats(ref).collect()
    assert [(r.timestamp_ms, r.beat_sys, r.beat_dia) for r in got] == [(1.5, 120.0, None)]
    for f in (tables.phone_beats, tables.reference_beats):
        with pytest.raises(ValueError):
            f(spark.createDataFrame([(1,)], "y int"))


def test_session_folders_and_coefficients(spark, tmp_path):
    for s in ("s1", "s2"):
        (tmp_path / f"session_id={s}").mkdir()
        (tmp_path / f"session_id={s}" / "t.csv").write_text("a, b ,c\n1,2,3\n")
    df = tables.session_table(spark, str(tmp_path), ["b", "missing", "a"])
    assert df.columns == ["session_id", "b", "a"] and df.where("session_id = 's2'").count() == 1
    past = spark.createDataFrame([("s2", 0), ("s0", 0)], "session_id string, b int")
    assert sorted((r.session_id, r.origin) for r in tables.sessions(df, past).collect()) == [("s0", "past"), ("s1", "current"), ("s2", "current")]
    (tmp_path / "m.json").write_text(json.dumps({"methods": {"A": {"features": ["f", "g"], "MAP": [1, 2, 3], "PP": [4, 5, 6], "pp_term_scales": {"g": 0.5}}}}))
    got = {(r.target, r.term): (r.value, r.scale) for r in tables.coefficients(spark, str(tmp_path / "m.json")).collect()}
    assert got[("PP", "g")] == (6.0, 0.5) and got[("MAP", "g")] == (3.0, 1.0) and got[("PP", "intercept")] == (4.0, 1.0)
    assert tables.first_present(spark, [str(tmp_path / "no"), str(tmp_path / "m.json")]).endswith("m.json") and tables.first_present(spark, []) is None
    rows = tables.reference_rows(spark.createDataFrame([(1, 1, 120.0, 80.0), (1, 2, float("nan"), 80.0)], "s int, i int, ref_SBP double, ref_DBP double"), "s", ["i"]).collect()
    assert [(r.row_index, r.ref_PP) for r in rows] == [(0, 40.0)]


LINES = [
    '01-02 03:04 D/App: {"event": "bp_beat", "timestamp_ms": 5, "beat_index": 1, "rtbp": {"sbp": 120, "dbp": 80}}',
    "noise", '{"event": "other"}', '{"event": "bp_beat", broken', "2024-01-02T03:04:05Z SYS=120.5 DIA=80 MAP=93 HR=60 COUNT=7 FLAG=0", "never SYS=120 DIA=80 MAP=93 HR=60 COUNT=8 FLAG=1",
]


def test_log_lines_in_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text("\n".join(LINES))
    batch, stream = spark.read.text(str(tmp_path / "in")), spark.readStream.text(str(tmp_path / "in"))
    for parse, n in ((tables.beat_events, 1), (tables.monitor_events, 2)):
        rows = parse(batch).collect()
        assert len(rows) == n and sorted(map(str, match.drained(parse(stream)).collect())) == sorted(map(str, rows))
    times = [r.timestamp_ms for r in tables.monitor_events(batch).collect()]
    assert sorted(t is None for t in times) == [False, True] and 1704164645000.0 in times
    back = sinks.fallback_beats(tables.monitor_events(batch)).collect()
    assert [(r["epoch_ns"], r["Beat Sys [mmHg]"], r["計測回数"], r["経過時間"]) for r in back] == [("1704164645000000000", "120.500000000", "7", "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a|b"), (2, 0.5, None)], "k long, x double, t string")
    sinks.write_csv(df.where("false"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["k", "x", "t"] or spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 0
    sinks.write_records(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"k":1,"x":null,"t":"a|b"}', '{"k":2,"x":0.5,"t":null}']
    for run in ("r1", "r2", "r2"):
        sinks.write_run(df, str(tmp_path), run, "out")
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("run_id").count().count() == 2
    text = sinks.report("T", {"part": df.orderBy("k")})
    assert "| 2 | 0.500 |  |" in text and "a\\|b" in text
    table = spark.createDataFrame([("A", "MAP", "f", 1.5)], "method string, target string, term string, value double")
    assert "1.5" in sinks.coefficient_payload(table).first().payload


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(k, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=7 * k), "ab"[k % 2], float(k)) for k in range(100)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "ts", "event_type", "value"])).write.parquet(str(tmp_path / "events.parquet"))
    got = match.drained(match.windowed(match.event_stream(spark, str(tmp_path / "events.parquet" / "*.parquet")), ["event_type"], "value"))
    batch = spark.read.parquet(str(tmp_path / "events.parquet")).groupBy("event_type", F.window("ts", "1 hour")).count().count()
    assert 2 * 9 <= got.count() < batch
    stream = match.windowed(match.event_stream(spark, str(tmp_path / "events.parquet" / "*.parquet")), ["event_type"], "value")
    whole = {(r.event_type, r.window_ms): (r.n, r.total) for r in match.to_the_end(stream).collect()}
    plain = spark.read.parquet(str(tmp_path / "events.parquet")).groupBy("event_type", F.unix_millis(F.window("ts", "1 hour")["start"]).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert whole == {(r.event_type, r.w): (r.n, r.total) for r in plain.collect()}


def test_online_match_and_smoothing(spark, tmp_path):
    rows = [("right", 1, 10.0), ("right", 2, 20.0), ("left", 3, 16.0), ("left", 4, None), ("right", 5, 12.0), ("left", 6, 11.0)]
    schema = "key long, side string, id long, t double, seq long"
    spark.createDataFrame([(1, *r, k) for k, r in enumerate(rows)], schema).coalesce(1).write.parquet(str(tmp_path / "m"))
    got = match.drained(match.matched_now(spark.readStream.schema(schema).parquet(str(tmp_path / "m")))).collect()
    assert sorted((r.id, r.ref_id, r.delta) for r in got) == [(3, 2, -4.0), (4, 2, None), (6, 1, 1.0)]
    xs = [1.0, None, 3.0, 2.0]
    spark.createDataFrame([(7, k, x) for k, x in enumerate(xs)], "key long, seq long, x double").coalesce(1).write.parquet(str(tmp_path / "s"))
    got = match.drained(match.smoothed_now(spark.readStream.schema("key long, seq long, x double").parquet(str(tmp_path / "s")), 0.5)).orderBy("seq").collect()
    assert [r.smoothed for r in got] == plain_ewma(xs, 0.5)


def one_file_a_batch(spark, folder, schema, files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        for f in (folder / str(k)).glob("*.parquet"):
            f.rename(folder / f"{k}.parquet")
            os.utime(folder / f"{k}.parquet", (k + 1, k + 1))
        shutil.rmtree(folder / str(k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_rows_that_come_in_several_files_out_of_order(spark, tmp_path):
    r = random.Random(6)
    files = [[(k % 2, r.choice(["left", "right"]), 100 * b + k, r.choice([None, *[float(x) for x in range(40)]]), r.randint(0, 500)) for k in range(60)] for b in range(4)]
    stream = one_file_a_batch(spark, tmp_path, "key long, side string, id long, t double, seq long", files)
    got = {x.id: (x.ref_id, x.delta) for x in match.drained(match.matched_now(stream, keep=3)).collect()}
    rings, want = {0: [], 1: []}, {}
    for rows in files:
        for key, side, i, t, _ in sorted(rows, key=lambda x: (x[4], x[1] == "left")):
            ring = rings[key]
            if side == "right":
                rings[key] = [*ring, (i, t)][-3:]
                continue
            timed = [(abs(t - u), k) for k, (_, u) in enumerate(ring) if t is not None and u is not None]
            best = min(timed)[1] if timed else len(ring) - 1
            want[i] = (ring[best][0], None if t is None or ring[best][1] is None else t - ring[best][1]) if ring else (None, None)
    assert got == want


def test_smoothing_over_several_files_and_restarts(spark, tmp_path):
    r = random.Random(7)
    files = [[(k % 2, 100 * b + k, r.choice([None, r.random()])) for k in range(30)] for b in range(3)]
    (tmp_path / "in").mkdir()
    stream, folder = one_file_a_batch(spark, tmp_path / "in", "key long, seq long, x double", files[:2]), str(tmp_path / "out")
    match.drained(match.smoothed_now(stream, 0.3), folder)
    spark.createDataFrame(files[2], "key long, seq long, x double").coalesce(1).write.parquet(str(tmp_path / "in" / "last"))
    for f in (tmp_path / "in" / "last").glob("*.parquet"):
        f.rename(tmp_path / "in" / "last.parquet")
    shutil.rmtree(tmp_path / "in" / "last")
    got = match.drained(match.smoothed_now(stream, 0.3), folder).orderBy("key", "seq").collect()
    for key in (0, 1):
        xs = [x for rows in files for k, _, x in sorted(rows, key=lambda v: v[1]) if k == key]
        assert [None if v.smoothed is None else round(v.smoothed, 12) for v in got if v.key == key] == [None if v is None else round(v, 12) for v in plain_ewma(xs, 0.3)]


def test_idle_state_goes(spark, tmp_path):
    schema, folder = "key long, side string, id long, t double, seq long", tmp_path / "in"
    folder.mkdir()
    stream = one_file_a_batch(spark, folder, schema, [[(1, "right", 1, 5.0, 1), (1, "left", 2, 5.0, 2)]])
    live = match.Live({"m": match.matched_now(stream, idle_ms=500)}, str(tmp_path / "out"), clocked=["m"])
    try:
        match._until_nothing_comes(live.queries["m"])
        time.sleep(1.5)
        (tmp_path / "more").mkdir()
        one_file_a_batch(spark, tmp_path / "more", schema, [[(1, "left", 3, 5.0, 3)]])
        (tmp_path / "more" / "0.parquet").rename(folder / "later.parquet")
        os.utime(folder / "later.parquet")
        time.sleep(0.5)
    finally:
        got = live.stop()["m"].collect()
    assert sorted((r.id, r.ref_id) for r in got) == [(2, 1), (3, None)]


def test_interval_match(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    for name, offsets in (("a", [0, 60, 4000]), ("b", [1, 58, 70])):
        spark.createDataFrame(pd.DataFrame({"key": 1, "ts": [base + pd.Timedelta(seconds=s) for s in offsets], "id": range(len(offsets))})).write.parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema("key long, ts timestamp, id long").parquet(str(tmp_path / n)) for n in "ab")
    out = match.drained(match.nearest_within(a, b, "key", "15 seconds"))
    best = {r.id: r.ref for r in out.groupBy("id").agg(F.min_by("ref_id", F.abs("delta_ms")).alias("ref")).collect()}
    assert best == {0: 0, 1: 1}
