from trackspark.sources import tables
from trackspark.streaming import match


def put(root, session, text, name="t.csv"):
    folder = root / f"session_id={session}"
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_every_session_is_read_by_its_own_header(spark, tmp_path):
    put(tmp_path, "a", "x,y,z\n1,2,3\n4,5,6\n")
    put(tmp_path, "b", "y, x \r\n20,10\r\n")
    put(tmp_path, "c", b"\xef\xbb\xbfx,only\n7,\"a, b\nc\"\n,\n")
    put(tmp_path, "d", "")
    put(tmp_path, "e", "x,x,y\n1,9\n2,8,7,6\n")
    put(tmp_path, "f", "q\n1\n")
    put(tmp_path, "g", "x,y\n")
    put(tmp_path, "a", "x\n99\n", "other.txt")
    df = tables.session_table(spark, str(tmp_path), {"x": "double", "y": "long", "only": "string", "none": "int"})
    assert df.dtypes == [("session_id", "string"), ("x", "double"), ("y", "bigint"), ("only", "string"), ("none", "int")]
    got = sorted(map(tuple, df.collect()), key=str)
    want = [("a", 1.0, 2, None, None), ("a", 4.0, 5, None, None), ("b", 10.0, 20, None, None), ("c", 7.0, None, "a, b\nc", None), ("c", None, None, None, None), ("e", 1.0, None, None, None), ("e", 2.0, 7, None, None), ("f", None, None, None, None)]
    assert got == sorted(want, key=str)
    named = tables.session_table(spark, str(tmp_path), ["y", "missing", "x", "only"])
    assert named.dtypes == [("session_id", "string"), ("y", "bigint"), ("x", "bigint"), ("only", "string")]
    assert named.where("session_id = 'b'").collect()[0][1:3] == (20, 10)


def test_values_of_another_type_are_null(spark, tmp_path):
    put(tmp_path, "1", "x,y\n1.5,bad\nno,2\n")
    put(tmp_path, "2", "y\n3\n")
    got = sorted(((r.session_id, r.x, r.y) for r in tables.session_table(spark, str(tmp_path), {"x": "double", "y": "int", "session_id": "string"}).collect()), key=str)
    assert got == sorted([(1, 1.5, None), (1, None, 2), (2, None, 3)], key=str)
    assert tables.session_table(spark, str(tmp_path), ["nothing"]).columns == ["session_id"]


def test_a_log_is_followed_as_it_grows(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.log").write_bytes(b"one\ntwo\r\nthr")

    def lines():
        match.start(tables.tailed(spark, str(source), "*.log"), folder).awaitTermination()
        return sorted((r.file, r.offset, r.value) for r in match.written(tables.tailed(spark, str(source), "*.log"), folder).collect())

    assert lines() == [("a.log", 0, "one"), ("a.log", 4, "two")]
    assert len(lines()) == 2  # nothing new
    with (source / "a.log").open("ab") as f:
        f.write("ee\né\n".encode())
    (source / "b.log").write_text("first\n")
    (source / "c.txt").write_text("no\n")
    got = lines()
    assert got[2:] == [("a.log", 9, "three"), ("a.log", 15, "é"), ("b.log", 0, "first")]
    (source / "b.log").write_text("a\n")  # begun anew
    assert [v for f, _, v in lines() if f == "b.log"] == ["a", "first"]
    (source / "long.log").write_bytes(b"x" * 200_000 + b"\n" + b"y" * 100_000)
    assert [len(v) for f, _, v in lines() if f == "long.log"] == [200_000]


def test_events_of_a_growing_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log").write_text('x {"event": "bp_beat", "timestamp_ms": 5, "beat_index": 1}\nnoise\n{"event": "bp_')
    events = tables.beat_events(tables.tailed(spark, str(tmp_path / "in")))
    assert [r.beat_index for r in match.drained(events).collect()] == [1]
    assert match.drained(tables.tailed(spark, str(tmp_path / "none"))).count() == 0


