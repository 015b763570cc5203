import json
import wave

import pytest
from pyspark.sql import functions as F

from pairedsense.functions import arrays as ar
from pairedsense.functions import scalars as fn
from pairedsense.sources import readers as rd
from pairedsense.sources import sinks as sk
from pairedsense.streaming import jobs as sj


def test_clock_crosses_midnight(spark):
    df = spark.createDataFrame([(c,) for c in ("23:59:59", "00:00:00", "11:59:59.5", "12:00:00")], "c string")
    assert [r[0] for r in df.select(fn.clock_to_seconds("c")).collect()] == [86399.0, 86400.0, 129599.5, 43200.0]


def test_positive_keyword_wins(spark):
    df = spark.createDataFrame([("hypo_normalized.wav",), ("normal1.wav",), ("other.wav",)], "n string")
    got = [r[0] for r in df.select(fn.label_from_keywords("n", ["hypo", "osa"], ["normal"])).collect()]
    assert got == [1, 0, None]


def test_short_tail_joins_the_chunk_before(spark):
    df = spark.createDataFrame([(list(map(float, range(n))),) for n in (25, 22, 3)], "v array<double>")
    got = [[len(c) for c in r[0]] for r in df.select(ar.chunk("v", 10, 4)).collect()]
    assert got == [[10, 10, 5], [10, 12], [3]]


def test_experiment_key_ignores_order():
    assert fn.experiment_key(a=1, b="x") == fn.experiment_key(b="x", a=1) != fn.experiment_key(a=2, b="x")


def test_padded_ids_and_duplicates(spark, tmp_path):
    (tmp_path / "t.csv").write_text("subject_id,v\n7,1\n123,2\n")
    got = rd.read_table(spark, str(tmp_path / "t.csv"), "subject_id string, v int", {"subject_id": 2}, ["subject_id"])
    assert sorted(r["subject_id"] for r in got.collect()) == ["07", "123"]
    (tmp_path / "u.csv").write_text("subject_id,v\n7,1\n07,2\n")
    with pytest.raises(ValueError, match="duplicate"):
        rd.read_table(spark, str(tmp_path / "u.csv"), "subject_id string, v int", {"subject_id": 2}, ["subject_id"])


def test_annotation_documents(spark, tmp_path):
    doc = {"record_start": 100, "awake_intervals": [[110, 120]], "events": [{"evnet_start": 130, "event_duration": 5, "event_type": "osa"}]}
    (tmp_path / "03_annotation.json").write_text(json.dumps(doc, indent=1))
    header, events, awake = rd.read_annotations(spark, str(tmp_path))
    assert header.first()["subject_id"] == "03" and header.first()["event_count"] == 1
    e = events.first()
    assert (e["start"], e["end"], e["sleep_stage"]) == (30.0, 35.0, "")
    assert tuple(awake.first()) == ("03", 10.0, 20.0)
    (tmp_path / "04_annotation.json").write_text(json.dumps({"record_start": 1, "events": []}))
    with pytest.raises(Exception, match="lacks required keys"):
        rd.read_annotations(spark, str(tmp_path))[0].collect()


def test_wav_inventory(spark, tmp_path):
    for name, rate, frames in (("05_recorder2", 8000, 16000), ("05_recorder1", 8000, 4000), ("05_phone", 16000, 48000)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(b"\0\0" * frames)
    (tmp_path / "06_phone.wav").write_bytes(b"RIFF1234WAVE")
    audio = rd.audio_inventory(spark, str(tmp_path / "*.wav"))
    got = {(r["subject_id"], r["device"], r["seq"]): (r["status"], r["sample_rate"], r["duration_sec"]) for r in audio.collect()}
    assert got == {
        ("05", "R", 2): ("ok", 8000, 2.0), ("05", "R", 1): ("ok", 8000, 0.5), ("05", "S", 0): ("ok", 16000, 3.0), ("06", "S", 0): ("unreadable", None, None),
    }
    notes = spark.createDataFrame([("05", 3, 1), ("06", 0, 0)], "subject_id string, event_count int, awake_interval_count int")
    inv = {r["subject_id"]: r for r in rd.subject_inventory(audio, notes).collect()}
    assert inv["05"]["common_duration_sec"] == 2.5 and [s["seq"] for s in inv["05"]["segments"]] == [1, 2]
    assert not inv["06"]["paired_available"] and inv["06"]["common_duration_sec"] is None


def test_sinks_refuse(spark, tmp_path):
    df = spark.range(3)
    sk.write_new(df, str(tmp_path / "a"))
    with pytest.raises(Exception):
        sk.write_new(df, str(tmp_path / "a"))
    with pytest.raises(ValueError):
        sk.write_new(df.filter("id < 0"), str(tmp_path / "b"))
    assert not sk.write_idempotent(df, str(tmp_path / "a"))
    with pytest.raises(ValueError):
        sk.write_idempotent(spark.range(4), str(tmp_path / "a"))
    with pytest.raises(ValueError):
        sk.append_log(df, str(tmp_path / "log"), ["other"])


def test_incomplete_features_and_predictions_are_refused(spark, tmp_path):
    feats = spark.createDataFrame([(1, "a", [1.0])], "sample_id int, feature string, vector array<float>")
    sk.write_features(feats, str(tmp_path / "f"))
    with pytest.raises(ValueError, match="sample 2"):
        rd.read_features(spark, str(tmp_path / "f"), "a", spark.createDataFrame([(1,), (2,)], "sample_id int"))
    p = spark.createDataFrame(
        [("r", f"x{f}", "x", "7", "R", 1, 0.5, 1, "rep", "clf", "R_R", f) for f in range(4)], rd.PREDICTIONS
    )
    sk.write_predictions(p, str(tmp_path / "p"))
    assert rd.read_predictions(spark, str(tmp_path / "p"), 4).first()["subject_id"] == "07"
    with pytest.raises(ValueError, match="all folds"):
        rd.read_predictions(spark, str(tmp_path / "p"), 5)


def test_late_rows_are_dropped(spark, tmp_path):
    def write(n, rows):
        df = spark.createDataFrame(rows, "k string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))

    write(0, [("a", "2024-01-01 00:01:00", 1.0), ("a", "2024-01-01 01:00:00", 2.0)])
    schema = spark.read.parquet(str(tmp_path / "in" / "b0")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    out = sj.stream_epochs(stream, ["k"])

    def run():
        q = (
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        q.awaitTermination()

    run()
    write(1, [("a", "2024-01-01 00:02:00", 5.0), ("a", "2024-01-01 02:00:00", 3.0)])
    run()
    got = sorted((str(r["epoch_start"]), r["events"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-01 00:00:00", 1), ("2024-01-01 01:00:00", 1)]


def test_wav_chunks_and_names(spark, tmp_path):
    def chunk(name, body):
        return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)

    fmt = (1).to_bytes(2, "little") * 2 + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + b"\2\0\x10\0"
    body = b"WAVE" + chunk(b"LIST", b"abc") + chunk(b"fmt ", fmt) + chunk(b"fact", b"1234") + chunk(b"data", bytes(8000))
    for name in ("01_recorder_2", "01_recorder", "01_phone", "01_recorderx", "notes"):
        (tmp_path / f"{name}.wav").write_bytes(b"RIFF" + len(body).to_bytes(4, "little") + body)
    got = {r["path"].rsplit("/", 1)[1]: r for r in rd.audio_inventory(spark, f"{tmp_path}/*.wav").collect()}
    assert {n: (r["subject_id"], r["device"], r["seq"], r["status"]) for n, r in got.items()} == {
        "01_recorder_2.wav": ("01", "R", 2, "ok"),
        "01_recorder.wav": ("01", "R", 0, "ok"),
        "01_phone.wav": ("01", "S", 0, "ok"),
        "01_recorderx.wav": (None, None, None, "unexpected name"),
        "notes.wav": (None, None, None, "unexpected name"),
    }
    assert {r["duration_sec"] for r in got.values()} == {0.5}


def test_malformed_series_fail(spark, tmp_path):
    path = tmp_path / "01_SpO2.csv"
    path.write_text("clock,v\n22:00:00,97\n22:00:01,-\n-,95\n")
    assert rd.read_series(spark, str(path), "clock string, v double", "clock", "v").count() == 1
    for bad in ("22:00:02,abc", "22h,97"):
        path.write_text(f"clock,v\n22:00:00,97\n{bad}\n")
        with pytest.raises(Exception, match="(?i)malformed|array"):
            rd.read_series(spark, str(path), "clock string, v double", "clock", "v").collect()


def test_wav_chunks_before_the_data_may_be_long(spark, tmp_path):
    fmt = b"fmt " + (16).to_bytes(4, "little") + b"\x01\0\x01\0" + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + b"\x02\0\x10\0"
    data = b"data" + (16000).to_bytes(4, "little") + bytes(16000)
    chunk = lambda name, n: name + n.to_bytes(4, "little") + bytes(n + n % 2)
    files = {
        "01_phone": fmt + chunk(b"LIST", 100_000) + data,
        "02_phone": chunk(b"JUNK", 100_001) + fmt + data,
        "03_phone": chunk(b"id3 ", 70_000) + fmt + chunk(b"bext", 70_000) + chunk(b"LIST", 90_000) + chunk(b"JUNK", 1_000_000) + data,
        "04_phone": chunk(b"JUNK", (1 << 16) - 12 - 8 - 10) + fmt + data,  # the first step ends inside fmt
        "05_phone": chunk(b"JUNK", (1 << 16) - 12 - 8 - 4) + fmt + data,  # or inside the name and size of a chunk
        "06_phone": chunk(b"JUNK", 20) * 10_000 + fmt + data,
        "07_phone": fmt + chunk(b"LIST", 300_000),
    }
    for name, chunks in files.items():
        body = b"WAVE" + chunks
        (tmp_path / f"{name}.wav").write_bytes(b"RIFF" + len(body).to_bytes(4, "little") + body)
    got = {r["subject_id"]: (r["status"], r["duration_sec"]) for r in rd.audio_inventory(spark, f"{tmp_path}/*.wav").collect()}
    assert got == {f"0{i}": ("ok", 1.0) for i in range(1, 7)} | {"07": ("unreadable", None)}


def test_wav_files_are_read_by_ranges(spark, tmp_path):
    fmt = b"fmt " + (16).to_bytes(4, "little") + b"\x01\x00\x01\x00" + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + b"\x02\x00\x10\x00"
    (tmp_path / "07").mkdir()
    size = 3 << 30  # sparse: no disk is used, and no reader of whole files takes it
    with open(tmp_path / "07" / "07_phone.wav", "wb") as f:
        f.write(b"RIFF" + (size - 8 & 0xFFFFFFFF).to_bytes(4, "little") + b"WAVE" + fmt + b"data" + (size - 44).to_bytes(4, "little"))
        f.truncate(size)
    with open(tmp_path / "07" / "07_recorder.wav", "wb") as f:  # beyond 4 GB the size stands in a chunk of its own
        ds64 = b"ds64" + (28).to_bytes(4, "little") + (5 << 30).to_bytes(8, "little") + (5 << 30).to_bytes(8, "little") + bytes(12)
        f.write(b"RF64" + b"\xff" * 4 + b"WAVE" + ds64 + fmt + b"data" + b"\xff" * 4)
    (tmp_path / "07" / "07_recorder_2.wav").write_bytes(b"")
    (tmp_path / "07_phone.wav").write_bytes(b"RIFF")
    for glob, n in ((f"{tmp_path}/*/*.wav", 3), (f"file://{tmp_path}/**/*.wav", 4), (f"{tmp_path}/07", 3), (f"{tmp_path}/07/07_phone.wav", 1), (f"{tmp_path}/0[0-6]*.wav", 0)):
        assert rd.audio_inventory(spark, glob).count() == n
    got = {(r["device"], r["seq"]): (r["status"], r["duration_sec"]) for r in rd.audio_inventory(spark, f"file:{tmp_path}/*/*.wav").collect()}
    assert got == {("S", 0): ("ok", (size - 44) / 16000), ("R", 0): ("ok", (5 << 30) / 16000), ("R", 2): ("unreadable", None)}
