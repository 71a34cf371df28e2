"""Keyed stream state, outer stream joins, sessions by segments, byte ranges and numbered lines."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import series as SE
from gridloom.sources import images as IM
from gridloom.sources import ranges as RG
from gridloom.sources import text as TX
from gridloom.streaming import keyed as KS
from gridloom.streaming import runs as R

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=float(minutes))


def arrive(spark, folder, number, rows, schema):
    """One more file; its name keeps files in order."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/file={number:03d}")


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


ROWS = "user long, ts timestamp, id long, note string"


def newest(rows, size):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    key = lambda r: (r[1] is not None, r[1] or START, r[2])
    return sorted((r for of in out.values() for r in sorted(of, key=key, reverse=True)[:size]), key=repr)


def test_buffer_survives_restarts_and_a_hot_key(spark, tmp_path):
    draw, every, arrivals = np.random.default_rng(2), [], str(tmp_path / "in")
    for number in range(3):
        users = np.where(draw.random(900) < 0.9, 7, draw.integers(0, 40, 900))
        rows = [(int(u), at(draw.integers(0, 500)), number * 1000 + i, "n") for i, u in enumerate(users)]
        rows += [(None, at(number), number, None), (3, None, 5000 + number, "no time")]
        every += rows
        arrive(spark, arrivals, number, rows, ROWS)
        out = KS.run_buffer(stream_of(spark, arrivals, ROWS), str(tmp_path / "work"), "user", "ts", "id", 5)
        assert sorted((tuple(r) for r in out.collect()), key=repr) == newest(every, 5)
        # The state holds keys times the size at most.
        assert out.count() <= 5 * len({r[0] for r in every})
    # Without new input the state stays as it is.
    again = KS.run_buffer(stream_of(spark, arrivals, ROWS), str(tmp_path / "work"), "user", "ts", "id", 5)
    assert again.count() == len(newest(every, 5))


def test_only_a_few_rows_of_a_key_leave_a_batch(spark):
    rows = [(1, at(i), i, "x") for i in range(5000)] + [(2, at(1), 1, "y"), (None, None, 9, None)]
    out = KS.newest_of_batches(spark.createDataFrame(rows, ROWS).coalesce(1), "user", "ts", "id", 3).collect()
    assert len(out) <= 2 * 3 + 2
    assert newest([tuple(r) for r in out], 3) == newest(rows, 3)


def test_idle_keys_are_forgotten(spark, tmp_path):
    arrivals, work = str(tmp_path / "in"), str(tmp_path / "work")
    for number, rows in enumerate(([(1, at(0), 1, "a"), (2, at(0), 2, "b")], [(2, at(100), 3, "c")], [(2, at(400), 4, "d")], [(2, at(401), 5, "e"), (3, at(401), 6, "f")])):
        arrive(spark, arrivals, number, rows, ROWS)
        out = KS.run_buffer(stream_of(spark, arrivals, ROWS), work, "user", "ts", "id", 10, idle="200 minutes", delay="1 minute")
    # User 2 was idle for 300 minutes, but its timer moved on with the row at 100; user 1 never came back.
    assert {r["user"] for r in out.collect()} == {2, 3}
    assert 1 not in {r["id"] for r in out.collect()}


JOB = "job long, ts timestamp"


def test_answers_late_missing_and_wrong(spark, tmp_path):
    asked, given, work = str(tmp_path / "asked"), str(tmp_path / "given"), str(tmp_path / "work")
    steps = [
        ([(1, at(0)), (2, at(1)), (3, at(2)), (None, at(2))], [(1, at(1)), (9, at(1)), (None, at(1))]),
        ([(4, at(8))], [(1, at(1)), (2, at(6))]),  # a repeated answer, and one that comes in a later batch
        ([(5, at(30))], [(4, at(29)), (5, at(31))]),  # job 4 is answered too late
        ([(6, at(500))], [(6, at(500))]),
        ([(7, at(900))], [(7, at(900))]),
    ]
    for number, (jobs, answers) in enumerate(steps):
        arrive(spark, asked, number, jobs, JOB)
        arrive(spark, given, number, answers, JOB)
        out = KS.run_matches(stream_of(spark, asked, JOB), stream_of(spark, given, JOB), work, "job", "ts", "10 minutes", "10 minutes")
    found = sorted(((r["job"], r["status"]) for r in out.collect() if r["job"] not in (6, 7)), key=repr)
    assert found == sorted([(1, "answered"), (2, "answered"), (3, "unanswered"), (4, "unanswered"), (4, "unrequested"), (5, "answered"),
                            (9, "unrequested"), (None, "unanswered"), (None, "unrequested")], key=repr)


def plain_sessions(rows, gap):
    out = []
    by = {}
    for key, ts in rows:
        if ts is not None:
            by.setdefault(key, []).append(ts)
    for key, times in by.items():
        number = -1
        for i, ts in enumerate(sorted(times)):
            if not i or (ts - last).total_seconds() > gap:
                number += 1
                out.append([key, number, ts, ts, 0])
            last = ts
            out[-1][3], out[-1][4] = ts, out[-1][4] + 1
    return sorted((tuple(r) for r in out), key=repr)


@pytest.mark.parametrize("chunk", [2, 3, 16, 4096])
def test_sessions_of_a_busy_user(spark, chunk):
    draw = np.random.default_rng(chunk)
    times = np.cumsum(draw.choice([5, 30, 60, 61, 400, 5000], 900, p=[0.5, 0.2, 0.1, 0.1, 0.08, 0.02]))
    rows = [(7 if draw.random() < 0.9 else None if draw.random() < 0.3 else int(draw.integers(0, 9)), START + dt.timedelta(seconds=int(t))) for t in times]
    rows += [(7, None), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "user long, ts timestamp").repartition(5)
    out = SE.sessions(df, "user", "ts", 60, chunk=chunk)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_sessions(rows, 60)


def test_no_sessions_of_an_empty_table(spark):
    assert SE.sessions(spark.createDataFrame([], "user long, ts timestamp"), "user", "ts", 60).count() == 0


@pytest.mark.parametrize("range_bytes", [1, 70, 1 << 20])
def test_records_of_a_large_file_by_ranges(spark, tmp_path, range_bytes):
    body = {"a.bin": 25, "b.bin": 1, "c.bin": 0}
    for name, n in body.items():
        (tmp_path / name).write_bytes(b"head" + b"".join(bytes([i % 256]) * 7 for i in range(n)) + b"rest"[: n % 5])
    (tmp_path / "d.bin").write_bytes(b"he")
    out = RG.read_records(spark, str(tmp_path), 7, 4, range_bytes)
    got = sorted((r["path"].rsplit("/", 1)[1], r["index"], bytes(r["record"])) for r in out.collect())
    assert got == [(name, i, bytes([i]) * 7) for name, n in body.items() for i in range(n)]
    if range_bytes == 1:
        assert out.rdd.getNumPartitions() > 1
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    again = whole.mapInArrow(RG._whole_reader(7, 4, 3), "path string, index long, record binary")
    assert sorted((r["path"].rsplit("/", 1)[1], r["index"], bytes(r["record"])) for r in again.collect()) == got


def test_byte_arrays_of_batches(spark):
    rows = [(1, b"\x00\xff"), (2, b""), (3, None), (4, b"\x07")]
    df = spark.createDataFrame(rows, "k int, b binary").coalesce(1)
    assert {r["k"]: r["x"] for r in df.select("k", RG.unsigned_bytes(F.col("b")).alias("x")).collect()} == {1: [0.0, 255.0], 2: [], 3: None, 4: [7.0]}


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = [f"token {i} é" if i % 7 else "" for i in range(4000)]
    (tmp_path / "a.txt").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "b.txt").write_bytes("\n".join(lines[:50]).encode() + b"\n")
    (tmp_path / "c.txt").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        out = RG.numbered_lines(spark, str(tmp_path)).collect()
        listed = TX.read_token_list(spark, str(tmp_path / "a.txt")).collect()
        classes = IM.read_class_list(spark, str(tmp_path / "a.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = sorted((r["path"].rsplit("/", 1)[1], r["number"], r["line"]) for r in out)
    assert got == [("a.txt", i, line) for i, line in enumerate(lines)] + [("b.txt", i, line) for i, line in enumerate(lines[:50])]
    assert sorted((r["id"], r["token"]) for r in listed) == [(i, line) for i, line in enumerate(lines) if line]
    assert sorted((r["label"], r["class"], r["text"]) for r in classes) == [(i, "token", line) for i, line in enumerate(lines) if line]


def test_sessions_equal_the_stream(spark, tmp_path):
    from gridloom.streaming import operators as S

    rows = [(u, at(m)) for u in range(3) for m in (0, 1, 5, 9, 30, 31)] + [(0, at(300))]
    spark.createDataFrame(rows, "user long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = R.run_to_table(S.session_stream(R.folder_stream(spark, str(tmp_path / "in")), "user", "ts", "4 minutes"), "sessions", folder=str(tmp_path / "out")).toPandas()
    batch = SE.sessions(spark.createDataFrame(rows, "user long, ts timestamp"), "user", "ts", 240).toPandas()
    batch = batch[batch["last"] < pd.Timestamp(at(200))]
    assert sorted(map(tuple, out[["user", "start", "last", "rows"]].to_numpy())) == sorted(map(tuple, batch[["user", "start", "last", "rows"]].to_numpy()))
