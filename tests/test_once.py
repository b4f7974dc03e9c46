"""Runs that are broken off and started again, and frames of every kind."""

import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pulsegrid import sources
from pulsegrid.operators import etl
from pulsegrid.sources import binary, frames
from pyspark.sql import functions as F


def test_append_that_fails_before_its_commit_counts_once(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "log"), spark.range(20).withColumnRenamed("id", "n")
    read = lambda: sorted(r.n for r in sources.appended(spark, path, "n long").collect())
    assert read() == []
    with monkeypatch.context() as m:
        m.setattr(sources, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            sources.append_lines(rows.where("n < 10"), path, "job-0")
    assert read() == [] and list((tmp_path / "log" / "parts").iterdir())
    for _ in range(2):
        sources.append_lines(rows.where("n < 10"), path, "job-0")
        assert read() == list(range(10))
    sources.append_lines(rows.where("n >= 10"), path, "job/1")
    sources.append_lines(rows.where("n < 0"), path)
    assert read() == list(range(20))
    # two that write the same batch at once: the first to be committed counts
    assert not sources.commit(spark, f"{path}/commits/job-0", "other") and read() == list(range(20))


def test_stream_that_runs_a_batch_again_appends_it_once(spark, tmp_path):
    path, write = str(tmp_path / "log"), sources.appending(str(tmp_path / "log"), "calls")
    for number in (0, 1, 1, 0, 2):
        write(spark.range(number * 10, number * 10 + 10).withColumnRenamed("id", "n"), number)
    assert sorted(r.n for r in sources.responses(spark, path, "n long").collect()) == list(range(30))


def test_files_of_a_job_that_dies_are_whole_or_not_there(spark, tmp_path):
    folder = f"file://{tmp_path}/out"

    def made(last):
        def run(batches):
            for frame in batches:
                for n in frame["id"]:
                    if n == 5 and last:
                        raise RuntimeError("killed")
                    yield pd.DataFrame({"name": [f"f{n}.bin"], "content": [bytes([n]) * 100_000]})

        return spark.range(8).repartition(1).sortWithinPartitions("id").mapInPandas(run, "name string, content binary")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        with pytest.raises(Exception, match="killed"):
            binary.write_files(made(True), folder)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    left = [p for p in Path(tmp_path, "out").glob("f*.bin")]
    assert all(p.read_bytes() == bytes([int(p.stem[1:])]) * 100_000 for p in left)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|UNABLE_TO_INFER"):
        binary.manifest(spark, folder).collect()
    got = {r.name: (r.bytes, r.crc32) for r in binary.write_files(made(False), folder).collect()}
    assert got == {f"f{n}.bin": (100_000, zlib.crc32(bytes([n]) * 100_000)) for n in range(8)}
    assert binary.altered(spark, folder).count() == 0
    Path(tmp_path, "out", "f3.bin").write_bytes(b"x")
    Path(tmp_path, "out", "f4.bin").unlink()
    assert {tuple(r) for r in binary.altered(spark, folder).collect()} == {("f3.bin", "changed"), ("f4.bin", "missing")}


def test_literals_with_apostrophes(spark):
    rows = [("{'a': 1.0, 'b': 0}",), ("{\"it's\": 2.5}",), ("none",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(etl.literal_map(F.col("s"))).collect()]
    assert got == [{"a": 1.0, "b": 0.0}, {"it's": 2.5}, None, None]


def test_frames_of_all_differences():
    rng = np.random.default_rng(2)
    steps = rng.integers(-128, 128, (8, 400))
    steps[:, :40] = -128  # each of them needs a mark
    x = np.cumsum(np.concatenate([rng.integers(-3000, 3000, (8, 1)), steps], axis=1), axis=1)
    got = frames.decoded(frames.encoded(x, 2**31, 3, 72, 88))
    assert got["channels"] == x.tolist() and [got[k] for k in ("status", "hr", "battery", "first_index", "count", "error")] == [3, 72, 88, 2**31, 401, None]
    # by hand: a mark makes the next byte, 0x80 too, a plain difference
    head = bytes(44) + (7).to_bytes(4, "little") + (2).to_bytes(2, "little")
    wave = b"\x80\xff" + np.arange(8, dtype="<i2").tobytes() + b"\x01\xff\x80\x80\x80\x05\x00\x7f\x81\x02"
    assert [c[1] - c[0] for c in frames.decoded(head + wave)["channels"]] == [1, -1, -128, 5, 0, 127, -127, 2]
    with pytest.raises(ValueError):
        frames.encoded(np.array([[0, 200]] * 8), 0)


@pytest.mark.parametrize(
    "content, why",
    [(None, "too short"), (b"", "too short"), (bytes(49), "too short"), (bytes(48) + b"\x02\x00" + bytes(30), "no waveform"), (bytes(48) + b"\x02\x00\x80\xff" + bytes(15), "first samples"), (bytes(48) + b"\x02\x00\x80\xff" + bytes(16) + bytes(7), "7 differences"), (bytes(48) + b"\x02\x00\x80\xff" + bytes(16) + bytes(8) + b"\x80", "a mark"), (bytes(50) + b"x", "no samples")],
)
def test_broken_frames_are_named(content, why):
    got = frames.decoded(content)
    assert why in got["error"] and got["channels"] is None


def test_frames_in_order_over_spans(spark):
    span = frames.SPAN
    rows = [("a", 0, 4), ("a", 4, 4), ("a", 10, 4), ("a", 12, 4), ("a", 12, 2), ("a", span - 2, 6), ("a", span + 2, 4), ("a", 3 * span, 2), ("b", 100, 3), ("b", 100, 3)]
    held = spark.createDataFrame([(d, f, n, [[f + i for i in range(n)]] * 8, None) for d, f, n in rows] + [("b", 0, 5, None, "broken")], "device_id string, first_index long, count int, channels array<array<int>>, error string")
    got = sorted((r.device_id, r.first_index, r["count"], r.missing, r.known, r.channels[0]) for r in frames.in_order(held).collect())
    want = [("a", 0, 4, 0, 0, [0, 1, 2, 3]), ("a", 4, 4, 0, 0, [4, 5, 6, 7]), ("a", 10, 4, 2, 0, [10, 11, 12, 13]), ("a", 12, 2, 0, 2, []), ("a", 12, 4, 0, 2, [14, 15])]
    want += [("a", span - 2, 6, span - 18, 0, list(range(span - 2, span + 4))), ("a", span + 2, 4, 0, 2, [span + 4, span + 5]), ("a", 3 * span, 2, 2 * span - 6, 0, [3 * span, 3 * span + 1]), ("b", 100, 3, 0, 0, [100, 101, 102]), ("b", 100, 3, 0, 3, [])]
    assert got == sorted(want)
