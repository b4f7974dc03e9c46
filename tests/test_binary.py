"""Binary recordings: what the readers make of bytes that were put together by hand."""

import struct
import zlib

import numpy as np
import pytest

from pulsegrid.sources import binary


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def small(kind, data):
    return struct.pack("<I", len(data) << 16 | kind) + data.ljust(4, b"\0")


def matrix(code, shape, name, *parts):
    body = element(6, struct.pack("<II", code, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + small(1, name) + b"".join(parts)
    return element(14, body)


HEAD = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM"


def test_mat_elements_of_every_kind():
    numbers = matrix(6, (2, 3), b"a", element(3, np.array([1, 4, 2, 5, 3, 6], dtype="<i2").tobytes()))  # doubles kept as short integers
    words = matrix(4, (1, 2), b"t", small(16, b"hi"))
    wide = matrix(4, (1, 2), b"u", small(4, "éx".encode("utf-16-le")))
    cell = matrix(1, (1, 1), b"c")
    packed = zlib.compress(matrix(10, (1, 1), b"z", small(3, struct.pack("<h", -7))))
    content = HEAD + numbers + struct.pack("<II", 15, len(packed)) + packed + words + wide + cell
    got = binary.mat_arrays(content)
    assert got["a"].tolist() == [[1, 2, 3], [4, 5, 6]] and got["z"].tolist() == [[-7]] and (got["t"], got["u"]) == ("hi", "éx") and "c" not in got
    again = binary.mat_arrays(binary.mat_bytes({"feats": np.arange(6.0).reshape(2, 3), "curr_sample_rate": 500}))
    assert again["feats"].tolist() == [[0, 1, 2], [3, 4, 5]] and again["curr_sample_rate"].tolist() == [[500]]
    with pytest.raises(ValueError):
        binary.mat_arrays(b"no such file")


def test_wfdb_headers_and_formats():
    about = binary.header("# note\nr1 2 500/1000 4\nr1.dat 16 1000.5(3)/mV 16 0 0 0 0 lead I\nr1.dat 16 0 16 7\n")
    assert about["fs"] == 500 and about["samples"] == 4
    assert [(s["gain"], s["baseline"], s["name"]) for s in about["signals"]] == [(1000.5, 3, "lead I"), (200.0, 7, "1")]
    assert binary.samples(struct.pack("<4h", 1, -2, -32768, 4), "16", 2)[0].tolist() == [1, -2] and np.isnan(binary.samples(struct.pack("<2h", -32768, 4), "16", 2)[0, 0])
    # two samples of twelve bits in three bytes: 0x123 and -1
    assert binary.samples(bytes([0x23, 0xF1, 0xFF]), "212", 1).ravel().tolist() == [0x123, -1]
    with pytest.raises(ValueError):
        binary.samples(b"", "8", 1)


def test_files_that_are_broken_are_named(spark, tmp_path):
    (tmp_path / "x.npy").write_bytes(b"nothing")
    with pytest.raises(Exception, match="x.npy can't be read"):
        binary.npy(spark, str(tmp_path)).collect()
    (tmp_path / "x.npy").unlink()
    np.save(tmp_path / "y.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    row = binary.npy(spark, str(tmp_path)).first()
    assert row.shape == [2, 3] and row.values == [0, 1, 2, 3, 4, 5]
