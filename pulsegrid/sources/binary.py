"""Recordings in binary files: NPY arrays, WFDB records and MAT files (level 5), read where Spark reads their bytes.

A file is a row of Spark's binaryFile source and is decoded by one task; what a file holds is bounded by what a
recording is. A file that is not of its format is an error that names it.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _decoded(files: DataFrame, decode: Callable[..., dict], schema: str) -> DataFrame:
    """A row of `schema` for each row of files, whose columns decode() takes by name; what it raises names the path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    rows.append(decode(**row))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    raise ValueError(f"{row['path']} can't be read: {e}") from e
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.mapInPandas(run, schema)


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")


def npy(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """path, shape, values: the array of each file, in row order, as doubles. Arrays of objects are refused."""

    def decode(path: str, content: bytes) -> dict:
        x = np.load(io.BytesIO(content), allow_pickle=False)
        return {"path": path, "shape": list(x.shape), "values": x.astype(np.float64).ravel().tolist()}

    return _decoded(_files(spark, folder, pattern), decode, "path string, shape array<long>, values array<double>")


def header(text: str) -> dict:
    """What a WFDB record's header says: rate, samples, and of each signal its format, gain, baseline and name."""
    lines = [x for x in (x.strip() for x in text.splitlines()) if x and x[0] != "#"]
    first = lines[0].split()
    signals = []
    for line in lines[1 : 1 + int(first[1])]:
        part = line.split()
        gain, _, _ = part[2].partition("/") if len(part) > 2 else ("200", "", "")
        number, _, base = gain.partition("(")
        zero = int(part[4]) if len(part) > 4 else 0
        # a gain of 0 is an unknown one, which stands for 200; the baseline is the ADC's zero unless it is told
        signals.append({"file": part[0], "format": part[1], "gain": float(number) or 200.0, "baseline": int(base.rstrip(")")) if base else zero, "name": " ".join(part[8:]) or f"{len(signals)}"})
    return {"record": first[0], "fs": float(first[2].split("/")[0].split("(")[0]) if len(first) > 2 else 250.0, "samples": int(first[3]) if len(first) > 3 else 0, "signals": signals}


def samples(content: bytes, kind: str, signals: int) -> np.ndarray:
    """Digital samples (samples x signals) of WFDB format 16 or 212; their smallest number stands for none."""
    if kind == "16":
        x = np.frombuffer(content, dtype="<i2").astype(np.int64)
        broken = -32768
    elif kind == "212":
        b = np.frombuffer(content[: len(content) // 3 * 3], dtype=np.uint8).reshape(-1, 3).astype(np.int64)
        x = np.stack([b[:, 0] | (b[:, 1] & 0x0F) << 8, b[:, 2] | (b[:, 1] & 0xF0) << 4], axis=1).ravel()
        x, broken = np.where(x > 2047, x - 4096, x), -2048
    else:
        raise ValueError(f"format {kind} is not known")
    x = x[: len(x) // signals * signals].reshape(-1, signals)
    return np.where(x == broken, np.nan, x.astype(np.float64))


def wfdb(spark: SparkSession, folder: str) -> DataFrame:
    """record, fs, names, leads (array<array<double>>, in physical units) of each record: a .hea file with its .dat file beside it; missing samples are NaN."""

    def decode(path: str, content: bytes, data: bytes) -> dict:
        about = header(content.decode("utf-8"))
        signals = about["signals"]
        if len({(s["file"], s["format"]) for s in signals}) != 1:
            raise ValueError("its signals are not of one file and format")
        x = samples(data, signals[0]["format"], len(signals))
        x = x[: about["samples"]] if about["samples"] else x
        leads = [((x[:, i] - s["baseline"]) / s["gain"]).tolist() for i, s in enumerate(signals)]
        return {"record": about["record"], "fs": about["fs"], "names": [s["name"] for s in signals], "leads": leads}

    stem = F.regexp_replace("path", r"\.(hea|dat)$", "")
    heads = _files(spark, folder, "*.hea").withColumn("stem", stem)
    data = _files(spark, folder, "*.dat").select(stem.alias("stem"), F.col("content").alias("data"))
    return _decoded(heads.join(data, "stem").drop("stem"), decode, "record string, fs double, names array<string>, leads array<array<double>>")


#: Fixed: the numeric types of level 5 elements, by number.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1"}
MATRIX, COMPRESSED, CHARACTERS = 14, 15, 4


def elements(data: bytes, order: str = "<") -> Iterator[tuple[int, bytes]]:
    """(type, content) of the elements of a level 5 file or matrix, one after another."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: size and type in four bytes, and the content in the next four
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def mat_arrays(content: bytes) -> dict[str, np.ndarray | str]:
    """The numeric matrices and the texts of a level 5 MAT file, by name; structures, cells and the like are left out."""
    if len(content) < 128 or content[126:128] not in (b"IM", b"MI"):
        raise ValueError("it is no MAT file of level 5")
    order = "<" if content[126:128] == b"IM" else ">"
    out: dict[str, np.ndarray | str] = {}
    for kind, data in elements(content[128:], order):
        if kind == COMPRESSED:
            kind, data = next(elements(zlib.decompress(data), order))
        if kind != MATRIX:
            continue
        parts = list(elements(data, order))
        code = struct.unpack_from(order + "I", parts[0][1])[0] & 0xFF
        if len(parts) < 4 or not (code == CHARACTERS or 6 <= code <= 15):
            continue
        shape = np.frombuffer(parts[1][1], dtype=order + "i4")
        name, values = parts[2][1].decode("ascii"), np.frombuffer(parts[3][1], dtype=order + MAT_TYPES[parts[3][0]]) if parts[3][0] in MAT_TYPES else None
        if code == CHARACTERS:
            out[name] = parts[3][1].decode("utf-8") if values is None or parts[3][0] in (1, 2, 16) else "".join(map(chr, values.tolist()))
        elif values is not None:
            out[name] = values.reshape(shape, order="F")
    return out


def mat(spark: SparkSession, folder: str, pattern: str = "*.mat") -> DataFrame:
    """path, arrays (name to shape and values in row order, as doubles), texts (name to text) of each file."""

    def decode(path: str, content: bytes) -> dict:
        held = mat_arrays(content)
        arrays = {k: (list(v.shape), v.astype(np.float64).ravel().tolist()) for k, v in held.items() if not isinstance(v, str)}
        return {"path": path, "arrays": arrays, "texts": {k: v for k, v in held.items() if isinstance(v, str)}}

    return _decoded(_files(spark, folder, pattern), decode, "path string, arrays map<string,struct<shape:array<bigint>,values:array<double>>>, texts map<string,string>")


def mat_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A level 5 MAT file of matrices of doubles, little-endian, not compressed."""

    def element(kind: int, data: bytes) -> bytes:
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, x in arrays.items():
        x = np.atleast_2d(np.asarray(x, dtype="<f8"))
        body = element(6, struct.pack("<II", 6, 0)) + element(5, np.array(x.shape, dtype="<i4").tobytes()) + element(1, name.encode("ascii")) + element(9, x.tobytes(order="F"))
        out += element(MATRIX, body)
    return out


def as_mat(recordings: DataFrame) -> DataFrame:
    """name, content: a MAT file's bytes for each recording (name, feats array<array<double>>, curr_sample_rate, patient_id; label array<double>, if it is there), as those files hold them."""
    columns = ["name", "feats", "curr_sample_rate", "patient_id", *(["label"] if "label" in recordings.columns else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for row in frame.to_dict("records"):
                held = {"feats": np.array([list(x) for x in row["feats"]]), "curr_sample_rate": row["curr_sample_rate"], "patient_id": row["patient_id"]}
                made.append(mat_bytes(held | ({"label": row["label"]} if "label" in row else {})))
            yield pd.DataFrame({"name": frame["name"], "content": made})

    return recordings.select(*columns).mapInPandas(run, "name string, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write files (name, content) in a folder of any file system that Spark knows; returns its manifest: name, bytes, crc32.

    Each task writes its own rows through Hadoop. A file gets its name when it is whole, so a task that is killed, or run twice, leaves
    none in part under its name. The manifest is a table of what tasks that have ended wrote, and is there when all have; a file of a name that is there is replaced.
    """
    # Spark's own writers have no format for files of raw bytes, so content goes by way of pyarrow's file systems
    from pyarrow import fs

    spark = files.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                own = f"{base}/_{uuid.uuid4().hex}"  # hidden from readers
                with system.open_output_stream(own) as out:
                    out.write(content)
                try:
                    system.move(own, f"{base}/{name}")
                except OSError:  # some file systems don't replace
                    system.delete_file(f"{base}/{name}")
                    system.move(own, f"{base}/{name}")
            yield pd.DataFrame({"name": frame["name"], "bytes": [len(x) for x in frame["content"]], "crc32": [zlib.crc32(x) for x in frame["content"]]})

    path = f"{folder}/_manifest"
    files.select("name", "content").mapInPandas(run, "name string, bytes long, crc32 long").write.mode("overwrite").parquet(path)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes, crc32 of the files that a finished write_files() has put in a folder."""
    return spark.read.parquet(f"{folder}/_manifest")


def altered(spark: SparkSession, folder: str) -> DataFrame:
    """name, why: files of the manifest that are not there (`missing`) or not what was written (`changed`)."""
    there = _files(spark, folder, "*").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.crc32("content").alias("_crc32"))
    why = F.when(F.col("_crc32").isNull(), "missing").when(F.col("_crc32") != F.col("crc32"), "changed")
    return manifest(spark, folder).join(there, "name", "left").select("name", why.alias("why")).where("why is not null")
