"""Readers and writers: tables, JSON lines, wearable CSV, prompts, index directories."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = (
    "id string, society string, doc_title string, version string, status string, topic string, section string, class string, recommendation_class string, LOE string, "
    "level_of_evidence string, citation string, text string, lang string, effective_date string, supersedes array<string>, superseded_by array<string>, verified boolean"
)
#: Fixed: channels of the wearable's CSV, in order.
CHANNELS = ("V6", "I", "II", "V1", "V2", "V3", "V4", "V5")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where the session names none, a local master (as in tests) gets a folder of this machine; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (named or _of_this_machine()).rstrip("/")


@lru_cache(maxsize=1)
def _of_this_machine() -> str:
    made = tempfile.mkdtemp(prefix="pulsegrid-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def head(rows: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """The first n rows of a dataset in a stated order; all without n."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank and // lines are skipped, bad JSON fails."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '//')")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def records(raw: DataFrame) -> DataFrame:
    """Guideline records with their defaults; a missing id fails."""
    text = lambda c, other="": F.coalesce(F.col(c), F.lit(other)).alias(c)
    pick = lambda a, b, name: F.coalesce(F.col(a), F.col(b), F.lit("")).alias(name)
    none = F.array().cast("array<string>")
    return raw.select(
        F.when(F.coalesce("id", F.lit("")) == "", F.raise_error(F.lit("a record has no id")).cast("string")).otherwise(F.col("id")).alias("id"),
        *(text(c) for c in ("society", "doc_title", "version")), text("status", "current"), *(text(c) for c in ("topic", "section")),
        pick("class", "recommendation_class", "class"), pick("LOE", "level_of_evidence", "LOE"), *(text(c) for c in ("citation", "text")), text("lang", "zh"), text("effective_date"),
        F.coalesce("supersedes", none).alias("supersedes"), F.coalesce("superseded_by", none).alias("superseded_by"), F.coalesce("verified", F.lit(False)).alias("verified"),
    )


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Guideline records of a JSON-lines file."""
    return records(json_lines(spark, path, RECORD))


def corpus_version(spark: SparkSession, path: str) -> str:
    """corpus_version of a manifest; "unknown" where there is no file or it doesn't say."""
    if not exists(spark, path):
        return "unknown"
    row = spark.read.schema("corpus_version string").option("multiLine", True).json(path).first()
    return row[0] if row and row[0] else "unknown"


def wearable(spark: SparkSession, path: str) -> DataFrame:
    """The eight channels of a wearable's CSV: by name, by name and `_mV`, else the last eight numeric columns."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    for names in (CHANNELS, tuple(f"{c}_mV" for c in CHANNELS)):
        if set(names) <= set(rows.columns):
            return rows.select(*(F.col(n).cast("double").alias(c) for n, c in zip(names, CHANNELS, strict=True)))
    numeric = [c for c, kind in rows.dtypes if kind in ("int", "bigint", "float", "double") or kind.startswith("decimal")][-8:]
    if len(numeric) < 8:
        raise ValueError("eight numeric columns are needed")
    return rows.select(*(F.col(f"`{n}`").cast("double").alias(c) for n, c in zip(numeric, CHANNELS, strict=True)))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """section, text of a file of `[SECTION]` headers; lines are trimmed and blank ones dropped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).select("n", F.trim("line").alias("line")).where("line <> ''")
    header = F.col("line").rlike(r"^\[.+\]$")
    held = lines.withColumn("section", F.last(F.when(header, F.regexp_extract("line", r"^\[(.+)\]$", 1)), ignorenulls=True).over(Window.orderBy("n")))  # one small file
    return held.where(~header & F.col("section").isNotNull()).groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n").alias("text"))


def responses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Model responses of a .jsonl file, a .json array or what was appended; no rows where there is no file."""
    if exists(spark, f"{path}/commits"):
        return appended(spark, path, schema)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", not path.endswith(".jsonl")).json(path)


def encoder_text(text: Column, section: Column) -> Column:
    """What an encoder gets of a record: its text and section, with a blank between them."""
    return F.trim(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(section, F.lit(""))))


def write_index(records_: DataFrame, path: str, vectors: DataFrame | None = None, encode: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """An index directory: records, unit vectors if there are any, and a manifest with a checksum of the records.

    The vectors are given, or what `encode` makes of the records with the column `encoder_text` (text and section).
    """
    records_.write.mode("overwrite").parquet(f"{path}/records")
    if encode:
        vectors = encode(records_.withColumn("encoder_text", encoder_text(F.col("text"), F.col("section"))))
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/embeddings")
    saved = records_.sparkSession.read.parquet(f"{path}/records")
    checksum(saved).withColumn("dense", F.lit(vectors is not None)).write.mode("overwrite").json(f"{path}/manifest")


def checksum(rows: DataFrame, *columns: str) -> DataFrame:
    """count, sha256: of the rows' own sha256, summed, so that no order or place matters."""
    own = F.sha2(F.to_json(F.struct(*(columns or rows.columns))), 256)
    parts = rows.select(*(F.conv(F.substring(own, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(5)))
    sums = parts.agg(F.count("*").alias("count"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(5)))
    return sums.select("count", F.sha2(F.concat_ws(",", *(F.col(f"p{i}").cast("string") for i in range(5))), 256).alias("sha256"))


def read_index(spark: SparkSession, path: str, dense: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """records, and vectors where they are wanted, the manifest has them and they are there; else a search is BM25's alone."""
    rows = spark.read.parquet(f"{path}/records")
    if not dense or not exists(spark, f"{path}/embeddings"):
        return rows, None
    has = not exists(spark, f"{path}/manifest") or spark.read.json(f"{path}/manifest").select("dense").first()[0]
    return rows, spark.read.parquet(f"{path}/embeddings") if has else None


def unit(vector: Column) -> Column:
    """A vector over its length."""
    return F.transform(vector, lambda x: x / F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))))


def tool_outputs(spark: SparkSession, classes: str, measurements: str) -> tuple[DataFrame, DataFrame]:
    """Both CSV files of precomputed outputs, with a header; either one missing is an error."""
    shape = "ecg_file_path string, PR_Interval_ms double, QTc_ms double, QRS_Duration_ms double, Heart_Rate double, error string"
    read = spark.read.option("header", True)
    return read.schema("ecg_file_path string, top_classes string").csv(classes), read.option("enforceSchema", False).schema(shape).csv(measurements)


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """code, description of a CSV with a header whose first two columns they are, whatever their names; of a repeated code the last counts."""
    rows = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    # a file of one small list, which one task reads in order
    listed = rows.select(F.trim("_c0").alias("code"), F.trim(F.coalesce("_c1", F.lit(""))).alias("description"), F.monotonically_increasing_id().alias("_n"))
    return listed.where("_n > 0 and code is not null").groupBy("code").agg(F.max_by("description", "_n").alias("description"))


def code_lists(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, scp_codes (a literal of codes and likelihoods) of a CSV with a header; rows without a whole number as ecg_id are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col("ecg_id").try_cast("long").alias("recording_id"), "scp_codes").where("recording_id is not null and scp_codes is not null")


def measurements(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """ecg_id and these columns, as text, of a CSV with a header; a column that the file doesn't have is null."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select("ecg_id", *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))


def newest(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str | None:
    """The path of the file that was changed last (of the same time, the last by name); contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def arriving(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of the CSV files (with a header) that arrive in a folder."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_a_batch).csv(folder)


def write_report(rows: DataFrame, path: str) -> None:
    """CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_lines(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """JSON lines added to those that are there, once for each name of a batch; each call is a batch of its own without one.

    The rows go to a new folder, and count from when a file of the batch's name, put in place in one step, names it. A run
    that was broken off before that leaves a folder that no reader looks at; a batch that is there already is not written again.
    """
    spark = rows.sparkSession
    batch = re.sub(r"[^A-Za-z0-9_-]", lambda m: f"%{ord(m[0]):x}", batch or uuid.uuid4().hex)
    if exists(spark, f"{path}/commits/{batch}"):
        return
    part = f"part-{uuid.uuid4().hex}"
    rows.write.json(f"{path}/parts/{part}")
    commit(spark, f"{path}/commits/{batch}", part)


def commit(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place by renaming it, so that it is whole or not there; False if there is one already, which stays."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    target, own = place(path), place(f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    done = not system.exists(target) and system.rename(own, target)
    if not done:
        system.delete(own, False)
    return done


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON lines of all batches that were committed; no rows where there are none."""
    if not exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], schema)
    parts = [r[0] for r in spark.read.text(f"{path}/commits").collect()]  # one for each batch
    return spark.read.schema(schema).json([f"{path}/parts/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def appending(path: str, job: str):
    """For foreachBatch: each micro-batch of the job is appended once, however often it is run."""
    return lambda rows, number: append_lines(rows, path, f"{job}-{number}")


def log_calls(calls: DataFrame, path: str, batch: str | None = None) -> None:
    """Tool calls (tool_call_id, name, args, content) with the time of logging, added to those that are there; once for each name of a batch."""
    append_lines(calls.select("tool_call_id", "name", "args", "content", F.current_timestamp().alias("timestamp")), path, batch)
