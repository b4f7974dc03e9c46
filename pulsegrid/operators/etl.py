"""Batch jobs: labels, grouped splits, manifests, lookups, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..sources import binary, settled


def literal_map(text: Column) -> Column:
    """A dict literal of codes and likelihoods as map<string, double>; null where it is none.

    Keys stand in quotes of either kind, and an apostrophe inside of double quotes is a part of the key.
    """
    # JSON's own reader knows both kinds of quotes
    return F.from_json(text, "map<string,double>", {"allowSingleQuotes": "true"})


def labelled(records: DataFrame, codes: DataFrame, labels: list[str]) -> DataFrame:
    """records with the multi-hot vector of their codes (recording_id, scp_codes); records without codes are dropped."""
    known = codes.select("recording_id", F.map_keys(literal_map(F.col("scp_codes"))).alias("codes"))
    return records.join(known, "recording_id").withColumn("label", arrays.multi_hot(F.col("codes"), labels)).drop("codes")


def grouped_split(rows: DataFrame, group: str, test: float, valid: float, seed: int = 42) -> DataFrame:
    """rows with `split`; all rows of a group fall in one, int(n * test) groups in test, then int(n * valid) in valid.

    Groups are ordered by the md5 of seed and group. Their ranks come from ranges of the md5's first
    byte and within them, so that no task sorts all groups.
    """
    key = F.md5(F.concat(F.lit(str(seed)), F.col(group).cast("string")))
    groups = rows.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 2))
    sizes = groups.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key", group))
    place = groups.join(F.broadcast(before), "_range").withColumn("_place", F.col("_before") + inside)  # at most 256 ranges
    n_test, n_valid = F.floor(F.col("_n") * test), F.floor(F.col("_n") * valid)
    split = F.when(F.col("_place") <= n_test, "test").when(F.col("_place") <= n_test + n_valid, "valid").otherwise("train")
    return rows.join(place.select(group, split.alias("split")), group)


def first_match(rows: DataFrame, lookup: DataFrame, key: str, order: str, value: str, missing: str) -> DataFrame:
    """rows with `value` of the first lookup row of their key, or `missing`."""
    first = lookup.groupBy(key).agg(F.min_by(value, order).alias(value))
    return rows.join(first, key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def manifest(files: DataFrame, root: str) -> DataFrame:
    """place, line: the root at place 0, then relative path and count, by tab, in the order of paths (path, n).

    Places come from ranges of the path, so no task sorts all. A path that is not below the root stays as it is. The ranges are drawn once and
    kept by a checkpoint, as their bounds come from a sample that is another one each time that they are drawn.
    """
    below = root.rstrip("/") + "/"
    relative = F.when(F.startswith("path", F.lit(below)), F.substr("path", F.lit(len(below) + 1))).otherwise(F.col("path"))
    rows = settled(files.select(relative.alias("path"), "n").repartitionByRange("path").select("*", F.spark_partition_id().alias("_part")))
    inside = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("path", "n")))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    lines = inside.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_nth")).alias("place"), F.concat_ws("\t", "path", F.col("n").cast("string")).alias("line"))
    return files.sparkSession.createDataFrame([(0, root)], "place long, line string").unionByName(lines)


def preprocessed(recordings: DataFrame, patients: DataFrame, leads: list[int], fs: int | None = None) -> DataFrame:
    """recordings (recording_id, fs, leads array<array<double>>) with their patient and the chosen leads only.

    A recording goes if its id is not known (patients: recording_id, patient_id), its rate is not the one asked for, or a sample of any lead is null or NaN.
    """
    broken = F.exists("leads", lambda lead: F.exists(lead, lambda x: x.isNull() | F.isnan(x)))
    kept = recordings.where(~broken) if fs is None else recordings.where((F.col("fs") == fs) & ~broken)
    chosen = F.array(*(F.get("leads", F.lit(i)) for i in leads))
    known = patients.groupBy("recording_id").agg(F.min("patient_id").alias("patient_id"))
    return kept.join(known, "recording_id").withColumn("leads", chosen)


def raw_to_mat(spark: SparkSession, raw: str, patients: DataFrame, codes: DataFrame, labels: list[str], leads: list[int], out: str, fs: int | None = None) -> DataFrame:
    """From a folder of WFDB records to one of labelled MAT files, in one job; returns its manifest (name, bytes, crc32).

    Records go as in preprocessed() and, without codes, as in labelled(). A record's id is its name's number, without leading zeros and the
    `_hr` or `_lr` behind it; the file is HR<id>.mat, and the patient a number.
    """
    read = binary.wfdb(spark, raw).select(F.regexp_extract("record", r"^0*(\d+?)(?:_[hl]r)?$", 1).alias("recording_id"), "fs", "leads")
    kept = preprocessed(read, patients.withColumn("recording_id", F.col("recording_id").cast("string")), leads, fs)
    made = labelled(kept, codes.withColumn("recording_id", F.col("recording_id").cast("string")), labels)
    named = made.select(F.concat(F.lit("HR"), "recording_id", F.lit(".mat")).alias("name"), F.col("leads").alias("feats"), F.col("fs").alias("curr_sample_rate"), F.col("patient_id").cast("double").alias("patient_id"), F.col("label").cast("array<double>").alias("label"))
    return binary.write_files(binary.as_mat(named), out)


def shortest_queue(workers: DataFrame, group: str | None = None) -> DataFrame:
    """The worker with the least queue_length / speed, the smaller worker_id on ties; those without speed don't count."""
    keys = [group] if group else []
    alive = workers.where("speed > 0")
    return alive.groupBy(*keys).agg(F.min_by("worker_id", F.struct((F.col("queue_length") / F.col("speed")).alias("wait"), "worker_id")).alias("worker_id"))


def top_classes(rows: DataFrame, key: str, label: str, prob: str, threshold: float, k: int) -> DataFrame:
    """The k likeliest labels above the threshold for each key, ties by label."""
    order = Window.partitionBy(key).orderBy(F.desc(prob), label)
    return rows.where(F.col(prob) > threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
