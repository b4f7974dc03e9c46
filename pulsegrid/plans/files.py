"""Queries through files: tables written in each format that a reader reads, and read again, in the catalog's registry."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import dialogue, etl, evaluation
from ..sources import binary, table
from .catalog import query, r6, records, signals, vectors
from .evaluation import MEASURED, measured


#: The folders that the query that is being built has made.
made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for as long as a query is built."""
    made.append(f"{sources.shared_folder(spark)}/files-{uuid.uuid4().hex}")
    return f"{made[-1]}/{name}"


def filed(sql: str):
    """query(), for one that writes files: its jobs run when it is built, its rows are settled, and its files removed."""

    def keep(build):
        @wraps(build)
        def run(spark, d):
            made.clear()
            try:
                return sources.settled(build(spark, d))
            finally:
                for folder in made:
                    sources.remove(spark, folder)

        return query(sql)(run)

    return keep


def lines(rows, path: str) -> str:
    """Rows of one string column as a text file's lines."""
    rows.write.text(path)
    return path


@filed("SELECT 'd' || doc_id AS id, source AS society, CASE WHEN doc_id % 10 = 0 THEN 'superseded' ELSE 'current' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'zh' ELSE lang END AS lang, md5(text) AS text, CASE WHEN doc_id % 10 = 0 THEN 'd' || (doc_id + 1) ELSE '' END AS later, 'I' AS \"class\" FROM documents")
def corpus_file(spark, d):
    rows = records(spark, d).select(
        F.concat(F.lit("d"), "doc_id").alias("id"), "society", "text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.when(F.col("status") != "current", F.col("status")).alias("status"),
        F.when(F.size("superseded_by") > 0, F.transform("superseded_by", lambda x: F.concat(F.lit("d"), x))).alias("superseded_by"), F.lit("I").alias("recommendation_class"), F.lit(1).alias("unknown"),
    )
    path = lines(rows.select(F.concat(F.when(F.hash("id") % 2 == 0, F.lit("// a note\n\n")).otherwise(""), F.to_json(F.struct("*"))).alias("value")), scratch(spark, "corpus"))
    return sources.corpus(spark, path).select("id", "society", "status", "lang", F.md5(F.col("text").cast("binary")).alias("text"), F.array_join("superseded_by", ",").alias("later"), "class")


@filed("SELECT doc_id, d.lang, round(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v)), 4) AS norm FROM documents d LEFT JOIN embeddings ON vec_id = doc_id")
def index_files(spark, d):
    path = scratch(spark, "index")
    sources.write_index(table(spark, d, "documents").select("doc_id", "lang"), path, vectors(spark, d).select("doc_id", sources.unit(F.transform("embedding", lambda v: v.cast("double") * 3)).alias("embedding")))
    rows, near = sources.read_index(spark, path)
    norm = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v), 4)
    return rows.join(near, "doc_id", "left").select("doc_id", "lang", norm.alias("norm"))


@filed("""WITH h AS (SELECT sha256('{"doc_id":' || doc_id || CASE WHEN lang IS NULL THEN '' ELSE ',"lang":"' || lang || '"' END || '}') AS h FROM documents),
p AS (SELECT i, sum(('0x' || h[1 + 12 * i : 12 + 12 * i])::BIGINT::HUGEINT) AS s FROM h, (SELECT unnest(range(0, 5)) AS i) GROUP BY 1)
SELECT (SELECT count(*) FROM h) AS n, sha256(string_agg(s::VARCHAR, ',' ORDER BY i)) AS sha256, true AS same, true AS bm25_only FROM p""")
def index_checksum(spark, d):
    path, rows = scratch(spark, "index"), table(spark, d, "documents").select("doc_id", "lang")
    sources.write_index(rows, path)
    again, near = sources.read_index(spark, path)
    one, two = spark.read.json(f"{path}/manifest"), sources.checksum(again.repartition(3))
    return one.alias("a").join(two.alias("b"), "count").select(F.col("count").alias("n"), "a.sha256", (F.col("a.sha256") == F.col("b.sha256")).alias("same"), F.lit(near is None).alias("bm25_only"))


@filed("SELECT vec_id, " + ", ".join(f"round(x[{i}], 6) AS \"{c}\"" for i, c in enumerate(("V6", "I", "II", "V1", "V2", "V3", "V4", "V5"), 1)) + " FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)")
def wearable_file(spark, d):
    path = scratch(spark, "wearable")
    names = sources.CHANNELS
    rows = signals(spark, d).select(F.lit("x").alias("time"), F.col("vec_id").alias("note"), *(r6(F.col("x")[i]).alias(f"{c}_mV") for i, c in enumerate(names)))
    rows.write.option("header", True).csv(path)
    # what was read has no id: it is found again by all its values, as whole numbers
    whole = lambda c: F.round(F.col(c) * 1000000).cast("long")
    back = sources.wearable(spark, path).select(*names, *(whole(c).alias(f"k{c}") for c in names))
    return back.join(rows.select(F.col("note").alias("vec_id"), *(whole(f"{c}_mV").alias(f"k{c}") for c in names)), [f"k{c}" for c in names]).select("vec_id", *(r6(c).alias(c) for c in names))


@filed("SELECT 'HR' || c_custkey || '.mat' AS ecg_file_path, '[''' || c_mktsegment || '(0.50)'']' AS top_classes, CASE WHEN c_custkey % 4 <> 0 THEN round(c_acctbal, 2) END AS PR_Interval_ms, CASE WHEN c_custkey % 4 = 0 THEN 'none' END AS error FROM customer")
def tool_output_files(spark, d):
    classes, measurements = scratch(spark, "classes"), scratch(spark, "measurements")
    named = table(spark, d, "customer").withColumn("ecg_file_path", F.concat(F.lit("HR"), "c_custkey", F.lit(".mat")))
    sources.write_report(named.select("ecg_file_path", F.concat(F.lit("['"), "c_mktsegment", F.lit("(0.50)']")).alias("top_classes")), classes)
    good = F.col("c_custkey") % 4 != 0
    sources.write_report(named.select("ecg_file_path", F.when(good, F.round("c_acctbal", 2)).alias("PR_Interval_ms"), *(F.lit(None).cast("double").alias(c) for c in ("QTc_ms", "QRS_Duration_ms", "Heart_Rate")), F.when(~good, "none").alias("error")), measurements)
    one, two = sources.tool_outputs(spark, classes, measurements)
    return one.join(two, "ecg_file_path").select("ecg_file_path", "top_classes", "PR_Interval_ms", "error")


@filed("SELECT conv_id, turn, md5(text) AS text, 'a' AS model FROM conversations")
def response_files(spark, d):
    shape = "conv_id long, turn long, text string, model string"
    rows = table(spark, d, "conversations").withColumn("model", F.lit("a"))
    path = scratch(spark, "a.jsonl")
    # in two batches, the first of them run twice, as a run that was broken off is gone on with
    for batch, part in (("one", "turn % 3 = 1"), ("one", "turn % 3 = 1"), ("two", "turn % 3 <> 1")):
        sources.append_lines(rows.where(part), path, batch)
    every = sources.responses(spark, path, shape).unionByName(sources.responses(spark, scratch(spark, "absent.json"), shape))
    return every.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text"), "model")


@filed("SELECT n_name AS section, n_nationkey || chr(10) || 'of ' || n_regionkey AS text FROM nation")
def prompt_file(spark, d):
    lists = table(spark, d, "nation").select(F.concat(F.lit("["), "n_name", F.lit("]\n "), "n_nationkey", F.lit(" \n\nof "), "n_regionkey", F.lit("\n")).alias("value"))
    whole = lists.agg(F.concat(F.lit("before any\n"), F.array_join(F.collect_list("value"), "")).alias("value"))  # 25 sections
    return sources.prompts(spark, lines(whole, scratch(spark, "prompts")))


@filed("SELECT user_id AS tool_call_id, event_type AS name, count(*)::VARCHAR AS content, true AS stamped FROM events GROUP BY 1, 2")
def tool_call_log(spark, d):
    path = scratch(spark, "calls")
    calls = table(spark, d, "events").groupBy(F.col("user_id").alias("tool_call_id"), F.col("event_type").alias("name")).agg(F.lit("{}").alias("args"), F.count("*").cast("string").alias("content"))
    sources.log_calls(calls, path)
    return sources.appended(spark, path, "tool_call_id long, name string, args string, content string, timestamp timestamp").select("tool_call_id", "name", "content", F.col("timestamp").isNotNull().alias("stamped"))


@filed("SELECT s_suppkey, round(s_acctbal, 2) AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def newest_file(spark, d):
    path = scratch(spark, "arriving")
    for part in (1, 0):
        table(spark, d, "supplier").where(f"s_suppkey % 2 = {part}").select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal")).coalesce(1).write.mode("append").option("header", True).csv(path)
    return spark.read.schema("s_suppkey long, s_acctbal double").option("header", True).csv(sources.newest(spark, path))


@query("SELECT conv_id, turn FROM conversations ORDER BY conv_id DESC, turn LIMIT 25")
def dataset_head(spark, d):
    rows = table(spark, d, "conversations").withColumn("newest", -F.col("conv_id"))
    return sources.head(sources.head(rows, ["turn"]), ["newest", "turn"], 25).select("conv_id", "turn")


def folder_of(path: str) -> str:
    """A local folder as a URI; others are."""
    return path if "://" in path else f"file://{path}"


def by_sample(rows, *keys):
    """keys, lead, place, x (in millionths) of leads."""
    spread = rows.select(*keys, F.posexplode("leads").alias("lead", "x"))
    return spread.select(*keys, "lead", F.posexplode("x").alias("place", "x")).withColumn("x", F.round(F.col("x") * 1000000).cast("long"))


LEADS = "SELECT vec_id, l::INT AS lead, p::INT AS place, x[l * 32 + p + 1] AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), (SELECT unnest(range(0, 2)) AS l), (SELECT unnest(range(0, 32)) AS p)"


def two_leads(spark, d):
    return signals(spark, d).select("vec_id", F.array(F.slice("x", 1, 32), F.slice("x", 33, 32)).alias("leads"))


@filed(f"SELECT 'HR' || vec_id || '.mat' AS file, lead, place, round(x * 1000000)::BIGINT AS x, 500.0 AS fs FROM ({LEADS})")
def mat_files(spark, d):
    path = folder_of(scratch(spark, "mat"))
    rows = two_leads(spark, d).select(F.concat(F.lit("HR"), "vec_id", F.lit(".mat")).alias("name"), F.col("leads").alias("feats"), F.lit(500.0).alias("curr_sample_rate"), F.col("vec_id").cast("double").alias("patient_id"))
    binary.write_files(binary.as_mat(rows), path)
    back = binary.mat(spark, path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("arrays")["feats"]["values"].alias("v"), F.col("arrays")["curr_sample_rate"]["values"][0].alias("fs"))
    return by_sample(back.select("file", "fs", F.array(F.slice("v", 1, 32), F.slice("v", 33, 32)).alias("leads")), "file", "fs")


@filed(f"SELECT 'r' || vec_id AS record, lead, place, 250.0 AS fs, CASE WHEN place <> 3 THEN round((round(x * 1000)::BIGINT - CASE WHEN lead = 0 THEN 12 ELSE -5 END) / CASE WHEN lead = 0 THEN 200.0 ELSE 1000.0 END * 1000000)::BIGINT END AS x FROM ({LEADS})")
def wfdb_files(spark, d):
    path = folder_of(scratch(spark, "wfdb"))

    def record(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            names, contents = [], []
            for vec_id, leads in zip(frame["vec_id"], frame["leads"], strict=True):
                kind = "16" if vec_id % 2 else "212"
                x = np.sign(lead := np.array([list(v) for v in leads])) * np.floor(np.abs(lead) * 1000 + 0.5)
                x = x.astype(np.int64).T
                x[3] = -32768 if kind == "16" else -2048
                flat = x.ravel() & 0xFFF
                low, high = flat[::2], flat[1::2]
                data = x.astype("<i2").tobytes() if kind == "16" else np.stack([low & 0xFF, low >> 8 | high >> 8 << 4, high & 0xFF], axis=1).astype(np.uint8).tobytes()
                names += [f"r{vec_id}.hea", f"r{vec_id}.dat"]
                contents += [f"# a record\nr{vec_id} 2 250 32\nr{vec_id}.dat {kind} 200(12)/mV 16 0 0 0 0 I\nr{vec_id}.dat {kind} 1000/mV 16 -5 0 0 0 II\n".encode(), data]
            yield pd.DataFrame({"name": names, "content": contents})

    binary.write_files(two_leads(spark, d).mapInPandas(record, "name string, content binary"), path)
    back = binary.wfdb(spark, path).withColumn("leads", F.transform("leads", lambda x: F.transform(x, lambda v: F.when(~F.isnan(v), v))))
    return by_sample(back, "record", "fs")


@filed(f"SELECT vec_id || '.npy' AS file, lead, place, round(x * 1000000)::BIGINT AS x FROM ({LEADS})")
def npy_files(spark, d):
    path = folder_of(scratch(spark, "npy"))

    def array(frames):
        import io

        import numpy as np
        import pandas as pd

        for frame in frames:
            contents = []
            for leads in frame["leads"]:
                out = io.BytesIO()
                np.save(out, np.array([list(v) for v in leads]))
                contents.append(out.getvalue())
            yield pd.DataFrame({"name": frame["vec_id"].astype(str) + ".npy", "content": contents})

    binary.write_files(two_leads(spark, d).mapInPandas(array, "name string, content binary"), path)
    back = binary.npy(spark, path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("values").alias("v"))
    return by_sample(back.select("file", F.array(F.slice("v", 1, 32), F.slice("v", 33, 32)).alias("leads")), "file")


@filed("""WITH s AS (SELECT vec_id, lpad(vec_id::VARCHAR, 5, '0') AS name, CASE WHEN vec_id % 4 = 0 THEN 250 ELSE 500 END AS fs, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT user_id AS vec_id, max((event_type = 'view')::INT) AS v, max((event_type = 'error')::INT) AS r FROM events GROUP BY 1)
SELECT 'HR' || vec_id || '.mat' AS file, 500.0 AS fs, (vec_id % 40)::DOUBLE AS patient, [v, r]::DOUBLE[]::VARCHAR AS label, md5(array_to_string(list_transform(range(0, 32), lambda i: round(x[33 + i] * 1000)::BIGINT), ',')) AS feats FROM s JOIN e USING (vec_id) WHERE vec_id % 4 <> 0 AND vec_id % 3 <> 0 AND vec_id % 11 <> 1""")
def raw_to_mat(spark, d):
    """WFDB records of all signals, made into labelled MAT files of the second lead in one job, and read again."""
    raw, out = folder_of(scratch(spark, "raw")), folder_of(scratch(spark, "mat"))

    def record(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            names, contents = [], []
            for vec_id, leads in zip(frame["vec_id"], frame["leads"], strict=True):
                lead = np.array([list(v) for v in leads])
                x = (np.sign(lead) * np.floor(np.abs(lead) * 1000 + 0.5)).astype("<i2").T
                if vec_id % 11 == 1:
                    x[5, 0] = -32768  # no sample
                name, rate = f"{vec_id:05d}_hr", 250 if vec_id % 4 == 0 else 500
                names += [f"{name}.hea", f"{name}.dat"]
                contents += [f"{name} 2 {rate} 32\n{name}.dat 16 1000/mV 16 0 0 0 0 I\n{name}.dat 16 1000/mV 16 0 0 0 0 II\n".encode(), x.tobytes()]
            yield pd.DataFrame({"name": names, "content": contents})

    binary.write_files(two_leads(spark, d).mapInPandas(record, "name string, content binary"), raw)
    events = table(spark, d, "events")
    codes = events.groupBy(F.col("user_id").alias("recording_id")).agg(F.concat(F.lit("{"), F.array_join(F.collect_set(F.concat(F.lit("'"), "event_type", F.lit("': 100.0"))), ", "), F.lit("}")).alias("scp_codes"))
    patients = signals(spark, d).where("vec_id % 3 <> 0").select(F.col("vec_id").alias("recording_id"), (F.col("vec_id") % 40).alias("patient_id"))
    made = etl.raw_to_mat(spark, raw, patients, codes, ["view", "error"], [1], out, 500)
    back = binary.mat(spark, out).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "arrays").join(made.select(F.col("name").alias("file")), "file")
    of = lambda name: F.col("arrays")[name]["values"]
    feats = F.md5(F.array_join(F.transform(of("feats"), lambda v: F.round(v * 1000).cast("long").cast("string")), ",").cast("binary"))
    return back.select("file", of("curr_sample_rate")[0].alias("fs"), of("patient_id")[0].alias("patient"), F.concat(F.lit("["), F.array_join(F.transform(of("label"), lambda v: v.cast("string")), ", "), F.lit("]")).alias("label"), feats.alias("feats"))


FRAMES = """WITH s AS (SELECT vec_id, vec_id % 7 AS device_id, (vec_id // 7) * 8 + CASE WHEN vec_id // 7 % 5 = 4 THEN -3 WHEN vec_id // 7 % 5 = 2 THEN 2 ELSE 0 END AS first_index, embedding::DOUBLE[] AS x FROM embeddings),
c AS (SELECT s.*, list_transform(range(0, 8), lambda ch: list_transform(range(0, 8), lambda p: greatest(-60, least(60, round(x[ch * 8 + p + 1] * 20)))::BIGINT)) AS channels, CASE vec_id % 13 WHEN 5 THEN 'no waveform begins' WHEN 6 THEN '55 differences for 8 samples' END AS error FROM s)"""


def wearable_frames(spark, d):
    """embeddings as frames of eight channels of eight samples, some with gaps, overlaps or broken bytes."""
    from ..sources import frames

    k = F.floor(F.col("vec_id") / 7)
    shift = F.when(k % 5 == 4, -3).when(k % 5 == 2, 2).otherwise(0)
    rows = signals(spark, d).select("vec_id", (F.col("vec_id") % 7).alias("device_id"), (k * 8 + shift).alias("first_index"), F.transform("x", lambda v: F.greatest(F.lit(-60), F.least(F.lit(60), F.round(v * 20))).cast("int")).alias("x"))

    def encoded(batches):
        import numpy as np

        for frame in batches:
            contents = []
            for vec_id, first, x in zip(frame["vec_id"], frame["first_index"], frame["x"], strict=True):
                content = frames.encoded(np.array(x).reshape(8, 8), max(0, first), hr=60)
                contents.append(content[:50] + b"\0" + content[51:] if vec_id % 13 == 5 else content[:-1] if vec_id % 13 == 6 else content)
            yield frame[["vec_id", "device_id"]].assign(content=contents)

    return frames.frames(rows.where("first_index >= 0").mapInPandas(encoded, "vec_id long, device_id long, content binary"))


@query(f"{FRAMES} SELECT vec_id, device_id, first_index, 8 AS count, 60 AS hr, error, CASE WHEN error IS NULL THEN array_to_string(list_transform(channels, lambda c: array_to_string(c, ',')), ';') END AS samples FROM c WHERE first_index >= 0")
def frames_decoded(spark, d):
    joined = F.array_join(F.transform("channels", lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")), ";")
    return wearable_frames(spark, d).select("vec_id", "device_id", "first_index", "count", "hr", "error", joined.alias("samples"))


@query(f"""{FRAMES}, g AS (SELECT *, coalesce(max(first_index + 8) OVER (PARTITION BY device_id ORDER BY first_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_index) AS seen FROM c WHERE first_index >= 0 AND error IS NULL),
k AS (SELECT *, least(8, greatest(0, seen - first_index)) AS known FROM g)
SELECT vec_id, device_id, greatest(0, first_index - seen) AS missing, known::INT AS known, array_to_string(list_transform(list_transform(channels, lambda c: c[known + 1 :]), lambda c: array_to_string(list_transform(c, lambda v: round(v * 0.002467, 6)::DECIMAL(12,6)), ',')), ';') AS mv FROM k""")
def frames_in_order(spark, d):
    from ..sources import frames

    rows = frames.in_order(wearable_frames(spark, d))
    text = F.array_join(F.transform(frames.millivolts(F.col("channels")), lambda c: F.array_join(F.transform(c, lambda v: F.round(v, 6).cast("decimal(12,6)").cast("string")), ",")), ";")
    return rows.select("vec_id", "device_id", "missing", "known", text.alias("mv"))


@filed("""WITH b AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2), l AS (SELECT user_id, event_type, CASE WHEN v >= 50 THEN round(v) ELSE 0 END AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS n FROM b)
SELECT user_id AS recording_id, string_agg(event_type || ' (' || CASE event_type WHEN 'click' THEN 'a "click", twice' WHEN 'view' THEN 'a view' ELSE event_type END || ')' || CASE WHEN p > 0 THEN ' [likelihood ' || p::INT || '%]' ELSE '' END, '; ' ORDER BY n) AS text FROM l GROUP BY 1""")
def truth_files(spark, d):
    """Truth texts from CSV files of descriptions and of codes."""
    described, codes = scratch(spark, "statements"), scratch(spark, "database")
    listed = [',description,kind', 'click,"a ""click"", twice",x', ' view ,an old view', 'view, a view ,']
    lines(spark.createDataFrame([(x,) for x in ["\n".join(listed)]], "value string").coalesce(1), described)
    best = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v")).withColumn("p", F.when(F.col("v") >= 50, F.round("v", 0)).otherwise(0.0))
    item = F.transform(F.array_sort(F.collect_list(F.struct("event_type", F.concat(F.lit("'"), "event_type", F.lit("': "), F.col("p").cast("string")).alias("item")))), lambda x: x.item)
    held = best.groupBy(F.col("user_id").cast("string").alias("ecg_id")).agg(F.concat(F.lit("{"), F.array_join(item, ", "), F.lit("}")).alias("scp_codes"))
    sources.write_report(held.withColumn("age", F.lit(1)).unionByName(spark.createDataFrame([("none", "{}", 2)], "ecg_id string, scp_codes string, age int")), codes)
    return evaluation.truth_text(sources.code_lists(spark, codes), sources.descriptions(spark, described))


@filed("SELECT doc_id, md5(trim(d.text || ' ' || coalesce(lang, ''))) AS encoded, length(trim(d.text || ' ' || coalesce(lang, '')))::DOUBLE AS size FROM documents d")
def encoded_index(spark, d):
    """An index whose vectors an encoder makes of text and section."""
    path = scratch(spark, "index")
    rows = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("section"))
    encode = lambda r: r.select("doc_id", F.md5(F.col("encoder_text").cast("binary")).alias("encoded"), F.array(F.length("encoder_text").cast("double")).alias("embedding"))
    sources.write_index(rows, path, encode=encode)
    return sources.read_index(spark, path)[1].select("doc_id", "encoded", F.col("embedding")[0].alias("size"))


@query("""WITH t AS (SELECT conv_id, bool_or(role = 'assistant' AND turn % 6 = 1) AS calls, bool_or(role = 'assistant' AND turn % 6 NOT IN (1, 3) AND trim(text) <> '') AS said FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN conv_id % 9 = 4 THEN false ELSE calls END AS calls, CASE WHEN conv_id % 9 = 4 THEN false ELSE said END AS said FROM t""")
def dialogue_filters(spark, d):
    """Which dialogues (JSON, some of it broken) call a tool, and which have an answer."""
    n = F.col("turn") % 6
    action = F.when(F.col("role") != "assistant", None).when(n == 1, dialogue.CLASSIFICATION).when(n == 3, dialogue.FOLLOW_UP).otherwise("response")
    turn = F.struct("turn", F.struct("role", action.alias("action"), F.col("text").alias("content")).alias("t"))
    held = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x.t)).alias("turns"))
    held = held.withColumn("turns", F.when(F.col("conv_id") % 9 == 4, F.concat(F.lit("oops"), "turns")).otherwise(F.col("turns")))
    return held.select("conv_id", dialogue.contains_action(F.col("turns"), dialogue.CLASSIFICATION).alias("calls"), dialogue.answered(F.col("turns")).alias("said"))


@filed(MEASURED)
def measurement_files(spark, d):
    """Measurement texts from a CSV file that lacks a column."""
    path = scratch(spark, "measured")
    sources.write_report(measured(spark, d).drop("QT_Int_Global"), path)
    return evaluation.measurement_text(sources.measurements(spark, path, [m[0] for m in evaluation.MEASUREMENTS]))
