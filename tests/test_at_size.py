"""What showed only on larger tables: queries against their SQL on tables made for it, and the operators under them."""

import duckdb

from pulsegrid.functions import arrays, text
from pulsegrid.operators import etl, reporting, signal
from pulsegrid.plans import catalog
from pyspark.sql import functions as F


def both(spark, folder, name, table, rows, schema):
    """Rows of a query over one table, and of its SQL."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    df = catalog.QUERIES[name](spark, str(folder))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(want, key=repr)


def test_manifest_of_more_paths_than_a_sample_of_ranges_holds(spark):
    n = 200_000
    files = spark.range(n, numPartitions=4).select(F.concat(F.lit("/data/"), F.md5(F.col("id").cast("string")), F.lit(".mat")).alias("path"), "id").withColumnRenamed("id", "n")
    got = sorted(map(tuple, etl.manifest(files, "/data").collect()))
    assert [place for place, _ in got] == list(range(n + 1))
    lines = [line for _, line in got[1:]]
    assert got[0] == (0, "/data") and lines == sorted(lines) and len(set(lines)) == n


def test_record_paths_of_six_digits(spark, tmp_path):
    got, want = both(spark, tmp_path, "record_paths", "customer", [(7,), (99999,), (123456,), (899999,)], "c_custkey long")
    assert got == want and (123456, "12300/12345_hr") in got
    whole = spark.createDataFrame([(7,), (123456,)], "n long").select(reporting.record_path(F.col("n"))).collect()
    assert [r[0] for r in whole] == ["00000/00007_hr", "123000/123456_hr"]


def test_intents_at_letters_outside_ascii_and_at_line_ends(spark, tmp_path):
    texts = ["zéle", "laért", "üdie x", "ofé it.", "the x\r and y", "the x\n and y", "so.\n", "so.", "le", "nothing", None]
    got, want = both(spark, tmp_path, "route_intent", "conversations", [(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string")
    assert got == want and (0, 0, "morphology") in got and (6, 0, None) in got
    assert text.as_re2(r"[$\]]\$a$") == r"(?d)[$\]]\$a\z"


def test_axis_of_a_net_that_rounds_to_a_negative_zero(spark):
    rows = spark.createDataFrame([(-0.1, -0.0003), (-0.1, 0.0003), (0.1, -0.0003), (-0.1, 0.0)], "one double, avf double")
    got = rows.select(arrays.axis_degrees(F.col("one"), signal.rounded(F.col("avf"), 3))).collect()
    assert [r[0] for r in got] == [-180.0, 180.0, 0.0, 180.0]
    assert [str(r[0]) for r in rows.select(signal.rounded(F.col("avf") * 10, 2)).collect()] == ["-0.0", "0.0", "-0.0", "0.0"]


def test_readings_go_by_the_medians_as_shown(spark):
    rows = spark.createDataFrame([(120.00000000001, 199.99999999999, 460.00000000001), (120.0001, 200.0001, 460.0001)], "qrs double, pr double, qtc double")
    got = rows.select(signal.interpretation(F.lit(75.0), F.col("pr"), F.col("qtc"), F.col("qrs")).alias("r")).select("r.*").collect()
    assert [(r.pr, r.qtc, r.qrs) for r in got] == [("Normal", "Normal", "Normal"), ("Prolonged", "Prolonged", "Wide")]


def test_a_qrs_at_its_bound(spark, tmp_path):
    import datetime

    at = [datetime.datetime(2024, 1, 1, 0, 0, s) for s in range(9)]
    rows = [(100 * u + i, at[i], u, v) for u in range(60) for i, v in enumerate([10.01 * u / 7 // 0.01 / 100, 70.0 + u / 100, 86.0 - u / 100])]
    got, want = both(spark, tmp_path, "interval_medians", "events", rows, "event_id long, ts timestamp, user_id long, value double")
    names = catalog.QUERIES["interval_medians"](spark, str(tmp_path)).columns
    readings = [names.index(c) for c in ("recording_id", "rate", "pr", "qtc", "qrs")]
    assert [[r[i] for i in readings] for r in got] == [[r[i] for i in readings] for r in want]


def test_terms_are_counted_by_numbers_as_by_names(spark):
    from pulsegrid.llm import divergence
    from pyspark.sql import Window

    texts = ["The CAT the cat", "ÉTÉ Été été", "Kelvin K İI ΣΑΣ ſ", "", None]
    docs = spark.createDataFrame([(i, t, lang, s) for i, t in enumerate(texts) for lang, s in (("en", "a"), (None, "b"), ("en", None))], "doc_id long, text string, lang string, source string")
    lowered = docs.where("text is not null").select("text", divergence.ascii_lower(F.col("text"))).collect()
    assert all(low == "".join(c.lower() if c < "\x80" else c for c in t) for t, low in lowered)
    numbers = divergence.numbered(docs).withColumn("l", F.dense_rank().over(Window.orderBy("lang")))
    by_number = divergence.term_counts(docs, numbers).join(numbers, ["l", "i"]).select("lang", "source", "term", "n", "docs")
    assert sorted(map(tuple, by_number.collect())) == sorted(map(tuple, divergence.term_counts(docs).collect()))


def test_terms_are_counted_before_they_are_rows(spark, monkeypatch):
    import re
    from collections import Counter

    import pyarrow as pa
    from pulsegrid.llm import divergence, shared

    texts = ["The CAT the cat", "ÉTÉ été x1y don't", "", None, "".join(map(chr, range(256))) + "  日本　a", "a b " * 500]
    rows = [("en", s, t) for s in ("a", "", "b") for t in texts] + [("fr", "a", t) for t in texts]
    # a row for a term of a group, not for each place of it, leaves a task; one shuffle deals the rows
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    numbers = divergence.numbered(docs).withColumn("l", F.when(F.col("lang") == "en", 1).otherwise(2))
    plan = divergence.term_counts(docs, shared.settled(numbers))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning(l") == 1 == plan.count("hashpartitioning(")
    # handed on after each text or so, and split in pieces: the same sums
    whole, docs_of = Counter(), Counter()
    for lang, source, text in rows:
        found = re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        whole.update((lang, source, t) for t in found)
        docs_of.update((lang, source, t) for t in set(found))
    batches = [pa.table({"lang": a, "source": b, "_text": [(t or "").encode() for t in c]}).to_batches()[0] for a, b, c in (zip(*rows[:7]), zip(*rows[7:]))]
    for held, distinct, piece, size in ((1 << 22, 1 << 19, 1 << 20, 1 << 16), (5, 1 << 19, 3, 2), (1 << 22, 3, 1, 1)):
        for name, value in zip(("HELD", "DISTINCT", "PIECE", "BATCH"), (held, distinct, piece, size)):
            monkeypatch.setattr(divergence, name, value)
        n, of = Counter(), Counter()
        for batch in divergence.counted(("lang", "source"))(iter(batches)):
            assert 0 < batch.num_rows <= size
            for r in batch.to_pylist():
                key = r["lang"], r["source"], r["term"].decode()
                n[key], of[key] = n[key] + r["n"], of[key] + r["docs"]
        assert n == whole and of == docs_of
    assert not list(divergence.counted(("lang", "source"))(iter([])))
