"""Cases with known answers: the gate, windows, texts, metrics, sources and sinks."""

import datetime as dt
import json
import math
import time

import numpy as np
import pytest

from pulsegrid import sources
from pulsegrid.functions import arrays, text
from pulsegrid.operators import dialogue, etl, evaluation, metrics, retrieval, signal
from pulsegrid.streaming import replies
from pulsegrid.streaming.state import replayed, rocksdb
from pulsegrid.streaming.gate import Gate, Memory, gated, start, steps, wakes
from pyspark.sql import functions as F

SCORES = "device_id string, t double, score double"


def at(gate, scores, step=1.0):
    whole = steps(gate, Memory(), np.arange(len(scores)) * step, np.array(scores, dtype=float))[1]
    memory, parts = Memory(), []
    for i, s in enumerate(scores):  # one at a time, with the memory kept between
        memory, out = steps(gate, memory, np.array([i * step]), np.array([float(s)]))
        parts.append(out)
    assert whole.values.tolist() == [r for p in parts for r in p.values.tolist()]
    return np.nonzero(whole["wake"])[0].tolist()


GATES = [
    (Gate(1, smooth=1, m=3, n=5, refractory=0), [0, 2, 2, 0, 2], 1.0, [4]),
    (Gate(1, smooth=1, m=3, n=5, refractory=0), [2, 0, 0, 2, 0, 0, 2, 0, 0], 1.0, []),
    (Gate(1, smooth=1, m=3, n=4, refractory=0), [2, 2, 0, 2], 1.0, [3]),
    (Gate(1, smooth=3, m=1, n=1, refractory=0), [0, 0, 5, 0, 0], 1.0, []),
    (Gate(1, smooth=1, m=1, n=1, refractory=0), [0, 0, 5, 0, 0], 1.0, [2]),
    (Gate(1, smooth=1, m=2, n=3, refractory=10), [2, 2, 2, 2, 2, 2, 0, 0, 0, 2, 2], 2.5, [1, 10]),
    (Gate.debounced(1, 2, smooth=1, refractory=0), [2, 0, 2, 2, 0, 2, 2, 2], 1.0, [3, 6]),
]


@pytest.mark.parametrize("gate, scores, step, want", GATES)
def test_gate_step_by_step(gate, scores, step, want):
    assert at(gate, scores, step) == want


def test_gate_in_batch_is_the_gate_in_steps(spark):
    for gate, scores, step, want in GATES:
        rows = spark.createDataFrame([("d", i * step, float(s)) for i, s in enumerate(scores)], SCORES)
        assert sorted(r.t for r in wakes(rows, gate).collect()) == [i * step for i in want]
        got = sorted(gated(rows, gate).collect(), key=lambda r: r.t)
        assert [tuple(r)[1:] for r in got] == [tuple(r) for r in steps(gate, Memory(), np.arange(len(scores)) * step, np.array(scores, dtype=float))[1].itertuples(index=False)]


def test_gate_refuses_impossible_counts():
    for m, n in ((0, 1), (3, 2)):
        with pytest.raises(ValueError):
            Gate(1, m=m, n=n)


def test_gate_on_a_stream_equals_batch(spark, tmp_path):
    gate, seen = Gate(1, smooth=3, m=2, n=3, refractory=4), []
    scores = [("a" if i % 2 else "b", float(i // 2), float((i * 7) % 5)) for i in range(40)]
    for part in range(2):
        spark.createDataFrame(scores[part * 20 : part * 20 + 20], SCORES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # file times order the micro-batches
    stream = rocksdb(spark).readStream.schema(SCORES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = start(stream, gate, lambda batch, n: seen.extend(batch.collect()), str(tmp_path / "check"))
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    whole = gated(spark.createDataFrame(scores, SCORES), gate).collect()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, whole)) and any(r.wake for r in whole)


def test_window_starts(spark):
    got = spark.range(1).select(*(arrays.window_starts(F.lit(n), 5000, 1250).alias(f"n{n}") for n in (6300, 3000, 20000))).first()
    assert got.n6300 == [0, 1250, 1300] and got.n3000 == [0] and got.n20000 == list(range(0, 15001, 1250))
    short = spark.range(1).select(arrays.windows(F.array(F.lit(1.0), F.lit(2.0)), 4).alias("w")).first().w
    assert [list(w.samples) for w in short] == [[1.0, 2.0, 0.0, 0.0]]


def test_chunks(spark):
    items = lambda n: F.sequence(F.lit(1), F.lit(n))
    got = spark.range(1).select(evaluation.chunks_with_tail(items(5), 2).alias("a"), evaluation.chunks_with_tail(items(8), 3).alias("b"), evaluation.chunks_with_tail(items(1), 4).alias("c"), evaluation.overlapping(items(5), 2, 1).alias("d")).first()
    assert got.a == [[1, 2], [3, 4, 5]] and got.b == [[1, 2, 3], [4, 5, 6], [7, 8]] and got.c == [[1]] and got.d == [[1, 2, 3], [3, 4, 5], [5]]


def test_tokens(spark):
    rows = spark.createDataFrame([("ST-T 抬高 ab",), ("",), (None,), ("心电 图",)], "s string").select(text.tokens(F.col("s")).alias("t")).collect()
    assert [r.t for r in rows] == [["st", "t", "ab", "抬", "高", "抬高"], [], [], ["心", "电", "心电", "图"]]


def test_findings(spark):
    rows = spark.createDataFrame([("['AFIB(0.90)', 'PRC(S)(0.10)']",), ("AFIB, 1AVB(0.5)",), ('["LVH"]',), ("[]",), (None,), ("",)], "s string")
    got = [[(f.code, f.prob) for f in r.f] for r in rows.select(text.findings(F.col("s")).alias("f")).collect()]
    assert got == [[("AFIB", 0.9), ("PRC(S)", 0.1)], [("AFIB", None), ("1AVB", 0.5)], [("LVH", None)], [], [], []]


def test_findings_threshold_keeps_unrated_and_likely_codes(spark):
    mapping = spark.createDataFrame([("A", "one", "t1"), ("B", "two", "t2"), ("C", "three", None)], "code string, en string, topic string")
    held = spark.createDataFrame([(1, "['A(0.90)', 'B(0.10)', 'C']"), (2, "['B']"), (3, "['C', 'X']")], "rec_id long, findings string")
    got = {r.rec_id: (r.query, sorted(r.topics)) for r in retrieval.findings_queries(held, mapping, 0.3).collect()}
    assert {k: v for k, v in got.items() if v[0]} == {1: ("one", ["t1"]), 2: ("two", ["t2"])}


def test_replies(spark):
    rows = spark.createDataFrame([("Action: response\nThought: so\nContent: two\nlines",), ("[Action: call\nTool_Output: {1}]",), ("nothing",)], "s string")
    got = rows.select(text.reply(F.col("s")).alias("r")).select("r.*").collect()
    assert got[0].action == "response" and got[0].thought == "so" and got[0].content == "two\nlines" and got[0].tool_output is None
    assert got[1].action == "call" and got[1].tool_output == "{1}" and got[2].action is None


REPLIES = [
    ("Action: response\nThought: x\nContent:  hello there", "hello there"),
    ("Action: call_measurement_tool\nThought: x\nContent: hidden", ""),
    ("no tags", ""),
    ("Thought: no call_measurement_tool needed\nContent: plain", "plain"),
    ("Thought: the Content: field\nContent: hi", "hi"),
    ("content: hi", "hi"),
    ("Content: first\nAction: call_measurement_tool\nContent: more", "first\nAction: call_measurement_tool\nContent: more"),
    ("  [action - call_morphology_tool]\nContent: x", ""),
    ("Action: call_measurement_toolbox\nContent: x", "x"),
    ("Action: response_fail\n[ CONTENT :\n\u00a0 \u3000two\nlines ", "two\nlines "),
    ("Action: other\nAction: call_measurement_tool\nContent: kept", "kept"),
    ("Content:", ""),
    ("", ""),
]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_replies_shown_by_pieces(size):
    for whole, want in REPLIES:
        phase, held, out = replies.WAITING, "", ""
        for i in range(0, len(whole), size):
            phase, held, now = replies.step(phase, held, whole[i : i + size])
            out += now
        assert out == want, whole


def test_replies_shown_in_batch(spark):
    rows = [(n, i // 3, whole[i : i + 3]) for n, (whole, _) in enumerate(REPLIES) for i in range(0, len(whole), 3)]
    made = replies.pieces_shown(spark.createDataFrame(rows, "reply_id long, nth int, piece string")).collect()
    whole = spark.createDataFrame([*enumerate(w for w, _ in REPLIES), (99, None)], "n long, text string").select("n", replies.shown(F.col("text")).alias("s")).collect()
    for n, (_, want) in enumerate(REPLIES):
        assert "".join(r.shown for r in sorted(made, key=lambda r: r.nth) if r.reply_id == n) == want
    assert {r.n: r.s for r in whole} == {**{n: want for n, (_, want) in enumerate(REPLIES)}, 99: ""}


def run_stream(spark, tmp_path, batches, schema, build):
    """Rows and the number of states after each micro-batch of a stream over files of the batches."""
    (tmp_path / "in").mkdir()
    rocksdb(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, states = [], []
    run = build(stream).writeStream.outputMode("append").foreachBatch(lambda rows, _: seen.extend(rows.collect())).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run.processAllAvailable()
            states.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        run.stop()
    return seen, states


def test_gate_forgets_devices_that_went_silent(spark, tmp_path):
    at_ = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    gate = Gate(1, m=1, n=1, refractory=1e9)
    batches = [[("a", 0.0, 5.0, at_(0)), ("b", 0.0, 0.0, at_(0))], [("b", 7200.0, 0.0, at_(7200))], [("b", 7300.0, 0.0, at_(7300))], [("a", 7400.0, 5.0, at_(7400))]]
    seen, states = run_stream(spark, tmp_path, batches, SCORES + ", ts timestamp", lambda s: gated(s, gate, "10 seconds", idle=60.0))
    # a's state has gone, so a wakes again in spite of the refractory time; b's has gone and come anew as well
    assert states[0] == 2 and states[-2] == 1 and [(r.device_id, r.t) for r in seen if r.wake] == [("a", 0.0), ("a", 7400.0)]


def test_gate_that_starts_again_from_its_state(spark):
    gate = Gate(1, smooth=3, m=2, n=3, refractory=4)
    scores = [(f"d{i % 3}", float(i // 3), float((i * 7) % 5)) for i in range(90)]
    rows = spark.createDataFrame(scores, SCORES)
    for parts in (1, 4):
        got = replayed(rows, "t", parts, lambda s: gated(s, gate))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, gated(rows, gate).collect())) and got.where("wake").count()


def test_state_goes_by_one_clock(spark):
    with pytest.raises(ValueError):
        gated(rocksdb(spark).readStream.format("rate").load().selectExpr("'a' AS device_id", "1D AS t", "1D AS score", "timestamp AS ts"), Gate(1), "1 second", ttl=5.0)


def test_replies_shown_on_a_stream(spark, tmp_path):
    batches = [[(1, 0, "Action: resp"), (2, 0, "Action: call_morph"), (1, 1, "onse\nCont")], [(1, 2, "ent: a"), (2, 1, "ology_tool\nContent: x")], [(1, 3, "b"), (2, 2, "y")]]
    seen, _ = run_stream(spark, tmp_path, batches, "reply_id long, nth int, piece string", replies.pieces_shown)
    assert [tuple(r) for r in seen] == [(1, 2, "a"), (1, 3, "b")]


def records(spark):
    row = lambda id_, words, status="current", by=None, topic="t": (id_, words, "en", "Soc", f"cite {id_}", topic, status, by or [])
    rows = [row(1, "atrial fibrillation rate control"), row(2, "atrial fibrillation old advice", "superseded", [1]), row(3, "pacing for block"), row(4, "block block block", topic="u")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, society string, citation string, topic string, status string, superseded_by array<long>")


def test_search(spark):
    asked = spark.createDataFrame([(1, "atrial fibrillation"), (2, "zzz"), (3, "block")], "query_id long, text string")
    everything = {(r.query_id, r.doc_id) for r in retrieval.search(records(spark), asked, 5).collect()}
    assert everything == {(1, 1), (1, 2), (3, 3), (3, 4)}  # no overlap, no rows
    current = {(r.query_id, r.doc_id) for r in retrieval.search(records(spark), asked, 5, retrieval.passes()).collect()}
    assert current == {(1, 1), (3, 3), (3, 4)}
    assert {r.doc_id for r in retrieval.search(records(spark), asked, 5, retrieval.passes(society="sOC", topics=["u"])).collect()} == {4}
    assert max(r["n"] for r in retrieval.search(records(spark), asked, 1).groupBy("query_id").agg(F.count("*").alias("n")).collect()) == 1


def test_search_does_not_depend_on_the_order_of_rows(spark):
    asked = spark.createDataFrame([(1, "atrial fibrillation block")], "query_id long, text string")
    one, two = (sorted(map(tuple, retrieval.search(r, asked, 5).collect()), key=repr) for r in (records(spark), records(spark).orderBy(F.desc("doc_id"))))
    assert one == two


def test_rank_metrics(spark):
    hits = spark.createDataFrame([("q", 1, 1), ("r", 7, 1), ("r", 8, 2), ("r", 9, 3)], "query_id string, doc_id long, rank int")
    gold = spark.createDataFrame([("q", 1), ("r", 9)], "query_id string, doc_id long")
    got = {r.query_id: r.asDict() for r in retrieval.metrics(hits, gold, gold.select("query_id").distinct()).collect()}
    assert math.isclose(sum(r["rr"] for r in got.values()) / 2, (1 + 1 / 3) / 2, abs_tol=1e-5) and math.isclose(got["r"]["ndcg"], 1 / math.log2(4), abs_tol=1e-5)


def test_auc_of_a_perfect_and_of_a_constant_score(spark):
    auc = lambda rows: metrics.roc(spark.createDataFrame(rows, "score double, label int"), 0.5).first()
    good, flat = auc([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)]), auc([(0.5, 0), (0.5, 1)])
    assert (good.auc, good.sensitivity, good.specificity) == (1.0, 1.0, 1.0) and flat.auc == 0.5


def test_few_beats_are_partial(spark):
    beats = spark.createDataFrame([(1, i, 500, i * 400.0, i * 400.0 - 80, i * 400.0 - 20, i * 400.0 - 20, i * 400.0 + 25, i * 400.0 + 150) for i in range(4)], "recording_id long, beat_idx int, fs int, r_peak double, p_onset double, r_onset double, q_peak double, s_peak double, t_offset double")
    got = signal.intervals(beats).first()
    assert got.status == "partial" and got.rr_ms == 800.0 and got.heart_rate == 75.0 and got.pr_ms == 122.0 and got.qrs_ms == 92.0


def test_split_keeps_patients_together(spark):
    rows = spark.range(200).withColumn("patient", F.col("id") % 40)
    got = etl.grouped_split(rows, "patient", 0.1, 0.2)
    sizes = {r.split: r.n for r in got.groupBy("split").agg(F.countDistinct("patient").alias("n")).collect()}
    assert sizes == {"test": 4, "valid": 8, "train": 28} and got.groupBy("patient").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_resume_does_failures_over(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    done = spark.createDataFrame([(1, None), (2, "did not provide")], "k long, error string")
    assert {r.k for r in dialogue.pending(keys, done, ["k"], F.coalesce(F.col("error") == "did not provide", F.lit(False))).collect()} == {2, 3}


def test_corpus_file(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('// note\n\n{"id": "a", "recommendation_class": "I", "extra": 1}\n{"id": "b", "class": "II", "status": "superseded", "superseded_by": ["a"]}\n')
    rows = {r.id: r for r in sources.corpus(spark, str(path)).collect()}
    assert rows["a"]["class"] == "I" and rows["a"].status == "current" and rows["a"].lang == "zh" and rows["a"].supersedes == [] and not rows["a"].verified
    assert rows["b"]["class"] == "II" and rows["b"].superseded_by == ["a"]
    for bad in ("{", '{"text": "no id"}'):
        path.write_text(bad + "\n")
        with pytest.raises(Exception):
            sources.corpus(spark, str(path)).collect()


def test_manifest_version(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"corpus_version": "v7"}))
    assert sources.corpus_version(spark, str(tmp_path / "m.json")) == "v7" and sources.corpus_version(spark, str(tmp_path / "none.json")) == "unknown"


@pytest.mark.parametrize("names", [sources.CHANNELS, tuple(f"{c}_mV" for c in sources.CHANNELS), tuple("abcdefgh")])
def test_wearable_columns(spark, tmp_path, names):
    (tmp_path / "w.csv").write_text("time," + ",".join(names) + "\nx," + ",".join(map(str, range(8))) + "\n")
    assert tuple(sources.wearable(spark, str(tmp_path / "w.csv")).first()) == tuple(map(float, range(8)))


def test_prompt_sections(spark, tmp_path):
    (tmp_path / "p.txt").write_text("lost\n[ONE]\n a \n\nb\n[TWO]\nc\n")
    assert {r.section: r.text for r in sources.prompts(spark, str(tmp_path / "p.txt")).collect()} == {"ONE": "a\nb", "TWO": "c"}


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    sources.write_index(rows, str(tmp_path / "i"))
    back, vectors = sources.read_index(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")] and vectors is None
    assert sources.checksum(rows).first() == sources.checksum(rows.orderBy(F.desc("doc_id"))).first()
