"""Cases with known answers: prompts, contexts, tools, sinks, listeners, signal quality."""

import math
import os
import time

import pytest

from pulsegrid import sources
from pulsegrid.functions import arrays
from pulsegrid.operators import reporting, signal
from pulsegrid.streaming import events
from pyspark.sql import functions as F


def test_tool_prompts_keep_the_order_and_skip_unknown_ones(spark):
    rows = [("b", "B.", "use b", "text", "json"), ("a", "A.", "use a", "path", "text")]
    tools = spark.createDataFrame(rows, "name string, description string, prompt string, input_type string, return_type string")
    lines = "Tool: {0}\nDescription: {1}\nUsage: {2}\nInput type: {3}\nReturn type: {4}\n\n"
    assert reporting.tool_prompts(tools, ["a", "x", "b"]).first().text == lines.format(*rows[1]) + "\n" + lines.format(*rows[0])


def test_context_is_by_rank(spark):
    hits = spark.createDataFrame([(1, 2, "later", "S", "2", "I", "A", "c2"), (1, 1, "first", "S", "1", None, "B", "c1")], "query_id int, rank int, text string, society string, version string, class string, LOE string, citation string")
    assert reporting.context(hits).first().context == "- first (S 1, class , level B, c1)\n- later (S 2, class I, level A, c2)"


def test_tools_by_name():
    tools = reporting.Tools()
    tools.register("add", "adds")(lambda a, b: a + b)
    assert tools.call("add", a=1, b=2) == 3 and tools.call("none") == reporting.INVALID_TOOL


def test_listeners_that_are_full_miss_what_is_new():
    hub = events.Hub(2)
    early = hub.subscribe()
    for i in range(3):
        hub.publish({"i": i})
    late = hub.subscribe()
    assert [early.get_nowait()["i"] for _ in range(2)] == [0, 1] and early.empty()
    assert late.get_nowait() == {"i": 2} and late.empty()


def test_hub_as_a_sink(spark):
    hub = events.Hub()
    listener = hub.subscribe()
    decisions = spark.createDataFrame([("a", 2.0, True), ("b", 1.0, True)], "device_id string, t double, wake boolean")
    hub.sink(events.gate_events(decisions, decisions.where("device_id = 'a'")), 0)
    assert [listener.get_nowait()["type"] for _ in range(6)] == ["status", "wake", "gate_error", "status", "wake", "ecg_ready"]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, name in enumerate(["b.csv", "a.csv"]):
        (tmp_path / "in" / name).write_text("x\n1\n")
        os.utime(tmp_path / "in" / name, (time.time() + 10 * i,) * 2)
    assert sources.newest(spark, str(tmp_path / "in")).endswith("a.csv")
    stream = sources.arriving(spark, str(tmp_path / "in"), "x int")
    run = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        run.processAllAvailable()
        assert spark.table("arrived").count() == 2
    finally:
        run.stop()
    rows = spark.createDataFrame([(1,), (2,)], "x int")
    for _ in range(2):
        sources.append_lines(rows, str(tmp_path / "lines"))
    assert sources.appended(spark, str(tmp_path / "lines"), "x int").count() == 4
    sources.write_report(rows, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == ["x"]


def test_precomputed_outputs_need_both_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('ecg_file_path,top_classes\nHR1.mat,"NORM (95.00%), SR (90.00%)"\n')
    (tmp_path / "m.csv").write_text("ecg_file_path,PR_Interval_ms,QTc_ms,QRS_Duration_ms,Heart_Rate,error\nHR1.mat,160.0,400.0,,70.5,\n")
    classes, measured = sources.tool_outputs(spark, str(tmp_path / "c.csv"), str(tmp_path / "m.csv"))
    assert classes.first().top_classes == "NORM (95.00%), SR (90.00%)" and tuple(measured.first()) == ("HR1.mat", 160.0, 400.0, None, 70.5, None)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        sources.tool_outputs(spark, str(tmp_path / "c.csv"), str(tmp_path / "none.csv"))


def test_quality_judges_measured_leads_by_every_criterion(spark):
    fs, n = 100, 400
    good = [math.sin(2 * math.pi * 8 * i / fs) for i in range(n)]
    noisy = [math.sin(2 * math.pi * 0.5 * i / fs) + 0.1 * g for i, g in enumerate(good)]
    flat_noisy = [0.0 if i < 60 else x for i, x in enumerate(noisy)]
    samples = dict.fromkeys(arrays.LEADS, good) | {"III": [0.0] * n, "II": [0.0] * n, "V2": flat_noisy}
    rows = [(1, k, v) for k, v in samples.items()] + [(2, k, good) for k in arrays.LEADS[:11]] + [(3, k, good) for k in arrays.LEADS]
    out = {r.recording_id: r for r in signal.quality(spark.createDataFrame(rows, "recording_id int, lead string, samples array<double>"), fs).collect()}
    assert out[1].failures == ["II:invalid_signal", "V2:snr", "V2:stationarity"] and out[1].electrodes == ["LL", "RA", "V2"]
    assert (out[1].acceptable, out[1].overall, out[1].hint) == (6, "partial", "baseline wander")
    assert (out[2].overall, out[2].failures) == ("failed", None)
    assert (out[3].acceptable, out[3].overall, out[3].hint) == (8, "all_acceptable", "")


def test_lead_subset_takes_names_and_places(spark):
    row = spark.range(1).select(F.array(*(F.array(F.lit(float(i))) for i in range(1, 13))).alias("x")).select(arrays.lead_subset(F.col("x"), [" aVR", 0]).alias("y")).first().y
    assert [v for (v,) in row] == [1.0, 0, 0, 4.0] + [0] * 8
