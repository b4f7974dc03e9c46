"""Listeners, dumped wakes, tool logs and reports that are written again."""

from pulsegrid import sources
from pulsegrid.operators import metrics
from pulsegrid.streaming import events, report
from pyspark.sql import functions as F


def test_pings_are_no_state_and_fill_no_queue():
    hub = events.Hub(2)
    first = hub.subscribe()
    hub.ping()
    hub.ping()
    assert first.get_nowait() == {"type": "ping"} and first.empty()
    hub.publish({"type": "wake"})
    hub.ping()
    late = hub.subscribe()
    assert [first.get_nowait(), late.get_nowait()] == [{"type": "wake"}] * 2 and first.empty()


def test_a_batch_that_is_dumped_again_replaces_itself(spark, tmp_path):
    write = events.dump_wakes(str(tmp_path / "wakes"))
    rows = spark.createDataFrame([("d", "wake_1", [1.0, 2.0])], "device_id string, name string, samples array<double>")
    for number in (0, 0, 1):
        write(rows, number)
    assert spark.read.parquet(str(tmp_path / "wakes")).groupBy("batch").count().orderBy("batch").collect() == [(0, 1), (1, 1)]


def test_missing_files_and_vectors(spark, tmp_path):
    assert sources.responses(spark, str(tmp_path / "none.jsonl"), "a long").count() == 0
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    sources.write_index(rows, str(tmp_path / "i"), spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<double>"))
    assert sources.read_index(spark, str(tmp_path / "i"))[1].count() == 1 and sources.read_index(spark, str(tmp_path / "i"), dense=False)[1] is None
    import shutil

    shutil.rmtree(tmp_path / "i" / "embeddings")
    assert sources.read_index(spark, str(tmp_path / "i"))[1] is None  # BM25 alone


def test_quantiles_of_few_and_of_no_scores(spark):
    q = lambda rows: tuple(metrics.quantiles(spark.createDataFrame(rows, "score double"), "score", {"a": 0.0, "b": 0.25, "c": 1.0}).first())
    assert q([(4.0,), (1.0,), (1.0,), (None,), (2.0,)]) == (1.0, 1.0, 4.0) and q([(3.0,)]) == (3.0, 3.0, 3.0) and q([]) == (None, None, None)


def test_a_report_with_any_scorer(spark):
    rows = [("d", float(t), [float(t % 10), 1.0], int(t % 10 == 9)) for t in range(100)]
    windows = spark.createDataFrame(rows, "device_id string, t double, samples array<double>, label int")
    one = report.report(report.scored(windows, lambda x: F.array_max(x)), 0.95, m=1, n=1, refractory=15.0).first()
    assert one.threshold == 8.0 and one.windows == 100 and one.auc == 1.0 and one.sensitivity == 1.0 and one.wakes == 5
