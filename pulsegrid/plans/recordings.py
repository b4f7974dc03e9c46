"""Queries of recordings: morphology, spectra, quality, preparation, and the gate's report, in the catalog's registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, spectral, text
from ..operators import etl, evaluation, signal
from ..sources import table
from ..streaming import replies, report
from .catalog import GATE, GATED, X, device_scores, query, r6, signals, whole_numbers

LEADS = "['" + "','".join(arrays.LEADS) + "']"


def leads(spark, d):
    """embeddings as leads of recordings, twelve to one."""
    lead = F.element_at(F.array(*map(F.lit, arrays.LEADS)), (F.col("vec_id") % 12 + 1).cast("int"))
    return signals(spark, d).select(F.floor(F.col("vec_id") / 12).alias("recording_id"), lead.alias("lead"), F.col("x").alias("samples"))


def beats_of(spark, d):
    """Beats of each recording's leads II and I: five, or in every fourth recording three on lead II, or two on either in every seventh."""
    ids = signals(spark, d).select(F.floor(F.col("vec_id") / 12).alias("recording_id")).distinct()
    rows = ids.withColumn("lead", F.explode(F.array(F.lit("II"), F.lit("I")))).withColumn("beat_idx", F.explode(F.sequence(F.lit(0), F.lit(4))))
    n = F.when(F.col("recording_id") % 7 == 0, 2).when((F.col("recording_id") % 4 == 0) & (F.col("lead") == "II"), 3).otherwise(5)
    on = (3 + 11 * F.col("beat_idx") + F.col("recording_id") % 3 - F.when(F.col("lead") == "I", 3).otherwise(0)).cast("double")
    on = F.when((F.col("recording_id") % 5 == 0) & (F.col("beat_idx") == 1), float("nan")).when(F.col("recording_id") == 11, 63.0).otherwise(on)
    peak = F.when((F.col("recording_id") + F.col("beat_idx")) % 2 == 0, on + 16)
    return rows.where(F.col("beat_idx") < n).select("recording_id", "lead", "beat_idx", on.alias("r_peak"), on.alias("r_onset"), (on + 4).alias("r_offset"), peak.alias("t_peak"))


@query(f"""{X}, l AS (SELECT vec_id // 12 AS rec, {LEADS}[vec_id % 12 + 1] AS lead, x FROM e), c AS (SELECT rec, lead, x, CASE WHEN rec % 7 = 0 THEN NULL WHEN rec % 4 = 0 THEN 'I' ELSE 'II' END AS timing FROM l),
b AS (SELECT *, unnest(range(0, 5)) AS i FROM c WHERE timing IS NOT NULL),
o AS (SELECT *, 3 + 11 * i + rec % 3 - CASE WHEN timing = 'I' THEN 3 ELSE 0 END AS o FROM b WHERE NOT (rec % 5 = 0 AND i = 1) AND rec <> 11),
s AS (SELECT *, CASE WHEN o > 0 THEN list_aggregate(x[greatest(o - 4, 0) + 1 : o], 'median') ELSE x[1] END AS base FROM o),
q AS (SELECT *, list_transform(x[o + 13 : least(64, o + 44)], lambda v: v - base) AS late FROM s),
m AS (SELECT rec, lead, list_max(x[o + 1 : o + 5]) - base AS r, list_min(x[o + 1 : o + 5]) - base AS s, CASE WHEN o + 11 < 64 THEN list_aggregate(x[o + 10 : o + 12], 'median') - base END AS st,
 CASE WHEN (rec + i) % 2 = 0 THEN CASE WHEN o + 16 < 64 THEN list_aggregate(x[o + 16 : o + 18], 'median') - base END ELSE late[list_position(list_transform(late, lambda v: abs(v)), list_max(list_transform(late, lambda v: abs(v))))] END AS t FROM q),
a AS (SELECT rec, lead, count(*) AS n, round(median(r), 3) AS r, round(median(s), 3) AS s, round(median(st), 3) AS st, round(median(t), 3) AS t, round(median(r + s), 3) AS net FROM m GROUP BY 1, 2),
ax AS (SELECT rec, max(net) FILTER (lead = 'I') AS one, max(net) FILTER (lead = 'aVF') AS avf FROM a GROUP BY 1)
SELECT c.rec AS recording_id, c.lead, CASE WHEN timing IS NULL THEN 'failed' WHEN n IS NULL THEN 'partially_completed' ELSE 'completed' END AS status, timing, coalesce(n, 0)::INT AS beats, r, s, st, t,
CASE WHEN t IS NULL THEN 'undetermined' WHEN t > 0.1 THEN 'positive' WHEN t < -0.1 THEN 'negative' ELSE 'flat' END AS t_polarity, CASE WHEN abs(s) > 1e-6 THEN round((r / abs(s))::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE END AS rs_ratio,
CASE WHEN abs(one) >= 1e-6 OR abs(avf) >= 1e-6 THEN round(degrees(atan2(avf, one))) END AS axis FROM c LEFT JOIN a ON a.rec = c.rec AND a.lead = c.lead LEFT JOIN ax ON ax.rec = c.rec""")
def beat_morphology(spark, d):
    return signal.morphology(leads(spark, d), beats_of(spark, d), 100)


#: The one-sided periodogram of 64 samples by its definition.
DFT = """d AS (SELECT vec_id, list_transform(x, lambda v: v - list_avg(x)) AS y FROM e), k AS (SELECT vec_id, y, unnest(range(0, 33)) AS k FROM d),
p AS (SELECT vec_id, k, (pow(list_sum(list_transform(y, lambda v, i: v * cos(2 * pi() * k * (i - 1) / 64))), 2) + pow(list_sum(list_transform(y, lambda v, i: v * sin(2 * pi() * k * (i - 1) / 64))), 2)) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p, k * 100 / 64.0 AS f FROM k)"""


@query(f"""{X}, {DFT} SELECT vec_id, round(sum(p) FILTER (f >= 2 AND f < 40) / sum(p) FILTER (f < 2 OR f >= 40), 6) AS snr, round(sum(p) FILTER (f < 2) / sum(p), 6) AS drift, round(sum(p) FILTER (f >= 40) / sum(p), 6) AS buzz FROM p GROUP BY 1""")
def spectral_quality(spark, d):
    rows = signals(spark, d).select("vec_id", spectral.quality_udf(100.0)(F.col("x")).alias("q"))
    return rows.select("vec_id", *(r6(f"q.{c}").alias(c) for c in ("snr", "drift", "buzz")))


listed = lambda x: "[" + ", ".join(repr(float(v)) for v in x) + "]"


def filter_sql(edges):
    """A filter's two recursions over rows (vec_id, i, x) of all signals, each from its steady state for the first sample."""
    num, den = spectral.butterworth(100.0, edges)
    order, more = len(den) - 1, 3 * len(den)
    recursion = f"""{{name}}(vec_id, i, y, z) AS (SELECT vec_id, 0, 0.0::DOUBLE, list_transform({listed(spectral.steady(num, den))}, lambda v: v * x) FROM {{rows}} WHERE i = 1
UNION ALL SELECT r.vec_id, r.i, {float(num[0])!r} * r.x + f.z[1], list_transform(range(1, {order + 1}), lambda k: (CASE WHEN k < {order} THEN f.z[k + 1] ELSE 0 END) + ({listed(num)})[k + 1] * r.x - ({listed(den)})[k + 1] * ({float(num[0])!r} * r.x + f.z[1])) FROM {{name}} f JOIN {{rows}} r ON r.vec_id = f.vec_id AND r.i = f.i + 1)"""
    return f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
w AS (SELECT vec_id, list_concat(list_transform(range(0, {more}), lambda j: 2 * x[1] - x[{more} + 1 - j]), x, list_transform(range(0, {more}), lambda j: 2 * x[64] - x[63 - j])) AS x FROM e),
a AS MATERIALIZED (SELECT vec_id, (generate_subscripts(x, 1))::INT AS i, unnest(x) AS x FROM w), {recursion.format(name="f", rows="a")},
b AS MATERIALIZED (SELECT vec_id, {64 + 2 * more + 1} - i AS i, y AS x FROM f WHERE i > 0), {recursion.format(name="g", rows="b")}
SELECT vec_id, ({64 + more} - i)::INT AS place, round(y, 6) AS y FROM g WHERE i BETWEEN {more + 1} AND {more + 64}"""


@query(filter_sql(spectral.NOISE))
def low_passed(spark, d):
    return filtered(spark, d, spectral.NOISE)


@query(filter_sql(spectral.BASELINE))
def baseline_passed(spark, d):
    return filtered(spark, d, spectral.BASELINE)


def filtered(spark, d, edges):
    rows = signals(spark, d).select("vec_id", F.posexplode(spectral.low_pass_udf(100.0, edges)(F.col("x"))).alias("place", "y"))
    return rows.select("vec_id", "place", r6("y").alias("y"))


TAPS = "[" + ", ".join(repr(float(t)) for t in spectral.low_pass_taps(5, 2)) + "]"


@query(f"""{X}, t AS (SELECT {TAPS} AS h), j AS (SELECT vec_id, x, h, unnest(range(0, 160)) AS j FROM e, t)
SELECT vec_id, j::INT AS place, round(list_sum(list_transform(x, lambda v, i: CASE WHEN abs(2 * j - 5 * (i - 1)) <= 50 THEN v * h[51 + 2 * j - 5 * (i - 1)] ELSE 0 END)), 6) AS y FROM j""")
def resampled(spark, d):
    rows = signals(spark, d).select("vec_id", F.posexplode(spectral.resample_udf(500, 200)(F.col("x"))).alias("place", "y"))
    return rows.select("vec_id", "place", r6("y").alias("y"))


@query(f"""{X}, z AS (SELECT vec_id, list_concat(list_transform(range(0, 8), lambda i: 0.0), x, list_transform(range(0, 8), lambda i: 0.0)) AS x FROM e),
w AS (SELECT vec_id, frame, list_transform(x[frame * 8 + 1 : frame * 8 + 16], lambda v, i: v * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 16))) AS y FROM (SELECT vec_id, x, unnest(range(0, 9)) AS frame FROM z)), k AS (SELECT *, unnest(range(0, 9)) AS bin FROM w)
SELECT vec_id, frame::INT AS frame, bin::INT AS bin, round(sqrt(pow(list_sum(list_transform(y, lambda v, i: v * cos(2 * pi() * bin * (i - 1) / 16))), 2) + pow(list_sum(list_transform(y, lambda v, i: v * sin(2 * pi() * bin * (i - 1) / 16))), 2)) / 8, 6) AS size FROM k""")
def spectrogram(spark, d):
    rows = signals(spark, d).select("vec_id", F.posexplode(spectral.spectrogram_udf(16)(F.col("x"))).alias("frame", "bins"))
    return rows.select("vec_id", "frame", F.posexplode("bins").alias("bin", "size")).withColumn("size", r6("size"))


@query(f"""WITH s AS (SELECT vec_id, vec_id // 12 AS rec, {LEADS}[vec_id % 12 + 1] AS lead, CASE WHEN vec_id % 23 = 1 THEN list_transform(range(0, 64), lambda i: 1.0) WHEN vec_id % 19 = 2 THEN list_concat((embedding::DOUBLE[])[1:30], list_transform(range(0, 34), lambda i: 0.25)) ELSE embedding::DOUBLE[] END AS x FROM embeddings),
e AS (SELECT vec_id, x FROM s), {DFT}, n AS (SELECT vec_id, sum(p) AS total, sum(p) FILTER (f >= 2 AND f < 40) AS band, sum(p) FILTER (f < 2) AS low, sum(p) FILTER (f >= 40) AS high FROM p GROUP BY 1),
l AS (SELECT rec, lead, list_min(x) = list_max(x) AS dead, list_bool_or(list_transform(range(0, 5), lambda i: list_min(x[i * 10 + 1 : i * 10 + 20]) = list_max(x[i * 10 + 1 : i * 10 + 20]))) AS flat, NOT (vec_id % 29) * 60.0 / 0.64 BETWEEN 24 AND 300 AS rate, total > 0 AND total > band AND band / (total - band) < 0.5 AS noisy, low / total AS low, high / total AS high FROM s JOIN n USING (vec_id)),
c AS (SELECT rec, count(*) AS leads FROM l GROUP BY 1), m AS (SELECT *, CASE WHEN dead THEN [lead || ':invalid_signal'] ELSE list_filter([CASE WHEN flat THEN lead || ':stationarity' END, CASE WHEN rate THEN lead || ':heart_rate' END, CASE WHEN noisy THEN lead || ':snr' END], lambda z: z IS NOT NULL) END AS failed, CASE lead WHEN 'I' THEN ['RA', 'LA'] WHEN 'II' THEN ['RA', 'LL'] ELSE [lead] END AS points FROM l WHERE lead NOT IN ('III', 'aVR', 'aVL', 'aVF')),
g AS (SELECT rec, count(*) FILTER (len(failed) = 0) AS good, count(*) FILTER (len(failed) > 0) AS bad, array_to_string(list_sort(flatten(list(failed))), ',') AS failures, coalesce(array_to_string(list_sort(list_distinct(flatten(list(points) FILTER (len(failed) > 0)))), ','), '') AS electrodes, avg(low) FILTER (noisy AND NOT dead) AS low, avg(high) FILTER (noisy AND NOT dead) AS high FROM m GROUP BY 1)
SELECT rec AS recording_id, leads, CASE WHEN leads >= 12 THEN good END AS acceptable, CASE WHEN leads < 12 THEN 'failed' WHEN bad = 0 THEN 'all_acceptable' WHEN good > 0 THEN 'partial' ELSE 'all_unacceptable' END AS overall, CASE WHEN leads >= 12 THEN failures END AS failures, CASE WHEN leads >= 12 THEN electrodes END AS electrodes,
CASE WHEN leads >= 12 THEN CASE WHEN low IS NULL THEN '' WHEN low >= 0.5 THEN 'baseline wander' WHEN high >= 0.3 THEN 'high frequency' ELSE 'broadband' END END AS hint FROM c JOIN g USING (rec)""")
def signal_quality(spark, d):
    x = F.when(F.col("vec_id") % 23 == 1, F.array_repeat(F.lit(1.0), 64)).when(F.col("vec_id") % 19 == 2, F.concat(F.slice("x", 1, 30), F.array_repeat(F.lit(0.25), 34))).otherwise(F.col("x"))
    lead = F.element_at(F.array(*map(F.lit, arrays.LEADS)), (F.col("vec_id") % 12 + 1).cast("int"))
    rows = signals(spark, d).select("vec_id", F.floor(F.col("vec_id") / 12).alias("recording_id"), lead.alias("lead"), x.alias("samples"))
    found = signal.quality(rows.drop("vec_id"), 100, rows.select("recording_id", "lead", (F.col("vec_id") % 29).alias("n")))
    return found.withColumns({c: F.array_join(c, ",") for c in ("failures", "electrodes")})


@query(f"""{X} SELECT vec_id AS recording_id, vec_id % 40 AS patient_id, array_to_string(list_transform(list_concat(x[6:10], x[1:5]), lambda v: round(v * 1000000)::BIGINT::VARCHAR), ',') AS samples FROM e WHERE vec_id % 3 <> 0 AND vec_id % 2 = 0 AND vec_id % 11 <> 0""")
def preprocessed(spark, d):
    cut = F.array(*(F.slice("x", 1 + 5 * i, 5) for i in range(12)))
    broken = F.transform(cut, lambda x, i: F.when((F.col("vec_id") % 11 == 0) & (i == 7), F.concat(F.slice(x, 1, 4), F.array(F.lit(float("nan"))))).otherwise(x))
    rows = signals(spark, d).select(F.col("vec_id").alias("recording_id"), F.when(F.col("vec_id") % 2 == 0, 500).otherwise(250).alias("fs"), broken.alias("leads"))
    patients = signals(spark, d).where("vec_id % 3 <> 0").select(F.col("vec_id").alias("recording_id"), (F.col("vec_id") % 40).alias("patient_id"))
    return etl.preprocessed(rows, patients, [1, 0], 500).select("recording_id", "patient_id", whole_numbers(F.flatten("leads")).alias("samples"))


@query("SELECT user_id AS recording_id, max((event_type = 'view')::INT)::DOUBLE AS view, max((event_type = 'error')::INT)::DOUBLE AS error FROM events GROUP BY 1")
def labelled_recordings(spark, d):
    e = table(spark, d, "events")
    codes = e.groupBy(F.col("user_id").alias("recording_id")).agg(F.concat(F.lit("{"), F.array_join(F.collect_set(F.concat(F.lit("'"), "event_type", F.lit("': 100.0"))), ", "), F.lit("}")).alias("scp_codes"))
    made = etl.labelled(e.select(F.col("user_id").alias("recording_id")).distinct(), codes, ["view", "error"])
    return made.select("recording_id", F.col("label")[0].cast("double").alias("view"), F.col("label")[1].cast("double").alias("error"))


@query("SELECT 0 AS place, '/data' AS line UNION ALL SELECT row_number() OVER (ORDER BY p), p || chr(9) || n FROM (SELECT lpad((c_custkey % 97)::VARCHAR, 3, '0') || '/HR' || c_custkey || '.mat' AS p, c_nationkey AS n FROM customer)")
def manifest_lines(spark, d):
    path = F.concat(F.lit("/data/"), F.lpad((F.col("c_custkey") % 97).cast("string"), 3, "0"), F.lit("/HR"), F.col("c_custkey").cast("string"), F.lit(".mat"))
    return etl.manifest(table(spark, d, "customer").select(path.alias("path"), F.col("c_nationkey").alias("n")), "/data")


@query(f"""{X} SELECT vec_id, array_to_string(list_transform(list_concat(list_transform(range(0, 7), lambda i: 0.0), list_transform(x[6:10], lambda v, i: CASE WHEN vec_id % 5 = i - 1 THEN 0.0 ELSE v END), list_transform(range(0, 72), lambda i: 0.0)), lambda v: round(v * 1000000)::BIGINT::VARCHAR), ',') AS samples FROM e""")
def masked_signal(spark, d):
    cut = F.array(*(F.slice("x", 1 + 5 * i, 5) for i in range(12)))
    broken = F.transform(cut, lambda x: F.transform(x, lambda v, i: F.when(F.col("vec_id") % 5 == i, float("inf")).otherwise(v)))
    rows = signals(spark, d).select("vec_id", broken.alias("leads"))
    return rows.select("vec_id", whole_numbers(F.flatten(arrays.loaded(F.col("leads"), 7, [" II"]))).alias("samples"))


@query(f"""WITH RECURSIVE {GATED}, f(device_id, t, armed, last, wake) AS (
SELECT device_id, t, NOT (c >= 2), CASE WHEN c >= 2 THEN t ELSE -1e18 END, c >= 2 FROM g WHERE t = 1
UNION ALL SELECT g.device_id, g.t, (f.armed OR (g.t - f.last >= 3 AND g.c < 2)) AND NOT ((f.armed OR (g.t - f.last >= 3 AND g.c < 2)) AND g.c >= 2), CASE WHEN f.armed AND g.c >= 2 THEN g.t ELSE f.last END, f.armed AND g.c >= 2 FROM f JOIN g ON g.device_id = f.device_id AND g.t = f.t + 1)
SELECT device_id, t, round(score, 6) AS score, round(smoothed, 6) AS smoothed, abnormal = 1 AS abnormal, c::INT AS count, CASE WHEN armed THEN 'armed' ELSE 'refractory' END AS state, wake FROM f JOIN g USING (device_id, t)""")
def gate_stateful(spark, d):
    """The decisions of a stream over the scores in three micro-batches, started anew from its checkpoint for each."""
    from ..streaming import gate, state

    made = state.replayed(device_scores(spark, d), "t", 3, lambda stream: gate.gated(stream, GATE))
    return made.withColumns({"score": r6("score"), "smoothed": r6("smoothed")})


@query(f"WITH {GATED.replace('>= 60)', '>= 40)').replace('3 PRECEDING', '1 PRECEDING')} SELECT device_id, min(t) AS t FROM g WHERE c = 2 GROUP BY 1")
def gate_debounced(spark, d):
    """The first wake of each device by the older setting: two abnormal marks in a row."""
    from ..streaming import gate

    return gate.wakes(device_scores(spark, d), gate.Gate.debounced(40.0, 2, smooth=3, refractory=3.0)).groupBy("device_id").agg(F.min("t").alias("t"))


@query("""WITH RECURSIVE s AS (SELECT user_id AS device_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS t, value / 2 + 10 AS score, (event_type = 'error')::INT AS y FROM events),
th AS (SELECT round(quantile_cont(score, 0.95), 6) AS th FROM s WHERE y = 0), a AS (SELECT s.*, th, sum((score >= th)::INT) OVER (PARTITION BY device_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM s, th),
f(device_id, t, armed, last, wake) AS (SELECT device_id, t, NOT (c >= 2), CASE WHEN c >= 2 THEN t ELSE -1e18 END, c >= 2 FROM a WHERE t = 1
UNION ALL SELECT a.device_id, a.t, (f.armed OR (a.t - f.last >= 5 AND a.c < 2)) AND NOT (f.armed AND a.c >= 2), CASE WHEN f.armed AND a.c >= 2 THEN a.t ELSE f.last END, f.armed AND a.c >= 2 FROM f JOIN a ON a.device_id = f.device_id AND a.t = f.t + 1),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM a), z AS (SELECT any_value(th) AS th, count(*) AS n, sum(r * y) AS rs, sum(y) AS p, sum((y = 1 AND score >= th)::INT) AS tp, sum((y = 0 AND score < th)::INT) AS tn FROM r)
SELECT th AS threshold, n AS windows, (SELECT count(*) FROM f WHERE wake) AS wakes, round((rs - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc, round(tp / p, 6) AS sensitivity, round(tn / (n - p), 6) AS specificity FROM z""")
def calibrated_gate(spark, d):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("device_id"), nth.cast("double").alias("t"), F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"))
    windows = e.select("device_id", "t", F.array(F.col("score"), F.lit(20.0)).alias("samples"), "label")
    half = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / 2
    return report.report(report.scored(windows, half), 0.95, m=2, n=5, refractory=5.0)


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS reply_id, turn % 5 AS k, text FROM conversations)
SELECT reply_id, md5(regexp_replace(text, '^\\s+', '')) AS shown FROM t WHERE k NOT IN (1, 3) AND regexp_replace(text, '^\\s+', '') <> ''""")
def replies_shown(spark, d):
    k = F.col("turn") % 5
    head = F.when(k == 0, "Action: response\nThought: the Content: field\nContent: ").when(k == 1, "[action - call_morphology_tool]\nContent: ").when(k == 2, "content:").when(k == 3, "Thought: none\n").otherwise("Thought: no call_measurement_tool\n [ CONTENT :\n ")
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), F.concat(head, F.when(k == 3, F.replace("text", F.lit(":"), F.lit(" "))).otherwise(F.col("text"))).alias("text"))
    pieces = rows.select("reply_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))).alias("nth", "piece"))
    made = replies.pieces_shown(pieces).groupBy("reply_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "shown"))), lambda x: x.shown), "").alias("shown"))
    return made.select("reply_id", F.md5(F.col("shown").cast("binary")).alias("shown"))


@query("""SELECT conv_id * 1000 + turn AS reply_id, CASE WHEN turn % 3 = 1 THEN '' ELSE md5(regexp_replace(text, '^\\s+', '')) END AS shown FROM conversations WHERE turn % 3 = 1 OR regexp_replace(text, '^\\s+', '') <> ''""")
def whole_replies_shown(spark, d):
    head = F.when(F.col("turn") % 3 == 1, "Action: call_classification_tool\nContent: ").otherwise("Action: response\nThought: no\n content : ")
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), replies.shown(F.concat(head, "text")).alias("s"), "turn")
    return rows.where("turn % 3 = 1 or s <> ''").select("reply_id", F.when(F.col("s") == "", "").otherwise(F.md5(F.col("s").cast("binary"))).alias("shown"))


ITEMS = "lambda z: array_to_string(z, ',')), ';')"


def items_of(chunks):
    """Chunks as text: items by comma, chunks by semicolon."""
    return F.array_join(F.transform(chunks, lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")), ";")


@query(f"WITH p AS (SELECT p_partkey, greatest(1, ceil(p_size / 4.0))::INT AS step, p_size FROM part) SELECT p_partkey, array_to_string(list_transform(list_transform(range(0, ceil(p_size / step::DOUBLE)::INT), lambda i: range(i * step + 1, least((i + 1) * step, p_size) + 1)), {ITEMS} AS chunks FROM p")
def near_equal_chunks(spark, d):
    return table(spark, d, "part").select("p_partkey", items_of(arrays.chunks(F.sequence(F.lit(1), F.col("p_size")), 4)).alias("chunks"))


@query(f"WITH p AS (SELECT p_partkey, p_size AS n, greatest(1, CASE WHEN (p_size % 6) * 2 <= 6 THEN p_size // 6 ELSE ceil(p_size / 6.0)::INT END) AS k FROM part) SELECT p_partkey, array_to_string(list_transform(list_transform(range(0, k), lambda i: range(i * 6 + 1, CASE WHEN i = k - 1 THEN n ELSE i * 6 + 6 END + 1)), {ITEMS} AS tail, array_to_string(list_transform(list_transform(range(0, ceil(n / 7.0)::INT), lambda i: range(i * 7 + 1, least(i * 7 + 10, n) + 1)), {ITEMS} AS over FROM p")
def chunks_of_items(spark, d):
    items = F.sequence(F.lit(1), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", items_of(evaluation.chunks_with_tail(items, 6)).alias("tail"), items_of(evaluation.overlapping(items, 7, 3)).alias("over"))


@query("SELECT user_id, '[' || coalesce(string_agg(chr(39) || event_type || '(' || printf('%.2f', p) || ')' || chr(39), ', ' ORDER BY p DESC, event_type) FILTER (p > 0.6 AND n <= 3), '') || ']' AS shown FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS n FROM (SELECT user_id, event_type, floor(max(value)) / 100 AS p FROM events GROUP BY 1, 2)) GROUP BY 1")
def bedside_classes(spark, d):
    best = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.floor(F.max("value")) / 100).alias("prob"))
    held = best.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("label"), "prob")).alias("c"))
    return held.select("user_id", text.bedside_classes(F.col("c"), 0.6, 3).alias("shown"))


@query("SELECT user_id, list_aggregate(list_transform(list_filter(list_sort(list({'e': event_type, 'p': p})), lambda z: z.p > 0.8), lambda z: printf('%s (%.2f%%)', z.e, z.p * 100)), 'string_agg', ', ') AS shown FROM (SELECT user_id, event_type, max(value) / 100 AS p FROM events GROUP BY 1, 2) GROUP BY 1 HAVING max(p) > 0.8 UNION ALL SELECT user_id, 'None > 80%' FROM events GROUP BY 1 HAVING max(value) / 100 <= 0.8")
def class_lines(spark, d):
    best = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.max("value") / 100).alias("prob"))
    held = best.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("label"), "prob"))).alias("c"))
    return held.select("user_id", text.class_list(F.col("c"), 0.8).alias("shown"))
