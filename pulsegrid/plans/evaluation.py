"""Queries of evaluation runs, in the catalog's registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import dialogue, evaluation, reporting, retrieval
from ..sources import table
from .catalog import BM25, TURNS, WT, query, r6, records, turns

md5 = lambda c: F.md5(F.col(c).cast("binary"))


@query(f"WITH {TURNS}, n AS (SELECT *, lead(role) {WT} AS r, lead(action) {WT} AS a, lead(content) {WT} AS c FROM t WHERE role <> 'user') SELECT sample_id, pos, md5(c) AS reply FROM n WHERE action IN ('call_classification_tool', 'response_followup') AND r = 'assistant' AND coalesce(a, '') <> 'response_fail' AND trim(c) <> ''")
def tool_turn_replies(spark, d):
    # roles alternate in these tables, so tool turns meet replies only without the users' turns
    return evaluation.next_replies(turns(spark, d).where("role <> 'user'"), (dialogue.CLASSIFICATION, dialogue.FOLLOW_UP)).select("sample_id", "pos", md5("reply").alias("reply"))


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey % 7 AS q, CASE o_orderstatus WHEN 'F' THEN 'post_measurement' WHEN 'O' THEN 'direct' ELSE 'post_classification' END AS c, o_orderpriority AS p FROM orders),
b AS (SELECT k, q, arg_min({'reply': p, 'c': c}, {'o': list_position(['post_classification', 'post_measurement', 'direct'], c), 'p': p}) AS x FROM r GROUP BY 1, 2)
SELECT c_custkey AS sample_id, c_custkey % 7 AS user_query, x.reply AS reply, x.c AS found_in FROM customer LEFT JOIN b ON k = c_custkey AND q = c_custkey % 7""")
def replies_by_query(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "post_measurement").when(F.col("o_orderstatus") == "O", "direct").otherwise("post_classification")
    replies = table(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), (F.col("o_orderkey") % 7).alias("user_query"), kind.alias("category"), F.col("o_orderpriority").alias("reply"))
    truth = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), (F.col("c_custkey") % 7).alias("user_query"))
    return evaluation.replies_for(truth, replies)


@query("SELECT doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' END, 'plain') AS origin FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def first_source_wins(spark, d):
    labelled = table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("origin"))
    return evaluation.first_source([labelled, table(spark, d, "documents").select("doc_id", F.lit("plain").alias("origin"))], "doc_id")


@query(f"WITH {TURNS}, a AS (SELECT sample_id, md5(content) AS question, row_number() {WT} AS place FROM t WHERE role = 'user'), b AS (SELECT sample_id, md5(content) AS answer, row_number() {WT} AS place FROM t WHERE role = 'assistant') SELECT sample_id, place::INT AS place, question, answer FROM a JOIN b USING (sample_id, place)")
def questions_with_answers(spark, d):
    t = turns(spark, d)
    side = lambda role, name: t.where(F.col("role") == role).select("sample_id", "pos", md5("content").alias(name))
    return evaluation.zipped(side("user", "question"), side("assistant", "answer"), "pos")


@query("SELECT doc_id, unnest(['one', 'two', 'three']) AS model FROM labels")
def model_tasks(spark, d):
    return evaluation.task_grid(table(spark, d, "labels").select("doc_id"), ["one", "two", "three"])


@query("SELECT event_type, round(avg(value), 6) AS one, round(avg(value * 2), 6) AS two, count(*) AS n FROM events WHERE value >= 10 AND user_id % 3 <> 0 GROUP BY 1")
def both_scores_mean(spark, d):
    rows = table(spark, d, "events").select("event_type", F.when(F.col("value") >= 10, F.col("value")).alias("one"), F.when(F.col("user_id") % 3 != 0, F.col("value") * 2).alias("two"))
    return evaluation.both_scored(rows, "event_type", "one", "two")


@query("SELECT user_id, round(coalesce(avg(CASE WHEN value >= 10 THEN value END), 0), 6) AS naturalness, round(coalesce(avg(CASE WHEN value >= 10 THEN value / 2 END), 0), 6) AS cefr, count(*) FILTER (value >= 10) AS count, count(*) FILTER (value < 10) AS errors FROM events GROUP BY 1")
def dialogue_quality_means(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("value").alias("naturalness"), F.when(F.col("value") >= 10, F.col("value") / 2).alias("cefr"))
    return evaluation.dialogue_quality(rows, "user_id")


@query("SELECT round(coalesce(avg(quality), 0), 6) AS mean, count(quality) AS n FROM labels")
def faithfulness_mean(spark, d):
    return evaluation.mean_or_zero(table(spark, d, "labels"), "quality")


@query("WITH f AS (SELECT p_partkey AS id, p_size % 4 = 0 AS done, p_partkey % 3 <> 0 AS there, p_partkey % 5 = 0 AS bad FROM part) SELECT count(*) FILTER (NOT done AND there AND NOT bad) AS updated, count(*) FILTER (done) AS skipped, count(*) FILTER (NOT done AND NOT there) AS missing, count(*) FILTER (NOT done AND there AND bad) AS errors FROM f")
def label_outcomes(spark, d):
    part = table(spark, d, "part").withColumn("recording_id", F.col("p_partkey"))
    codes = part.where("p_partkey % 3 <> 0").select("recording_id", F.when(F.col("p_partkey") % 5 == 0, "not a dict").otherwise("{'NORM': 100.0}").alias("scp_codes"))
    return evaluation.outcomes(part.select("recording_id", F.when(F.col("p_size") % 4 == 0, 1).alias("label")), codes)


@query("""WITH m AS (SELECT DISTINCT s_nationkey, 'm' || (s_suppkey % 5) AS model FROM supplier), n AS (SELECT s_nationkey, string_agg(model, ',' ORDER BY model) AS models FROM m GROUP BY 1)
SELECT s_nationkey, sum(1 + s_suppkey % 7)::BIGINT AS speed, sum(s_suppkey % 11)::BIGINT AS queue_length, count(*) AS workers, any_value(models) AS models FROM supplier JOIN n USING (s_nationkey) GROUP BY 1""")
def fleet_status(spark, d):
    workers = table(spark, d, "supplier").select("s_nationkey", F.array(F.concat(F.lit("m"), F.col("s_suppkey") % 5)).alias("models"), (1 + F.col("s_suppkey") % 7).alias("speed"), (F.col("s_suppkey") % 11).alias("queue_length"))
    return evaluation.fleet(workers, "s_nationkey").withColumn("models", F.array_join("models", ","))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, vec_id % 64 AS p FROM embeddings), s AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN vec_id % 4 = 0 OR abs(i - p) <= 8 THEN 1.0 ELSE 0.0 END) AS m, x FROM e)
SELECT vec_id, round((list_sum(list_transform(x, lambda v, i: v * m[i])) / list_sum(m) + list_sum(list_transform(x, lambda v, i: v * v * m[i])) / list_sum(m)) / 2, 6) AS error FROM s""")
def masked_mean_error(spark, d):
    x = F.col("embedding").cast("array<double>")
    peaks = F.when(F.col("vec_id") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("vec_id") % 64).cast("int")))
    rows = table(spark, d, "embeddings").select("vec_id", F.array(x, F.transform(x, lambda v: v * v)).alias("passes"), evaluation.peak_mask(F.size("embedding"), peaks, 8).alias("mask"))
    return rows.select("vec_id", r6(evaluation.masked_error(F.col("passes"), F.col("mask"))).alias("error"))


@query("""WITH c AS (SELECT user_id, event_type AS code, CASE WHEN max(value) >= 50 THEN round(max(value), 0) ELSE 0 END AS p FROM events GROUP BY 1, 2), t(code, description) AS (VALUES ('click', 'a click'), ('view', 'a view'), ('error', 'an error'))
SELECT user_id AS recording_id, string_agg(code || ' (' || coalesce(description, code) || ')' || CASE WHEN p > 0 THEN ' [likelihood ' || p::INT || '%]' ELSE '' END, '; ' ORDER BY code) AS text FROM c LEFT JOIN t USING (code) GROUP BY 1""")
def ground_truth_text(spark, d):
    best = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v")).withColumn("p", F.when(F.col("v") >= 50, F.round("v", 0)).otherwise(0.0))
    item = F.struct("event_type", F.concat(F.lit("'"), "event_type", F.lit("': "), F.col("p").cast("string")).alias("item"))
    lists = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.item)
    codes = best.groupBy(F.col("user_id").alias("recording_id")).agg(F.concat(F.lit("{"), F.array_join(lists, ", "), F.lit("}")).alias("scp_codes"))
    described = spark.createDataFrame([("click", "a click"), ("view", "a view"), ("error", "an error")], "code string, description string")
    return evaluation.truth_text(codes, F.broadcast(described))  # a fixed list


MEASURED = """WITH m AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN floor(s_acctbal) END AS hr, s_nationkey::DOUBLE AS hv, CASE WHEN s_suppkey % 4 = 0 THEN floor(s_acctbal) / 2 END AS qrs, CASE WHEN s_suppkey % 2 = 0 THEN floor(s_acctbal) / 3 END AS qb, CASE WHEN s_suppkey % 5 <> 1 THEN floor(s_acctbal) * 2 END AS qc FROM supplier WHERE s_suppkey % 10 <> 9)
SELECT id AS ecg_id, concat_ws('; ', 'Heart rate: ' || printf('%.1f', coalesce(hr, hv)) || ' bpm', 'QRS duration: ' || printf('%.1f', qrs) || ' ms', 'QTc (Bazett): ' || printf('%.1f', coalesce(qb, qc)) || ' ms') AS text FROM m"""


def measured(spark, d):
    """supplier as a table of global measurements, all of them text."""
    k, v = F.col("s_suppkey"), F.floor("s_acctbal").cast("double")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("nan"))
    return table(spark, d, "supplier").select(
        F.when(k % 10 == 9, "none").otherwise(F.concat(k.cast("string"), F.lit(".0"))).alias("ecg_id"), text(F.when(k % 3 != 0, v)).alias("HR__Global"), F.col("s_nationkey").cast("string").alias("HR_Ventr_Global"), F.lit("").alias("PR_Int_Global"),
        text(F.when(k % 4 == 0, v / 2)).alias("QRS_Dur_Global"), F.lit(None).cast("string").alias("QT_Int_Global"), text(F.when(k % 2 == 0, v / 3)).alias("QT_IntBazett_Global"), text(F.when(k % 5 != 1, v * 2)).alias("QT_IntCorr_Global"),
    )


@query(MEASURED)
def measurement_text(spark, d):
    return evaluation.measurement_text(measured(spark, d))


@query("SELECT l.doc_id AS item, d.lang, md5(d.text) AS gold FROM labels l JOIN documents d USING (doc_id)")
def gold_lookup(spark, d):
    items = table(spark, d, "labels").select(F.col("doc_id").alias("gold_id"))
    return evaluation.with_gold(items, table(spark, d, "documents").select("doc_id", "lang", "text")).select(F.col("gold_id").alias("item"), "lang", md5("text").alias("gold"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def selected_responses(spark, d):
    chosen = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return evaluation.of_selected(table(spark, d, "orders"), chosen, "o_custkey").select("o_orderkey")


@query("SELECT source AS topic, CASE WHEN doc_id % 10 = 0 THEN 'superseded' ELSE 'current' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def topic_counts(spark, d):
    return evaluation.counts(records(spark, d).withColumn("topic", F.col("society")), "topic", "status")


@query("""WITH t AS (SELECT conv_id AS sample_id, turn AS pos, CASE WHEN turn % 3 = 0 THEN 'call_classification_tool' WHEN turn % 7 = 1 THEN 'call_measurement_tool' ELSE 'response' END AS a, md5(text) AS o FROM conversations), l AS (SELECT *, lag(a) OVER w AS pa, lag(o) OVER w AS po FROM t WINDOW w AS (PARTITION BY sample_id ORDER BY pos))
SELECT sample_id, pos, CASE pa WHEN 'call_classification_tool' THEN 'post_classification' WHEN 'call_measurement_tool' THEN 'post_measurement' ELSE 'direct_response' END AS category, CASE WHEN pa IN ('call_classification_tool', 'call_measurement_tool') THEN po END AS tool_output FROM l WHERE a = 'response'""")
def previous_action_category(spark, d):
    n = F.col("turn")
    action = F.when(n % 3 == 0, dialogue.CLASSIFICATION).when(n % 7 == 1, dialogue.MEASUREMENT).otherwise("response")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), n.alias("pos"), action.alias("gt_action"), md5("text").alias("gt_tool_output"))
    return dialogue.by_previous_action(rows).select("sample_id", "pos", "category", "tool_output")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0")
def unjudged_answers(spark, d):
    judged = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "an answer").otherwise(" ").alias("answer"))
    return dialogue.unjudged(table(spark, d, "documents").select("doc_id"), judged, ["doc_id"], "answer")


#: Codes of event types with topics that are sources of documents (null: not actionable), and terms that their texts may hold.
TERMS = [("CLICK", "the of and", "src1"), ("VIEW", "la de le", "src2"), ("PURCHASE", "der die", None), ("ERROR", "en ing", "src3"), ("SIGNUP", "que con", "src1")]
GROUNDED = """e AS (SELECT user_id, upper(event_type) AS code, round(value / 100, 2) AS prob, event_id FROM events), mp(code, en, topic) AS (VALUES ('CLICK', 'the of and', 'src1'), ('VIEW', 'la de le', 'src2'), ('ERROR', 'en ing', 'src3'), ('SIGNUP', 'que con', 'src1')),
k AS (SELECT user_id AS query_id, en, topic, min(event_id) AS pos FROM e JOIN mp USING (code) WHERE prob >= {at} GROUP BY ALL), tp AS (SELECT DISTINCT query_id, topic FROM k), qt AS (SELECT query_id, string_agg(en, ' ' ORDER BY pos) AS text FROM k GROUP BY 1),
q AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM qt) GROUP BY 1, 2)"""
REST = BM25[BM25.index("d AS (SELECT doc_id"):]


def found(spark, d):
    """events of each user as a list of findings."""
    item = F.concat(F.lit("'"), F.upper("event_type"), F.lit("("), F.format_string("%.2f", F.round(F.col("value") / 100, 2)), F.lit(")'"))
    lists = F.array_sort(F.collect_list(F.struct("event_id", item.alias("item"))))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("rec_id")).agg(F.concat(F.lit("["), F.array_join(F.transform(lists, lambda x: x.item), ", "), F.lit("]")).alias("findings"))


@query(f"""WITH {GROUNDED.format(at=0.95)}, {REST}, w AS (SELECT s.query_id, s.doc_id, row_number() OVER (PARTITION BY s.query_id ORDER BY round(bm25, 6) DESC, s.doc_id) AS rank FROM s JOIN tp ON tp.query_id = s.query_id AND tp.topic = s.source WHERE bm25 > 0 AND s.doc_id % 10 <> 0),
n AS (SELECT query_id, count(*) AS n FROM tp JOIN documents ON source = topic WHERE doc_id % 10 <> 0 GROUP BY 1) SELECT query_id, doc_id, rank::INT AS rank, (n - rank + 1)::DOUBLE AS score FROM w JOIN n USING (query_id) WHERE rank <= 3""")
def grounded_search(spark, d):
    mapping = spark.createDataFrame(TERMS, "code string, en string, topic string")
    known = records(spark, d).withColumn("topic", F.col("society"))
    return retrieval.grounded(known, found(spark, d), mapping, 3, 0.95, retrieval.passes()).select("query_id", "doc_id", "rank", "score")


@query(f"""WITH {GROUNDED.format(at=0)}, {REST}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM s WHERE doc_id % 10 <> 0), g AS (SELECT query_id, doc_id FROM (SELECT query_id, unnest(range(query_id % 151, query_id % 151 + 151 * 7, 151)) AS doc_id FROM qt) JOIN documents USING (doc_id)),
w AS (SELECT query_id, count(*) AS wanted FROM g GROUP BY 1), h AS (SELECT query_id, count(*) AS found, min(rank) AS first FROM r JOIN g USING (query_id, doc_id) WHERE rank <= 5 GROUP BY 1)
SELECT query_id, round(coalesce(found / wanted, 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS rr, round(coalesce(1.0 / log2(first + 1), 0), 6) AS ndcg, CASE WHEN found > 0 THEN 1 ELSE 0 END AS hit FROM qt LEFT JOIN w USING (query_id) LEFT JOIN h USING (query_id)""")
def findings_metrics(spark, d):
    mapping = spark.createDataFrame(TERMS, "code string, en string, topic string")
    items = found(spark, d).withColumnRenamed("rec_id", "query_id")
    # seven documents may be right for each query, whatever the table's size
    right = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda n: F.col("query_id") % 151 + 151 * n)
    gold = items.select("query_id", F.explode(right).alias("doc_id")).join(table(spark, d, "documents").select("doc_id"), "doc_id").select("query_id", "doc_id")
    return retrieval.findings_metrics(records(spark, d), items, gold, mapping, 5, retrieval.passes()).select("query_id", *(r6(c).alias(c) for c in ("recall", "rr", "ndcg")), "hit")


@query(r"""SELECT event_id, upper(event_type) AS label, round(floor(value) / 100, 2) AS prob FROM events WHERE event_id % 3 <> 0""")
def ui_classes(spark, d):
    prob = F.format_string("%.2f", F.floor("value") / 100)
    item = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("['PRC(S)("), prob, F.lit(")', 'X']"))).otherwise(F.concat(F.lit("[' "), F.upper("event_type"), F.lit(" ("), prob, F.lit(")', 'NONE']")))
    return table(spark, d, "events").select("event_id", F.explode(text.ui_classes(item)).alias("c")).select("event_id", "c.label", "c.prob")


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN turn::INT END AS accuracy, CASE WHEN turn % 4 <> 3 THEN CASE WHEN turn % 2 = 0 THEN 'as ' || role ELSE 'No justification found.' END END AS reason, CASE WHEN turn % 4 = 0 THEN (turn + 3) / 2 WHEN turn % 4 = 3 THEN NULL ELSE turn::DOUBLE END AS average FROM conversations""")
def judge_replies(spark, d):
    n = F.col("turn")
    reply = F.concat_ws("\n", F.when(n % 4 != 3, F.concat(F.lit("ACCURACY: "), n)), F.when(n % 2 == 0, F.concat(F.lit("Accuracy Explanation:  as "), "role", F.lit(" "))), F.when(n % 4 == 0, F.lit("complete (1-5): 3")), F.lit("so accuracy: 9"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.judgement(reply, ["Accuracy", "complete (1-5)"]).alias("j"))
    return rows.select("conv_id", "turn", F.col("j.scores")["Accuracy"].alias("accuracy"), F.col("j.reasons")["Accuracy"].alias("reason"), "j.average")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 4 THEN quality END AS correct, CASE WHEN doc_id % 5 <> 4 THEN toxic END AS faithful FROM labels""")
def fenced_verdicts(spark, d):
    body = F.concat(F.lit('{"correct": '), "quality", F.lit(', "faithful": '), "toxic", F.lit("}"))
    fenced = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit(" ```"), body, F.lit("``` "))).when(F.col("doc_id") % 5 == 4, F.concat(F.lit("so: "), body)).otherwise(body)
    return table(spark, d, "labels").select("doc_id", text.fenced_json(fenced, "correct int, faithful int").alias("v")).select("doc_id", "v.*")


@query("SELECT conv_id, turn, md5('Action: ' || CASE WHEN turn % 2 = 0 THEN role ELSE '' END || chr(10) || 'Thought: none' || chr(10) || CASE WHEN turn % 3 = 0 THEN 'Tool_Output: {1}' ELSE 'Content: ' || text END) AS text, turn AS number FROM conversations")
def turn_lines(spark, d):
    n = F.col("turn")
    made = text.turn_text(F.when(n % 2 == 0, F.col("role")), F.lit("none"), F.col("text"), F.when(n % 3 == 0, "{1}"))
    number = text.first_number(F.concat(F.lit("turn no. "), n, F.lit(" of 99")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(made.cast("binary")).alias("text"), number.alias("number"))


@query("SELECT conv_id, turn, md5('Compare the answer with the reference.' || chr(10) || 'Question: ' || role || chr(10) || 'Tool output: N/A' || chr(10) || 'Reference: ' || CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'N/A' END || chr(10) || 'Answer: ' || turn || chr(10) || 'Accuracy: [score]' || chr(10) || 'Accuracy Explanation: [justification]') AS prompt FROM conversations")
def judge_prompts(spark, d):
    prompt = reporting.judge_prompt(["Accuracy"], question=F.col("role"), tool_output=F.lit(None), reference=F.when(F.col("turn") % 2 == 0, "yes").otherwise(" "), answer=F.col("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(prompt.cast("binary")).alias("prompt"))


@query("SELECT p_name AS section, p_type AS text FROM (SELECT p_name, min(CASE WHEN p_size > 25 THEN p_type END) AS t FROM part GROUP BY 1), LATERAL (SELECT coalesce(t, p_name) AS p_type)")
def sections_or_names(spark, d):
    part = table(spark, d, "part")
    return reporting.section_or_name(part.where("p_size > 25").select(F.col("p_name").alias("section"), F.col("p_type").alias("text")), part.select(F.col("p_name").alias("section")).distinct())


@query(f"""WITH {TURNS}, a AS (SELECT sample_id, list(action ORDER BY pos) FILTER (action <> 'call_classification_tool') AS acts, list(md5(content) ORDER BY pos) FILTER (role = 'assistant') AS replies FROM t GROUP BY 1),
r AS (SELECT sample_id, acts, replies, unnest(range(1, len(replies) + 1)) AS i FROM a) SELECT sample_id, i::INT AS place, 'ECG_Inquiry' AS category, coalesce(acts[i], 'response') AS action, replies[i] AS reply FROM r""")
def results_reassembled(spark, d):
    said = turns(spark, d).where("role = 'assistant'").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "action", md5("content").alias("reply")))).alias("t"))
    parts = evaluation.reassembled(F.transform("t", lambda x: x.action), F.transform("t", lambda x: x.reply), [dialogue.CLASSIFICATION], F.lit(None).cast("string"))
    rows = said.select("sample_id", F.posexplode(parts).alias("n", "r"))
    return rows.select("sample_id", (F.col("n") + 1).alias("place"), "r.*")


@query("""WITH e AS (SELECT event_id, unnest(range(0, 2)) AS i, upper(event_type) AS code, round(floor(value) / 100, 2) AS prob FROM events)
SELECT event_id, CASE i WHEN 0 THEN code ELSE 'PRC(S)' END AS code, CASE i WHEN 0 THEN prob END AS prob FROM e""")
def findings_forms(spark, d):
    """Findings in single and double quotes and in none; what is neither a code nor one with a number is dropped."""
    n, prob = F.col("event_id") % 3, F.format_string("%.2f", F.floor("value") / 100)
    first = F.concat(F.upper("event_type"), F.when(n == 2, "(").otherwise(" ( "), prob, F.lit(")"))
    quoted = lambda q: F.concat(F.lit(f"[{q}"), first, F.lit(f"{q}, {q}PRC(S){q}, {q}no code!{q}]"))
    written = F.when(n == 0, quoted("'")).when(n == 1, quoted('"')).otherwise(F.concat(F.lit("["), first, F.lit(", PRC(S)  what? ]")))
    return table(spark, d, "events").select("event_id", F.explode(text.findings(written)).alias("f")).select("event_id", "f.code", "f.prob")


@query(r"""WITH d AS (SELECT doc_id, lower(translate(text, 'aeiou', '心律不齐房')) AS text FROM documents),
t AS (SELECT doc_id, regexp_extract_all(text, '[a-z0-9]+') AS a, regexp_extract_all(text, '[\x{4e00}-\x{9fff}]+') AS c FROM d)
SELECT doc_id, md5(array_to_string(list_concat(a, flatten(list_transform(c, lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: r[i]), list_transform(range(1, length(r)), lambda i: r[i : i + 1]))))), ' ')) AS tokens, len(a) + coalesce(list_sum(list_transform(c, lambda r: 2 * length(r) - 1)), 0)::BIGINT AS n FROM t""")
def cjk_tokens(spark, d):
    """Tokens of texts whose vowels are ideographs: runs of letters, then single characters and pairs of each run of ideographs."""
    found = table(spark, d, "documents").select("doc_id", text.tokens(F.translate("text", "aeiou", "心律不齐房")).alias("t"))
    return found.select("doc_id", F.md5(F.array_join("t", " ").cast("binary")).alias("tokens"), F.size("t").cast("long").alias("n"))
