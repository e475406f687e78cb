"""Queries of metrics, rewards, judging and answers (C, H, Q, S13 to S30)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.functions import answers as q
from sluice.functions import numeric as n
from sluice.operators import metrics as m
from sluice.operators import reward as r
from sluice.plans.text_queries import _case, _forms, in_python
from sluice.session import spread, table


def _e(spark, d):
    return table(spark, d, "events")


def _r6(df, *columns):
    return df.select(*(F.round(c, 5).alias(c) if c in columns else c for c in df.columns))


@query("op_c06_data_metrics", """WITH r AS (SELECT user_id, sum(value) / 97 AS score, avg(value) / 97 AS reward, count(*) AS len FROM events GROUP BY 1),
 t AS (SELECT value / 97 AS adv, event_id / 97e0 AS ret, user_id / 97e0 AS value FROM events WHERE event_type <> 'error')
 SELECT round((SELECT avg(score) FROM r), 5) AS score_mean, round((SELECT max(reward) FROM r), 5) AS reward_max, (SELECT min(len) FROM r) AS length_min, round(avg(adv), 5) AS adv_mean, round(max(ret), 5) AS ret_max,
  round(1 - var_samp(ret - value) / (var_samp(ret) + 1e-5), 5) AS explained_var FROM t""")
def c06(spark, d):
    rows = _e(spark, d).groupBy("user_id").agg((F.sum("value") / 97).alias("score"), (F.avg("value") / 97).alias("reward"), F.count(F.lit(1)).alias("response_length"))
    tokens = _e(spark, d).filter("event_type <> 'error'").select((F.col("value") / 97).alias("adv"), (F.col("event_id") / 97).alias("ret"), (F.col("user_id") / 97).alias("value"))
    out = m.data_metrics(rows, tokens, 10, critic=True).select("score_mean", "reward_max", "length_min", "adv_mean", "ret_max", "explained_var")
    return _r6(out, "score_mean", "reward_max", "adv_mean", "ret_max", "explained_var")


@query("op_c07_timing", "SELECT event_type AS section, round(sum(value) * 1000 / CASE WHEN event_type IN ('gen', 'reward', 'view') THEN count(*) ELSE count(*) * 3 END, 4) AS ms FROM (SELECT CASE WHEN event_type = 'view' THEN 'gen' ELSE event_type END AS event_type, value FROM events) GROUP BY event_type")
def c07(spark, d):
    e = _e(spark, d).withColumn("section", F.when(F.col("event_type") == "view", "gen").otherwise(F.col("event_type")))
    t = e.groupBy("section").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("k"))
    return t.select("section", F.round(m.ms_per_token(F.col("section"), F.col("s"), F.col("k"), F.col("k") * 3), 4).alias("ms"))


@query("op_c08_throughput", "SELECT round(count(*) / (sum(value) * 8), 8) AS tps FROM events")
def c08(spark, d):
    return _e(spark, d).agg(F.round(m.throughput(F.count(F.lit(1)), F.sum("value"), 8), 8).alias("tps"))


@query("op_c09_reduce", "SELECT event_type AS name, round(avg(value), 5) AS value FROM events GROUP BY 1")
def c09(spark, d):
    return _r6(m.reduce_metrics(_e(spark, d).select(F.col("event_type").alias("name"), "value")), "value")


@query("op_c10_accuracy", "SELECT round(avg(quality), 6) AS acc FROM labels")
def c10(spark, d):
    return table(spark, d, "labels").agg(F.round(F.avg("quality"), 6).alias("acc"))


# formulas with functions and of more terms than are multiplied out; a text that is no formula is undecided
@query("op_q11_functions", "SELECT event_id, CASE event_id % 5 WHEN 3 THEN event_id % 2 = 0 WHEN 4 THEN NULL ELSE event_id % 3 <> 2 END AS equal FROM events")
def q11_functions(spark, d):
    n, k, odd = F.col("event_id").cast("string"), F.col("event_id") % 5, F.col("event_id") % 3 == 2
    put = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    wrong = F.when(odd, F.lit(" + 0.5")).otherwise("")
    pred = F.when(k == 0, put("\\sin^2(", n, "x) + \\cos^2(", n, "x)", wrong)).when(k == 1, put("\\ln(", n, " + 1) + e^{x + y}", wrong)).when(k == 2, put("(x + y + z + ", n, ")^{50}", wrong))
    pred = pred.when(k == 3, put("\\sqrt{x^2} + ", n)).otherwise(put("about ", n, "?"))
    truth = F.when(k == 0, F.lit("1")).when(k == 1, put("e^x e^y + \\ln(1 + ", n, ")")).when(k == 2, put("(", n, " + z + y + x)^{50}"))
    truth = truth.when(k == 3, F.when(F.col("event_id") % 2 == 0, put(n, " + |x|")).otherwise(put(n, " + x"))).otherwise(n)
    return spread(_e(spark, d).select("event_id")).select("event_id", q.udf(q.symbolic_equal, "boolean")(pred, truth).alias("equal"))


@query("op_c11_difficulty", "SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END), 6) AS acc FROM events GROUP BY 1 HAVING acc > 0 AND acc <= 0.2")
def c11(spark, d):
    e = _e(spark, d).withColumn("ok", F.col("event_type") == "purchase")
    return m.select_by_difficulty(e, "user_id", "ok", 0.2).select("user_id", F.round("acc", 6).alias("acc"))


@query("op_c12_selection_count", "SELECT user_id, count(*) AS n, min(event_id // 100) AS first_epoch FROM events WHERE event_type = 'purchase' GROUP BY 1")
def c12(spark, d):
    return _e(spark, d).filter("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.expr("event_id div 100")).alias("first_epoch"))


_STATS = "(SELECT user_id, min(value) AS min_len, avg(value) AS mean_len, count(*) AS cnt FROM events WHERE event_type = 'purchase' AND user_id % 3 <> 0 GROUP BY 1)"


def _stats(spark, d):
    return m.length_stats(_e(spark, d).filter("event_type = 'purchase' AND user_id % 3 <> 0"), "user_id", "value")


for _name in ("op_c13_length_stats", "op_c14_sample_length_stats"):

    @query(_name, f"SELECT user_id, min_len, round(mean_len, 5) AS mean_len, cnt FROM {_STATS}")
    def c13(spark, d):
        return _r6(_stats(spark, d), "mean_len")


for _name in ("op_c15_look_up", "op_c16_step_look_up"):

    @query(_name, f"SELECT user_id, min_len IS NULL AS unseen, coalesce(min_len, -1) AS min_len, round(coalesce(mean_len, 0), 5) AS mean_len FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN {_STATS} USING (user_id)")
    def c15(spark, d):
        found = m.look_up(_e(spark, d).select("user_id").distinct(), _stats(spark, d), "user_id")
        unseen = F.col("min_len") == float("inf")
        return found.select("user_id", unseen.alias("unseen"), F.when(unseen, -1.0).otherwise(F.col("min_len")).alias("min_len"), F.round("mean_len", 5).alias("mean_len"))


@query("op_c17_sticky_flag", "SELECT user_id, bool_or(event_id % 97 = 0) AS correct FROM events GROUP BY 1")
def c17(spark, d):
    return _e(spark, d).groupBy("user_id").agg(F.bool_or(F.col("event_id") % 97 == 0).alias("correct"))


@query("op_c18_state_read", "SELECT user_id, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1")
def c18(spark, d):
    return _e(spark, d).filter("user_id = 7").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("op_c19_cluster_summary", "SELECT label, count(*) AS clusters, round(avg(n), 5) AS mean_members FROM (SELECT label, vec_id % 7 AS c, count(*) AS n FROM embeddings GROUP BY 1, 2) GROUP BY 1")
def c19(spark, d):
    inner = table(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 7).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return inner.groupBy("label").agg(F.count(F.lit(1)).alias("clusters"), F.round(F.avg("n"), 5).alias("mean_members"))


@query("op_c20_imbalance", "WITH s AS (SELECT doc_id % 8 AS p, sum(n_chars) AS s FROM documents GROUP BY 1) SELECT min(s) AS min, max(s) AS max, max(s) - min(s) AS diff, round(avg(s), 4) AS mean FROM s")
def c20(spark, d):
    return m.imbalance(table(spark, d, "documents").withColumn("p", F.col("doc_id") % 8), "n_chars", "p").withColumn("mean", F.round("mean", 4))


for _name in ("op_c21_token_totals", "op_c22_valid_tokens"):

    @query(_name, "SELECT user_id, count(CASE WHEN event_type <> 'error' THEN 1 END) AS tokens FROM events GROUP BY 1")
    def c21(spark, d):
        masks = _e(spark, d).groupBy("user_id").agg(F.collect_list((F.col("event_type") != "error").cast("long")).alias("mask"))
        return masks.select("user_id", F.aggregate("mask", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("tokens"))


@query("op_c23_sequence_score", "SELECT user_id, round(sum(value), 4) AS score FROM events GROUP BY 1")
def c23(spark, d):
    rows = _e(spark, d).groupBy("user_id").agg(F.collect_list("value").alias("v"))
    return rows.select("user_id", F.round(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x), 4).alias("score"))


@query("op_c24_validation_score", "SELECT round(avg(s), 5) AS reward_score, round(avg(k), 5) AS count_reward FROM (SELECT user_id, sum(value) / 97 AS s, count(*) / 97e0 AS k FROM events GROUP BY 1)")
def c24(spark, d):
    rows = _e(spark, d).groupBy("user_id").agg((F.sum("value") / 97).alias("s"), (F.count(F.lit(1)) / 97).alias("k"))
    return rows.agg(F.round(F.avg("s"), 5).alias("reward_score"), F.round(F.avg("k"), 5).alias("count_reward"))


for _name, _positive in (("op_c25_rolling_log", False), ("op_c26_rolling_log_positive", True), ("op_c27_rolling_log_stage3", False)):

    def _register(name, positive):
        @query(name, "SELECT event_id // 10 AS point, round(avg(value / 97), 6) AS loss FROM events GROUP BY 1" + " HAVING sum(value) > 0" * positive)
        def c25(spark, d):
            return m.rolling_log(_e(spark, d).select(F.col("event_id").alias("step"), (F.col("value") / 97).alias("loss")), 10, "loss", positive)

    _register(_name, _positive)


@query("op_c28_emphasised_accuracy", "SELECT round(avg(acc), 6) AS accuracy FROM (SELECT user_id, avg(CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END) AS acc FROM events WHERE event_type = 'click' GROUP BY 1)")
def c28(spark, d):
    e = _e(spark, d).select("user_id", (F.col("value") > 50).alias("hit"), (F.col("event_type") == "click").alias("mark"))
    return m.emphasised_accuracy(e, "user_id", "hit", "mark").withColumn("accuracy", F.round("accuracy", 6))


@query("op_c29_weighted_loss", "SELECT round(sum(value * w) / greatest(1e0, sum(w)), 5) AS loss FROM (SELECT value, CASE WHEN event_type = 'error' THEN 0e0 WHEN event_type = 'click' THEN 2e0 ELSE 1e0 END AS w FROM events)")
def c29(spark, d):
    w = F.when(F.col("event_type") == "click", 2.0).otherwise(1.0)
    return _e(spark, d).agg(F.round(m.weighted_loss(F.col("value"), w, F.col("event_type") != "error"), 5).alias("loss"))


_FLOPS = "(6e0 * ((64 * 172 * 3 + 64 * (4 * 16 * 2 + 2 * 16 * 2)) * 2 + 1000 * 64 * 2) * sum(n_chars) + 12e0 * sum(n_chars * n_chars) * 16 * 4 * 2) / 3 / 1e12"


@query("op_c30_flops", f"SELECT round({_FLOPS}, 6) AS tflops FROM documents")
def c30(spark, d):
    docs = table(spark, d, "documents")
    return docs.agg(F.round(n.flops(F.sum("n_chars"), F.sum(F.col("n_chars") * F.col("n_chars")), 2, 64, 172, 4, 2, 1000, F.lit(3)), 6).alias("tflops"))


@query("op_c31_device_peak", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 312e12 WHEN p_partkey % 3 = 1 THEN 119.5e12 ELSE 'inf'::DOUBLE END / 1e12 AS peak FROM part")
def c31(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, "Device A100-SXM").when(F.col("p_partkey") % 3 == 1, "L20").otherwise("other")
    return table(spark, d, "part").select("p_partkey", (n.device_peak(name) / 1e12).alias("peak"))


@query("op_c33_flop_metric", f"SELECT round({_FLOPS}, 6) AS tflops, 989e0 AS promised FROM documents")
def c33(spark, d):
    return c30(spark, d).withColumn("promised", n.device_peak(F.lit("H100")) / 1e12)


@query("op_c34_actor_metrics", "SELECT round(avg(v), 5) AS loss FROM (SELECT event_id // 100 AS mini, event_id // 20 AS micro, avg(value) AS v FROM events GROUP BY 1, 2)")
def c34(spark, d):
    micro = _e(spark, d).groupBy(F.expr("event_id div 100").alias("mini"), F.expr("event_id div 20").alias("micro")).agg(F.avg("value").alias("v"))
    return micro.agg(F.round(F.avg("v"), 5).alias("loss"))


@query("op_c35_critic_metrics", "SELECT mini, round(avg(v), 5) AS loss FROM (SELECT event_id // 100 AS mini, event_id // 20 AS micro, max(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def c35(spark, d):
    micro = _e(spark, d).groupBy(F.expr("event_id div 100").alias("mini"), F.expr("event_id div 20").alias("micro")).agg(F.max("value").alias("v"))
    return micro.groupBy("mini").agg(F.round(F.avg("v"), 5).alias("loss"))


@query("op_a17_retention", "SELECT o_orderkey AS step, row_number() OVER (ORDER BY o_orderkey DESC) <= 4 AS keep FROM orders WHERE o_orderkey < 900")
def a17(spark, d):
    return m.retained(table(spark, d, "orders").select(F.col("o_orderkey").alias("step")), 900, 5)


for _name in ("op_a19_wide_samples", "op_a20_wide_table"):

    @query(_name, "SELECT event_id // 50 AS step, " + ", ".join(f"max(CASE WHEN event_id % 50 = {i} THEN event_type END) AS input_{i}, max(CASE WHEN event_id % 50 = {i} THEN value END) AS score_{i}" for i in range(3)) + " FROM events GROUP BY 1")
    def a19(spark, d):
        e = _e(spark, d).select(F.expr("event_id div 50").alias("step"), (F.col("event_id") % 50).alias("i"), F.col("event_type").alias("input"), F.col("value").alias("score"))
        return m.wide_samples(e, "step", "i", ["input", "score"], 3)


# rewards and judging

_ROLL = "(SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END AS acc, CASE WHEN event_id % 2 = 0 THEN 1e0 ELSE 0e0 END AS fmt, CAST(trunc(value) AS BIGINT) AS len, user_id % 4 * 20 AS ref FROM events)"


def _roll(spark, d):
    return _e(spark, d).select("event_id", (F.col("event_type") == "purchase").cast("double").alias("acc"), (F.col("event_id") % 2 == 0).cast("double").alias("fmt"), F.col("value").cast("long").alias("len"), (F.col("user_id") % 4 * 20).alias("ref"))


for _name in ("op_h01_batch_score", "op_h02_score_from_correctness"):

    @query(_name, f"SELECT event_id, round(0.9e0 * acc + 0.1e0 * fmt - 0.001e0 * CASE WHEN len > ref AND ref <> 0 THEN len - ref ELSE 0 END, 6) AS overall, fmt AS format, acc AS accuracy FROM {_ROLL}")
    def h01(spark, d):
        x = _roll(spark, d).select("event_id", r.score(F.col("acc"), F.col("fmt"), F.col("len"), F.col("ref")).alias("x")).select("event_id", "x.*")
        return x.withColumn("overall", F.round("overall", 6))


@query("op_h03_simple_score", f"SELECT event_id, 0.5e0 * acc + 0.5e0 * fmt AS overall FROM {_ROLL}")
def h03(spark, d):
    return _roll(spark, d).select("event_id", r.simple_score(F.col("acc"), F.col("fmt")).alias("overall"))


@query("op_h06_cascade", f"SELECT event_id, CASE WHEN acc = 1 THEN acc ELSE coalesce(CASE WHEN len % 3 = 0 THEN fmt END, acc) END AS verdict FROM {_ROLL}")
def h06(spark, d):
    asked = F.when(F.col("len") % 3 == 0, F.col("fmt"))
    return _roll(spark, d).select("event_id", r.cascade(F.col("acc"), asked).alias("verdict"))


@query("op_h07_verdict", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 WHEN 2 THEN 0e0 WHEN 4 THEN 0e0 END AS yes_no, CASE event_id % 5 WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 WHEN 2 THEN 0e0 WHEN 4 THEN -1e0 END AS score FROM events")
def h07(spark, d):
    k = F.col("event_id") % 5
    reply = F.when(k == 0, " Yes. ").when(k == 1, "no").when(k == 2, "yes, now").when(k == 3, "  ").otherwise("-1")
    args = reply, F.lit("p"), F.lit("t")
    return _e(spark, d).select("event_id", r.verdict(*args).alias("yes_no"), r.verdict(*args, repetition=True).alias("score"))


@query("op_h09_judgement_format", "SELECT event_id, event_id % 3 < 2 AS ok FROM events")
def h09(spark, d):
    x = F.concat(F.lit("[Judgment]: "), (F.col("event_id") % 3).cast("string"))
    return _e(spark, d).select("event_id", r.judgement_format(x).alias("ok"))


#: The answer that is asked for: that of the text for even events, a far one for odd events.
_EVEN = "event_id % 2 = 0"


def _wanted():
    return F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(2 * F.col("event_id") + 7).cast("string")


def _graded(f, around: str = "{}"):
    """``f`` of a text and the answer that is asked for, which is put into ``around``."""
    before, after = around.split("{}")
    return in_python(lambda x: q.udf(f, "boolean")(x, F.concat(F.lit(before), _wanted(), F.lit(after))))


@query("op_h10_judge_or_rule", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 ELSE CASE WHEN event_id % 2 = 0 THEN 1e0 ELSE 0e0 END END AS verdict FROM events")
def h10(spark, d):
    # the judge says yes, says no, or fails, and then the rule grades
    def judge(question, pred, gt):
        if question == "2":
            raise ConnectionError("no answer")
        return "yes" if question == "0" else "no"

    rows = spread(_e(spark, d).select("event_id")).select("event_id", (F.col("event_id") % 3).cast("string").alias("question"), F.col("event_id").cast("string").alias("pred"), _wanted().alias("gt"))
    asked = r.judge_rows(rows, judge)
    api = F.when(F.col("reply") == "yes", 1.0).when(F.col("reply") == "no", 0.0)
    return asked.select("event_id", F.coalesce(api, r.rule_judge(F.col("pred"), F.col("gt"))).alias("verdict"))


@query("op_h08_batch_judge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS reply FROM events")
def h08(spark, d):
    rows = _e(spark, d).select("event_id", F.lit("q").alias("question"), (F.col("event_id") % 2).cast("string").alias("pred"), F.lit("0").alias("gt"))
    return r.judge_rows(rows, lambda question, pred, gt: "yes" if pred == gt else "no").select("event_id", "reply")


for _name in ("op_h11_rule_judge", "op_h12_distributed_judge"):

    @query(_name, "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0e0 ELSE 1e0 END AS verdict FROM events")
    def h11(spark, d):
        k = F.col("event_id") % 4
        pred = F.when(k == 0, "71").when(k == 1, "70").when(k == 2, "70.0").otherwise("\\frac{140}{2} = 70")
        pred = F.when(k == 3, "the value is 70").otherwise(pred)
        return spread(_e(spark, d).select("event_id")).select("event_id", r.rule_judge(pred, F.lit("70")).alias("verdict"))


@query("op_h04_batch_reward", "SELECT event_id, source, CASE source WHEN 'single_step_rewards' THEN value WHEN 'full_step_rewards' THEN 2 * value WHEN 'correctness' THEN CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END ELSE CASE WHEN event_id % 2 = 0 THEN 1e0 ELSE 0e0 END END AS reward FROM events, (SELECT unnest(['single_step_rewards', 'full_step_rewards', 'correctness', 'ground_truth']) AS source)")
def h04(spark, d):
    # batches that have ever fewer of the columns by which rows can be scored
    rows = _e(spark, d).select("event_id", F.col("event_id").cast("string").alias("response"), F.col("value").alias("single_step_rewards"), (2 * F.col("value")).alias("full_step_rewards"), (F.col("event_type") == "purchase").cast("double").alias("correctness"), _wanted().alias("ground_truth"))
    out = None
    for k in range(len(r.REWARD_SOURCES)):
        batch = rows.drop(*r.REWARD_SOURCES[:k])
        source = r.reward_source(batch)
        if source == "ground_truth":  # graded in Python
            batch = spread(batch)
        reward = r.rule_judge(F.col("response"), F.col(source)) if source == "ground_truth" else F.col(source)
        scored = batch.select("event_id", F.lit(source).alias("source"), reward.alias("reward"))
        out = scored if out is None else out.unionByName(scored)
    return out


@query("op_h05_row_reward", "SELECT event_id, 0.5e0 + CASE WHEN event_id % 2 = 0 THEN 0.5e0 ELSE 0e0 END AS reward FROM events")
def h05(spark, d):
    text = F.concat(F.lit("<think>a</think><answer>"), (F.col("event_id") % 2).cast("string"), F.lit("</answer>"))
    accuracy = q.udf(q.tagged_accuracy, "double")(text, F.lit("0"))
    return spread(_e(spark, d).select("event_id")).select("event_id", r.simple_score(accuracy, F.lit(1.0)).alias("reward"))


# answers

_NUM = ("", None)
_ID = "CAST(event_id AS VARCHAR)"


def _u(f, kind="string"):
    return in_python(lambda x: q.udf(f, kind)(x))


def _spelled(n):
    """Thousands up to 99 and units up to 19 in words."""
    units = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    word = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    top, low = n % 100, n % 20
    thousands = F.when(top < 20, word(units, F.least(top, F.lit(19)))).when(top % 10 == 0, word(tens, F.greatest(top / 10 - 2, F.lit(0)))).otherwise(
        F.concat(word(tens, F.greatest(F.floor(top / 10) - 2, F.lit(0))), F.lit(" "), word(units, top % 10))
    )
    return F.when(top == 0, word(units, low)).when(low == 0, F.concat(thousands, F.lit(" thousand"))).otherwise(F.concat(thousands, F.lit(" thousand "), word(units, low)))


def _shaped(x):
    """A plain number, a pair, an equation or a plain word."""
    k = F.col("event_id") % 4
    return F.when(k == 0, x).when(k == 1, F.concat(F.lit("("), x, F.lit(",2)"))).when(k == 2, F.concat(F.lit("x = "), x)).otherwise("word")


_forms("op_s13_tag_accuracy", [("<answer>", None, "</answer>"), ("", None), ("<answer>", None, "1</answer>"), ("no ", None, " <answer> ", None, ".0 </answer>"), ("7", None, "7")], in_python(lambda x: q.udf(q.tagged_accuracy, "double")(x, F.col("event_id").cast("string"))), ["1e0", "1e0", "0e0", "1e0", "0e0"])
_case("op_s14_last_box", ("a \\boxed{0} b \\boxed{x{", None, "}} c"), _u(q.last_box), f"'\\boxed{{x{{' || {_ID} || '}}}}'")
_case("op_s15_last_box_pair", ("\\fbox{", None, "} end"), _u(q.last_box), f"'\\fbox{{' || {_ID} || '}}'")
_case("op_s17_boxed_content", ("a \\boxed{0} b \\boxed{x{", None, "}} c"), _u(q.boxed_content), f"'x{{' || {_ID} || '}}'")
_case("op_s18_first_box", ("a boxed{", None, "} boxed{9}"), _u(q.first_box_content), _ID)
_case("op_s20_unwrap_text", ("5 \\text{ km", None, " }"), _u(q.unwrap_text), f"'5 km' || {_ID}")
_case("op_s21_unwrap_and", ("\\text{and}", None), _u(q.unwrap_text), _ID)
_case("op_s24_all_boxes", ("\\boxed{", None, "} \\mbox{b}"), _u(q.box_contents, "array<string>"), f"[{_ID}, 'b']")
_case("op_s27_bracket_groups", ("f(1,", None, ") {2} [a,b]"), _u(q.bracket_groups, "array<string>"), f"['(1,' || {_ID} || ')', '[a,b]']")
_case("op_s30_text_boxes", ("a\\text{x}^2 ", None), _u(q.drop_text_boxes), f"'a ' || {_ID}")
_case("op_q01_normalise", ("x = \\dfrac{", None, "}{3} \\text{ cm}"), _u(q.normalise_answer), f"'\\frac{{' || {_ID} || '}}{{3}}'")
_forms(
    "op_q01_normalise_forms",
    [("x = \\dfrac{", None, "}{3} \\text{ cm}"), ("\\$", None), ("", None, "\\%"), ("\\left( ", None, ", 8 \\right)"), ("", None, "^{\\circ}"), ("", None, "/3"), ("k = ", None, " cm"), ("{", None, "}")],
    _u(q.normalise_answer),
    [f"'\\frac{{' || {_ID} || '}}{{3}}'", _ID, _ID, f"'(' || {_ID} || ',8)'", _ID, f"'\\frac{{' || {_ID} || '}}{{3}}'", _ID, f"'{{' || {_ID} || '}}'"],
)
_forms(
    "op_q08_math_equal_forms",
    [("", None, "%"), ("", None, ".0"), ("x = ", None), ("1", None), ("", None, " + a"), ("\\frac{2 \\cdot ", None, "}{2}"), ("", None, ".5"), ("", None, "00")],
    in_python(lambda x: q.udf(q.math_equal, "boolean")(x, F.col("event_id").cast("string"))),
    # a half more is within a relative 1e-4 of large numbers
    ["true", "true", "true", "false", "false", "true", "0.5 <= 1e-4 * (event_id + 0.5)", "true"],
)
_case("op_q02_number_words", ("", None), in_python(lambda x: q.udf(q.words_to_number, "string")(_spelled(x.cast("long")))), "CAST(event_id % 100 * 1000 + event_id % 20 AS VARCHAR)")
_case("op_q03_braced_root", ("\\sqrt", None), q.braced_root, f"'\\sqrt{{' || {_ID} || '}}'")
_case("op_q04_fractions", ("\\frac12+", None), _u(q.braced_fractions), f"'\\frac{{1}}{{2}}+' || {_ID}")
_case("op_q05_slash", ("", None, "/7"), q.slash_fraction_column, f"'\\frac{{' || {_ID} || '}}{{7}}'")
_case("op_q06_old_slash", ("", None, "/7"), _u(q.slash_fraction), f"'\\frac{{' || {_ID} || '}}{{7}}'")
_case("op_q07_equivalent", ("x=", None, ".00 cm"), _graded(q.equivalent), _EVEN)
_case("op_q08_math_equal", ("(1, ", None, ")"), _graded(q.math_equal, "(1.0,{}.0)"), _EVEN)
_case("op_q09_parsed_number", ("1,", None, "%"), lambda x: F.round(q.parsed_number(x), 6), f"round(CAST('1' || {_ID} AS DOUBLE) / 100, 6)")
# off by none, 60 or 120 millionths, upwards and downwards
_case("op_q10_numeric_equal", _NUM, lambda x: q.numeric_equal(x.cast("double"), F.col("event_id") * (1 + (F.col("event_id") % 5 - 2) * F.lit(6e-5))), "abs(CAST(x AS DOUBLE) - event_id * (1 + (event_id % 5 - 2) * 6e-5)) <= 1e-4 * greatest(abs(CAST(x AS DOUBLE)), abs(event_id * (1 + (event_id % 5 - 2) * 6e-5)))")
_case("op_q13_set_matrix", ("{1,", None, "}"), _u(q.set_as_matrix), f"'\\begin{{pmatrix}}1\\' || {_ID} || '\\end{{pmatrix}}'")
_case("op_q14_literal", ("a, ", None), lambda x: F.coalesce(q.literal_equal(x, F.concat(F.lit("a"), _wanted())), F.lit(False)), _EVEN)
_case("op_q15_number_equal", _NUM, lambda x: q.number_equal(x, F.concat(_wanted(), F.lit(".0"))), _EVEN)
_case("op_q16_number_check", ("y = ", None, ". "), _graded(q.number_check), _EVEN)
_case("op_q17_latex_check", ("$", None, "$ meters"), _graded(q.latex_check), _EVEN)
_case("op_q18_structure", ("", None, ""), lambda x: 2 * q.has_numbers(_shaped(x)).cast("int") + q.has_structure(_shaped(x)).cast("int"), "CASE event_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 3 END")
_case("op_q20_check_answer", ("", None, " apples"), _graded(q.check_answer), _EVEN)
_case("op_q21_attempts", ("the result is \\boxed{it is: ", None, "}"), _graded(q.check_attempts), _EVEN)
_case("op_q22_grade", ("(b) ", None), in_python(lambda x: q.udf(lambda t, p: q.grade(t, p, ["1", "zz", "3"]), "boolean")(F.when(F.col("event_id") % 2 == 0, "zz").otherwise("3"), x)), _EVEN)
_case("op_q23_grade_any", _NUM, in_python(lambda x: q.udf(lambda p, w: q.grade_any(["-1", w + ".0"], p), "boolean")(x, _wanted())), _EVEN)
_case("op_q24_multi_choice", ("", None), lambda x: q.is_multi_choice(F.when(F.col("event_id") % 3 == 0, "ACE").when(F.col("event_id") % 3 == 1, "AF").otherwise(x)), "event_id % 3 = 0")
_case("op_q25_single_dollar", ("$", None, "$"), q.single_dollar, _ID)
_case("op_q26_is_float", ("", None, "e3"), lambda x: q.is_float(F.when(F.col("event_id") % 2 == 0, x).otherwise(F.concat(x, F.lit("x")))), _EVEN)
_case("op_q27_extract_and_check", ("so \\boxed{", None, "}"), _graded(q.extract_and_check), _EVEN)
_case("op_q28_accuracy_reward", ("so \\boxed{", None, "}"), in_python(lambda x: q.udf(lambda p: float(q.extract_and_check(p, "7")), "double")(x)), "CASE WHEN event_id IN (7, 700) THEN 1e0 ELSE 0e0 END")


# formulas: a square written out, with one more in the middle term for odd events; an equation turned round

@query("op_q11_symbolic", "SELECT event_id, event_id % 2 = 0 AS equal FROM events")
def q11(spark, d):
    middle = F.when(F.col("event_id") % 2 == 0, 2 * F.col("event_id")).otherwise(2 * F.col("event_id") + 1)
    squared = F.concat(F.lit("x^2 + "), middle.cast("string"), F.lit(" x + "), (F.col("event_id") * F.col("event_id")).cast("string"))
    return spread(_e(spark, d).select("event_id")).select("event_id", q.udf(q.math_equal, "boolean")(F.concat(F.lit("(x + "), F.col("event_id").cast("string"), F.lit(")^2")), squared).alias("equal"))


@query("op_q19_symbolic_check", "SELECT event_id, event_id % 3 <> 2 AS equal FROM events")
def q19(spark, d):
    n, k = (F.col("event_id") + 1).cast("string"), F.col("event_id") % 3
    pred = F.when(k == 0, F.concat(F.lit("\\frac{2y}{4} + \\sqrt{"), n, F.lit("}"))).when(k == 1, F.concat(F.lit("\\frac{y + "), n, F.lit("}{2}"))).otherwise(F.concat(F.lit("y + "), n))
    truth = F.when(k == 0, F.concat(F.lit("y/2 + "), n, F.lit("/\\sqrt{"), n, F.lit("}"))).when(k == 1, F.concat(F.lit("0.5(y + "), n, F.lit(")"))).otherwise(F.concat(F.lit("y - "), n))
    return spread(_e(spark, d).select("event_id")).select("event_id", F.coalesce(q.udf(q.number_check, "boolean")(pred, truth), F.lit(False)).alias("equal"))
