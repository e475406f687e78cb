"""Queries of array, span and text functions (G, S, W10 to W16, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.functions import arrays as g
from sluice.functions import masks
from sluice.functions import text as t
from sluice.session import spread, table

_KINDS = ("view", "click", "signup", "purchase", "error")
_CODE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_KINDS)) + " END"
_IDS = f"(SELECT user_id, list({_CODE} ORDER BY event_id) AS ids FROM events GROUP BY 1)"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    code = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("event_type")) - 1
    rows = table(spark, d, "events").select("user_id", F.struct("event_id", code.alias("id")).alias("x"))
    return rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]).alias("ids"))


_FIRST = "coalesce(list_filter(range(0, len(ids) - 1), lambda i: ids[i + 1:i + 2] = [1, 2])[1], -1)"


@query("op_g01_find_subsequence", f"SELECT user_id, {_FIRST} AS at, coalesce(list_filter(range(2, len(ids) - 1), lambda i: ids[i + 1:i + 2] = [3, 0] OR ids[i + 1:i + 1] = [4])[1], -1) AS any_at FROM {_IDS}")
def g01(spark, d):
    ids = F.col("ids")
    return _ids(spark, d).select("user_id", g.find_subsequence(ids, [1, 2]).alias("at"), g.find_subsequence(ids, [[3, 0], [4]], 2).alias("any_at"))


@query("op_g02_find_all", f"SELECT user_id, CASE WHEN p0 < 0 THEN [] ELSE list_filter(range(p0 + 1, len(ids)), lambda i: ids[i + 1] = 4) END AS places FROM (SELECT *, {_FIRST} AS p0 FROM {_IDS})")
def g02(spark, d):
    return _ids(spark, d).select("user_id", g.find_all(F.col("ids"), [1, 2], [4]).alias("places"))


@query("op_g03_labels", f"SELECT user_id, list_transform(ids, lambda x, i: CASE WHEN p0 < 0 OR i - 1 < p0 + 2 OR x = 4 THEN -100 ELSE x END) AS labels FROM (SELECT *, {_FIRST} AS p0 FROM {_IDS})")
def g03(spark, d):
    return _ids(spark, d).select("user_id", g.labels_after(F.col("ids"), [1, 2], [4]).alias("labels"))


@query("op_g04_labels_allowed", f"SELECT user_id, list_transform(ids, lambda x, i: CASE WHEN p0 < 0 OR i - 1 < p0 + 2 OR (i - 1) % 2 <> 0 THEN -100 ELSE x END) AS labels FROM (SELECT *, {_FIRST} AS p0 FROM {_IDS})")
def g04(spark, d):
    allowed = F.filter(F.transform("ids", lambda x, i: i), lambda i: i % 2 == 0)
    return _ids(spark, d).select("user_id", g.labels_at(F.col("ids"), [1, 2], allowed).alias("labels"))


def _between(name: str, skip: int) -> None:
    # spans differ by the user; the second one is empty, or has nothing left behind the skipped place, for some
    begins, ends = "[1 + user_id % 2, 5, 9 + user_id % 4]", "[3, 6 - user_id % 2, 12 + user_id % 3]"
    sql = f"SELECT user_id, flatten(list_transform(list_zip({begins}, {ends}), lambda p: range(p[1] + {skip}, p[2]))) AS places FROM {_IDS}"

    @query(name, sql)
    def between(spark, d):
        u = lambda k: (F.col("user_id") % k).cast("int")
        starts, ends = F.array(1 + u(2), F.lit(5), 9 + u(4)), F.array(F.lit(3), 6 - u(2), 12 + u(3))
        return _ids(spark, d).select("user_id", g.positions_between(starts, ends, skip).alias("places"))


_between("op_g05_observation_stage1", 0)
_between("op_g06_observation_stage2", 0)
_between("op_g07_observation_stage3", 1)

_SPANS = "(SELECT l_orderkey AS k, CAST(l_partkey % 50 AS BIGINT) AS s, CAST(l_partkey % 50 + l_linenumber AS BIGINT) AS e FROM lineitem)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + F.col("l_linenumber")).alias("end"))


@query("op_g13_merge_spans", f"""WITH p AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_SPANS}),
 i AS (SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM p)
 SELECT k, min(s) AS start, max(e) AS "end" FROM i GROUP BY k, island""")
def g13(spark, d):
    return g.merge_spans(_spans(spark, d), "k")


@query("op_j12_overlap_join", f'SELECT a.k, a.s AS start, a.e AS "end", b.other, b.other_end FROM {_SPANS} a JOIN (SELECT user_id AS k, event_id % 60 AS other, event_id % 60 + 3 AS other_end FROM events) b ON a.k = b.k AND a.s < b.other_end AND b.other < a.e')
def j12(spark, d):
    other = table(spark, d, "events").select(F.col("user_id").alias("k"), (F.col("event_id") % 60).alias("other"), (F.col("event_id") % 60 + 3).alias("other_end"))
    return g.overlap_join(_spans(spark, d), other, "k")


@query("op_j12_overlap_long_spans", """WITH a AS (SELECT c_nationkey AS k, c_custkey AS id, CAST(c_custkey * 1000003 % 5000000 AS BIGINT) - 2500000 AS s, CASE c_custkey % 3 WHEN 0 THEN 3000000000 WHEN 1 THEN c_custkey ELSE 100000 END AS n FROM customer),
 b AS (SELECT s_nationkey AS k, s_suppkey AS place, CAST(s_suppkey * 700001 % 6000000 AS BIGINT) - 3000000 AS s, CASE s_suppkey % 2 WHEN 0 THEN 1 ELSE 500000 END AS n FROM supplier)
 SELECT a.k, a.id, b.place FROM a JOIN b ON a.k = b.k AND a.s < b.s + b.n AND b.s < a.s + a.n""")
def j12_long(spark, d):
    # spans from one place to three thousand million, on both sides of zero
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    n = F.when(F.col("c_custkey") % 3 == 0, F.lit(3_000_000_000)).when(F.col("c_custkey") % 3 == 1, F.col("c_custkey")).otherwise(100_000)
    a = c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), (F.col("c_custkey") * 1000003 % 5000000 - 2500000).cast("long").alias("start"), n.cast("long").alias("n"))
    m = F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(500_000)
    b = s.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("place"), (F.col("s_suppkey") * 700001 % 6000000 - 3000000).cast("long").alias("other"), m.cast("long").alias("m"))
    met = g.overlap_join(a.withColumn("end", F.col("start") + F.col("n")), b.withColumn("other_end", F.col("other") + F.col("m")), "k")
    return met.select("k", "id", "place")


#: Each user's events as tokens: the first five are a question, then steps of eight tokens, in which the sign-ups of each half are a block.
_TOKENS = """r AS (SELECT user_id AS row_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
 t AS (SELECT row_id, pos, event_type <> 'error' AS valid, CASE WHEN pos < 5 THEN NULL ELSE (pos - 5) // 8 END AS step, CASE WHEN pos < 5 THEN NULL ELSE (pos - 5) // 4 END AS block,
  CASE WHEN pos IN (0, 2) THEN 'question_edge' WHEN pos = 1 THEN 'question_image' WHEN pos < 5 THEN 'question' WHEN event_type = 'view' THEN 'image' WHEN event_type = 'click' THEN 'latent'
  WHEN event_type = 'signup' THEN 'observation' ELSE 'text' END AS kind FROM r),
 s AS (SELECT row_id, step, min(pos) AS head FROM t WHERE kind = 'latent' GROUP BY 1, 2),
 o AS (SELECT row_id, block, min(pos) AS opens FROM t WHERE step IS NOT NULL GROUP BY 1, 2),
 f AS (SELECT t.*, s.head, o.opens FROM t LEFT JOIN s ON t.row_id = s.row_id AND t.step = s.step LEFT JOIN o ON t.row_id = o.row_id AND t.block = o.block)"""


def _tokens(spark, d):
    pos, kind = F.col("pos"), F.col("event_type")
    rows = table(spark, d, "events").select(F.col("user_id").alias("row_id"), "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("pos"))
    named = F.when(pos.isin(0, 2), "question_edge").when(pos == 1, "question_image").when(pos < 5, "question").when(kind == "view", "image").when(kind == "click", "latent").when(kind == "signup", "observation").otherwise("text")
    part = lambda n: F.when(pos >= 5, F.floor((pos - 5) / n))
    return rows.select("row_id", "pos", (kind != "error").alias("valid"), named.alias("kind"), part(8).alias("step"), part(4).alias("block"))


#: The pairs of a mask as ranges of keys for each token.
_AS_RANGES = """SELECT f.row_id, f.pos AS q, coalesce(n, 0) AS n_keys, coalesce(ranges, '') AS ranges FROM f LEFT JOIN
 (SELECT row_id, q, CAST(sum(size) AS BIGINT) AS n, string_agg(begins || '-' || ends, ',' ORDER BY begins) AS ranges FROM
  (SELECT row_id, q, min(k) AS begins, max(k) + 1 AS ends, count(*) AS size FROM (SELECT *, k - row_number() OVER (PARTITION BY row_id, q ORDER BY k) AS island FROM p WHERE allowed) GROUP BY row_id, q, island) GROUP BY row_id, q) x
 ON x.row_id = f.row_id AND x.q = f.pos"""


def _range_rows(found: DataFrame) -> DataFrame:
    """Ranges as text, with the number of keys."""
    text = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"], r["end"])), ",")
    n = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select("row_id", "q", n.alias("n_keys"), text.alias("ranges"))


def _visibility(name: str, sql: str, **options) -> None:
    text = f"""WITH {_TOKENS}, p AS (SELECT q.row_id, q.pos AS q, k.pos AS k, q.kind AS qk, k.kind AS kk, q.head AS qh, k.head AS kh, q.opens, coalesce(q.step = k.step, false) AS own, coalesce(q.block = k.block, false) AS mate,
      k.pos <= q.pos AS past, k.pos <= q.pos AND q.valid AND k.valid AS base FROM f q JOIN f k USING (row_id))
     SELECT row_id, q, k, coalesce({sql}, false) AS allowed FROM p"""

    @query(name, text)
    def visibility(spark, d):
        return g.visible_pairs(_tokens(spark, d), **options)

    ranges = text.replace(", p AS (", ", pairs AS (").replace("SELECT row_id, q, k, coalesce", ", p AS (SELECT row_id, q, k, coalesce").replace("FROM p", "FROM pairs)")

    @query(f"{name}_ranges", ranges + _AS_RANGES)
    def visibility_ranges(spark, d):
        return _range_rows(masks.visible_ranges(_tokens(spark, d), **options))


_SHOWN = "base AND NOT (kk = 'image' AND kh IS NOT NULL)"
_visibility("op_g11_visibility", f"CASE WHEN qk = 'latent' AND own AND kk = 'image' THEN true WHEN (qk = 'latent' AND own AND kk = 'latent') OR (qk = 'observation' AND qh IS NOT NULL AND kk = 'observation' AND mate) THEN past ELSE {_SHOWN} END")
_visibility(
    "op_g11_hidden_latents", f"CASE WHEN qk = 'latent' AND own AND kk = 'image' THEN true WHEN qk = 'latent' AND kk = 'question_image' THEN true WHEN kk = 'latent' AND q > kh THEN false WHEN qk = 'latent' AND own AND kk = 'latent' THEN past"
    f" WHEN qk = 'observation' AND qh IS NOT NULL AND kk = 'observation' AND mate THEN past WHEN kk = 'question_image' THEN false ELSE {_SHOWN} END", hide_latents=True, hide_question_image=True,
)
_visibility(
    "op_g11_question_and_latents", "CASE WHEN qk = 'latent' THEN own AND (kk = 'image' OR (kk = 'latent' AND past)) WHEN qk = 'observation' AND qh IS NOT NULL THEN (kk = 'observation' AND mate AND past) OR (kk <> 'observation' AND (kk = 'question' OR (kk = 'latent' AND k < opens)))"
    f" ELSE {_SHOWN} END", latents_see_all=False, observations_see="question_and_latents",
)
_visibility(
    "op_g11_observations_see_latents", "CASE WHEN qk = 'latent' AND own AND kk IN ('image', 'latent') THEN kk = 'image' OR past WHEN qk = 'observation' AND qh IS NOT NULL THEN own AND ((kk = 'observation' AND mate AND past) OR kk = 'latent') ELSE base END",
    keep_images=True, observations_see="latents",
)
_visibility(
    "op_g11_no_question_image", f"CASE WHEN qk = 'latent' AND own AND kk IN ('image', 'latent') THEN kk = 'image' OR past WHEN qk = 'observation' AND qh IS NOT NULL THEN CASE WHEN kk = 'observation' AND mate THEN past WHEN kk IN ('question_image', 'question_edge') THEN false ELSE {_SHOWN} END ELSE {_SHOWN} END",
    observations_skip_question_image=True,
)


_WITHOUT_IMAGES = "SELECT q.row_id, q.pos AS q, k.pos AS k, k.pos <= q.pos AND q.valid AND k.valid AND NOT (k.kind = 'latent' AND q.pos >= coalesce(k.head, 0)) AS allowed FROM f q JOIN f k USING (row_id)"


@query("op_g12_visibility_without_images", f"WITH {_TOKENS} {_WITHOUT_IMAGES}")
def g12(spark, d):
    return g.visible_pairs_without_images(_tokens(spark, d), hide_latents=True)


@query("op_g12_ranges_without_images", f"WITH {_TOKENS}, p AS ({_WITHOUT_IMAGES}) {_AS_RANGES}")
def g12_ranges(spark, d):
    return _range_rows(masks.visible_ranges_without_images(_tokens(spark, d), hide_latents=True))


@query("op_g15_steps", "SELECT event_id, ['first ' || event_id, 'then b', 'end'] AS steps FROM events")
def g15(spark, d):
    text = F.concat(F.lit("first "), F.col("event_id").cast("string"), F.lit(" ### Step 2: then b### Step 3.1: end\n"))
    return table(spark, d, "events").select("event_id", t.steps(text, "### Step").alias("steps"))


def _padded(name: str, sql: str, make) -> None:
    @query(name, f"SELECT user_id, {sql} AS ids FROM {_IDS}")
    def padded(spark, d):
        return _ids(spark, d).select("user_id", make(F.col("ids")).alias("ids"))


_padded("op_g16_pad_ragged", "list_concat(ids, list_transform(range(greatest(0, 80 - len(ids))), lambda i: 9))[1:80]", lambda x: g.pad_and_clip(x, 80, 9))
_padded("op_g17_pad_and_clip", "list_concat(ids, list_transform(range(greatest(0, 5 - len(ids))), lambda i: 9))[1:5]", lambda x: g.pad_and_clip(x, 5, 9))
_padded("op_g18_pad_left", "list_concat(list_transform(range(greatest(0, 70 - len(ids))), lambda i: 9), ids)", lambda x: g.pad_to(x, 70, 9, left=True))
_padded("op_g19_fit", "CASE WHEN len(ids) < 6 THEN list_concat(list_transform(range(6 - len(ids)), lambda i: 9), ids) ELSE ids[len(ids) - 5:len(ids)] END", lambda x: g.fit(x, 6, 9, True, "left"))
_padded("op_g20_truncate", "ids[1:4]", lambda x: g.truncate(x, 4, "right"))
_padded("op_g22_slices", "ids[4:len(ids)]", lambda x: F.slice(x, F.lit(4), F.greatest(F.lit(0), F.size(x) - 3)))
_padded("op_w10_eos_mask", "list_transform(ids, lambda x, i: CASE WHEN coalesce(list_position(ids, 3), 0) = 0 OR i - 1 < list_position(ids, 3) THEN 1 ELSE 0 END)", lambda x: g.eos_mask(x, 3))
_padded("op_w11_pad_mask", "list_transform(ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)", lambda x: g.pad_mask(x, 0))
_padded("op_w13_response_positions", "list_concat(ids, list_transform(range(1, 5), lambda k: ids[len(ids)] + k))", lambda x: g.response_positions(x, F.lit(4)))
_padded("op_g21_reward_at_end", "list_transform(range(len(ids)), lambda i: CASE WHEN i = len(ids) - 2 THEN 0.5e0 ELSE 0e0 END)", lambda x: g.place_reward(F.lit(0.5), F.size(x) - 1, F.size(x)))
_padded("op_g21_step_rewards", "list_transform(range(len(ids)), lambda i: CASE WHEN i = 0 THEN 0.25e0 WHEN i = 2 THEN 0.5e0 ELSE 0e0 END)", lambda x: g.place_rewards(F.array(F.lit(0.25), F.lit(0.5)), F.array(F.lit(0), F.lit(2)), F.size(x)))
_padded("op_c32_shifted_mask", "list_transform(list_zip(ids, list_transform(ids, lambda x: CASE WHEN x <> 4 THEN 1 ELSE 0 END)), lambda p: p[1] * p[2])", lambda x: F.zip_with(x, F.transform(x, lambda v: (v != 4).cast("long")), lambda a, b: a * b))


@query("op_w12_positions", "SELECT event_id, greatest(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1, 0) AS pos FROM events")
def w12(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("event_type") != "error").cast("int").alias("m"))
    return g.cumulative_positions(e, "user_id", "event_id", "m", "pos").select("event_id", "pos")


@query("op_w14_packed_index", "SELECT event_id, packed FROM (SELECT event_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS packed FROM events) WHERE event_type = 'purchase'")
def w14(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").withColumn("packed", F.sum((F.col("event_type") != "error").cast("int")).over(w) - 1)
    return e.filter("event_type = 'purchase'").select("event_id", "packed")


@query("op_w16_next_token", "SELECT event_id, coalesce(lead(event_type) OVER w, first_value(event_type) OVER w) AS label FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def w16(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.coalesce(F.lead("event_type").over(w), F.first("event_type").over(w)).alias("label"))


@query("op_g23_annotated_path", "SELECT event_id, tag = '0' OR len(list_filter(string_split(tag, '.')[2:10], lambda x: x <> '1')) = 0 AS ok FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '0' ELSE '0.1.' || (event_id % 3) END AS tag FROM events)")
def g23(spark, d):
    tag = F.when(F.col("event_id") % 5 == 0, "0").otherwise(F.concat(F.lit("0.1."), (F.col("event_id") % 3).cast("string")))
    return table(spark, d, "events").select("event_id", g.on_annotated_path(tag).alias("ok"))


@query("op_g24_truncate_words", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:12], ' ') AS head FROM documents")
def g24(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " ", -1), 1, 12), " ").alias("head"))


# text: (name, input built from a row in Spark and in SQL, function, SQL over x)




def _text(name: str, make, sql_text: str, f, sql: str) -> None:
    """A query over a text made from each event: ``make`` and ``sql_text`` make it, ``f`` and ``sql`` are compared."""

    @query(name, f"SELECT event_id, {sql} AS y FROM (SELECT event_id, event_type, {sql_text} AS x FROM events)")
    def over_events(spark, d):
        rows = table(spark, d, "events").select("event_id")
        return (spread(rows) if getattr(f, "in_python", False) else rows).select("event_id", f(make()).alias("y"))


def in_python(f):
    """Marks a function whose column is made in Python, so that its rows are spread over all cores."""
    f.in_python = True
    return f


def _lit(*parts):
    """A column from text pieces, where None stands for the event's id."""
    return F.concat(*(F.col("event_id").cast("string") if p is None else F.lit(p) for p in parts))


def _sql(*parts: str | None) -> str:
    return " || ".join("CAST(event_id AS VARCHAR)" if p is None else "'" + p.replace("'", "''") + "'" for p in parts)


def _case(name: str, parts: tuple, f, sql: str) -> None:
    _text(name, lambda: _lit(*parts), _sql(*parts), f, sql)


def _forms(name: str, forms: list[tuple], f, sql: str | list[str]) -> None:
    """Like ``_case`` over several forms of text, dealt by the event's id; ``sql`` is over x, or states each form's result."""
    pick = lambda texts: "CASE event_id % {} {} END".format(len(forms), " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(texts)))

    def made():
        out = _lit(*forms[0])
        for k, parts in enumerate(forms[1:], 1):
            out = F.when(F.col("event_id") % len(forms) == k, _lit(*parts)).otherwise(out)
        return out

    _text(name, made, pick([_sql(*p) for p in forms]), f, sql if isinstance(sql, str) else pick(sql))


_A = ("a <abs_vis_token>one\n", None, "</abs_vis_token> b <abs_vis_token></abs_vis_token>")
#: Latents with content and without, none, one that does not close, a close alone, and one inside another.
_LATENTS = [_A, ("plain ", None), ("<abs_vis_token>open ", None), ("x</abs_vis_token> ", None, " <abs_vis_token>y</abs_vis_token>"), ("<abs_vis_token>a<abs_vis_token>", None, "</abs_vis_token>b</abs_vis_token>")]
for _name in ("op_s01_latent_placeholder", "op_s02_latent_placeholder_reward", "op_s03_latent_placeholder_inference"):
    _forms(_name, _LATENTS, t.latent_placeholder, r"regexp_replace(x, '(<abs_vis_token>)(.*?)(</abs_vis_token>)', '\1<latent>\3', 'gs')")
_Q = ("q <abs_vis_token></abs_vis_token> <|vision_start|><|image_pad|><|vision_end|>", None)
_case("op_s05_question_images", _Q, t.question_images, "CASE WHEN contains(x, '<abs_vis_token></abs_vis_token>') THEN replace(replace(x, '<|vision_start|><|image_pad|><|vision_end|>', ''), '<abs_vis_token></abs_vis_token>', '<|vision_start|><|image_pad|><|vision_end|>') ELSE x END")
_T = ("q <|vision_start|><|image_pad|><|vision_end|>", None, "<|im_start|>assistant z<|vision_start|><|image_pad|><|vision_end|> <abs_vis_token></abs_vis_token>y")
_T2 = ("q <|vision_start|><|image_pad|><|vision_end|>", None, "<|im_start|>assistant z<|vision_start|><|image_pad|><|vision_end|> y")
_HEAD = "string_split(x, '<|im_start|>assistant')[1] || '<|im_start|>assistant' || "
_IMG = "'<|vision_start|><|image_pad|><|vision_end|>'"
_case("op_s04_placeholders_to_images", _T, t.placeholders_to_images, _HEAD + f"replace(replace(string_split(x, '<|im_start|>assistant')[2], {_IMG}, ''), '<abs_vis_token></abs_vis_token>', {_IMG})")
_case("op_s06_images_to_latents", _T2, lambda x: t.images_to_latents(x, 3), _HEAD + f"replace(string_split(x, '<|im_start|>assistant')[2], {_IMG}, '<abs_vis_token>' || repeat('<abs_vis_token_pad>', 3) || '</abs_vis_token>')")
_case("op_s07_latents_after_images", _T2, lambda x: t.latents_after_images(x, 2), _HEAD + f"replace(string_split(x, '<|im_start|>assistant')[2], {_IMG}, {_IMG} || '<abs_vis_token>' || repeat('<abs_vis_token_pad>', 2) || '</abs_vis_token>')")
_forms("op_s08_count_markers", _LATENTS, lambda x: t.occurrences(x, t.LATENT_OPEN), "(length(x) - length(replace(x, '<abs_vis_token>', ''))) // 15")
_forms("op_s10_boxed_format", [("so \\boxed{", None, "}"), ("so boxed{", None, "}"), ("\\boxed{", None), ("\\boxed{\n", None, "\n} }"), ("\\boxed ", None, "{}")], t.boxed_format, r"CASE WHEN regexp_matches(x, '\\boxed\{.*?\}', 's') THEN 1e0 ELSE 0e0 END")
_forms("op_s11_latent_use", _LATENTS, t.uses_latent, "CASE WHEN contains(x, '<abs_vis_token>') THEN 1e0 ELSE 0e0 END")
_forms(
    "op_s12_think_format", [("<think>\n", None, "</think>\n<answer>x</answer>"), ("<think>", None, "</think> so <answer>x</answer>"), ("<answer>", None, "</answer>"), ("<think>a</think><answer>", None, "</answer>"), ("<think>a</think><answer>", None, "</answer>."), (" <think></think><answer>", None, "</answer>")],
     t.think_format, r"CASE WHEN regexp_full_match(x, '<think>.*</think>\s*<answer>.*</answer>', 's') THEN 1e0 ELSE 0e0 END")
_case("op_s19_after_is", ("This is it: the answer is ", None, "</answer> ok"), t.last_number_before_close, "regexp_extract(x, '(?is)^.*is(.*?)</answer>', 1)")
_forms("op_s22_angle_brackets", [("a <b", None, "> c <d> e"), (" no ", None, " marks "), ("x <a <b> ", None, " c> y"), ("5 < ", None, " only"), ("<", None, "> > <")], t.without_angles, "trim(regexp_replace(regexp_replace(x, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'))")
_case("op_s28_comma_list", ("1,", None), t.comma_list, "CASE WHEN contains(x, ',') THEN ['{' || x || '}'] ELSE [] END")
_case("op_s31_trim_answer", (" \n", None, ". .\n"), t.trim_answer, r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^[ \n]+|[ \n]+$', '', 'g'), '\.+$', ''), '^[ \n]+|[ \n]+$', '', 'g'), '\.+$', '')")
_case("op_s32_symbols", ("\\$", None, "\\% {,} 90^\\circ π A°"), t.normalise_symbols, "lower(replace(replace(replace(replace(replace(replace(x, '\\$', ''), '$', ''), '\\%', ''), '^\\circ', ''), '{,}', ''), 'π', '\\pi'))[1:-2]")
_case("op_s33_right_side", ("x = ", None), t.right_side, "CASE WHEN len(string_split(x, '=')) = 2 THEN string_split(x, '=')[CASE WHEN trim(string_split(x, '=')[2]) = '0' AND length(trim(string_split(x, '=')[1])) >= 2 THEN 1 ELSE 2 END] ELSE x END")
_case("op_s34_roots", ("√{", None, "} + √(2)"), t.plain_roots, r"regexp_replace(regexp_replace(x, '√\{([^{}]*)\}', '\\sqrt{\1}', 'g'), '√\(([^()]*)\)', '\\sqrt{\1}', 'g')")
_case("op_s35_boxed_hint", ("What is ", None, "?\nPut your final answer within \\boxed{}."), t.without_boxed_hint, "'What is ' || CAST(event_id AS VARCHAR) || '?'")
_forms("op_s37_last_choice", [("is it a or B", None, " c or (d)."), ("It is (C), not ", None, "."), ("none of ", None, ". "), ("B", None, "... "), ("x e", None, " A")], t.last_choice, ["'D'", "'C'", "'none of ' || event_id", "'B' || event_id", "'A'"])
_forms("op_s38_triggered_choice", [("A? the choice is ", None, " (b) not c"), ("answer is a, no, the choice is D ", None, " e"), ("maybe B or C ", None), ("the answer is ", None, "./"), ("f ", None, "/")], t.triggered_choice, ["'B'", "'D'", "'C'", "event_id || '.'", "'f ' || event_id"])
_case("op_s39_only_number", ("about -", None, ".5 m"), t.only_number, "regexp_replace(x, '[^0-9.\\-]', '', 'g')")
_case("op_s40_judge_prompt", ("q", None), lambda x: t.judge_prompt(x, F.lit("p"), F.lit("t")), "'Question: ' || x || chr(10) || 'Predicted Answer: p' || chr(10) || 'Ground Truth Answer: t' || chr(10) || 'Does the predicted answer exactly or semantically match the ground-truth? Reply ''yes'' or ''no''.'")
_case("op_s41_choice_prompt", ("q", None), lambda x: t.choice_prompt(x, F.lit("A. 1 B. 2"), F.lit("B")), "'Question: ' || x || '?' || chr(10) || 'Options: A. 1 B. 2' || chr(10) || 'Answer: B' || chr(10) || 'Your output: '")
_case("op_s42_extract_prompt", ("q", None), lambda x: t.extraction_prompt(F.lit(" examples\n"), x, F.lit("a"), F.lit("r")), "'examples' || chr(10) || chr(10) || '[Question]: ' || x || chr(10) || '[Standard Answer]: a' || chr(10) || '[Model Response]: r' || chr(10) || '[Extracted answer]: '")
_case("op_b50_vision_prompt", ("q", None), lambda x: F.when(~x.contains("<image>"), F.concat(F.lit("<image>\n"), x)).otherwise(x), "'<image>' || chr(10) || x")
_case("op_e08_template", ("  q", None, " "), lambda x: F.concat(F.trim(x), F.lit(t.INSTRUCTION)), "trim(x) || ' You FIRST think about the reasoning process as an internal monologue and then provide the final answer.\\nRemember: 1. Solve the problem step by step.\\n2. You MUST put the final answer in \\boxed{}.'")
_forms("op_e02_function_path", [("dir/f", None, ".py"), ("dir/f.py:run", None), ("f", None, ".py:main"), ("f.py:", None, "_x")], lambda x: F.struct(F.get(F.split(x, ":", -1), F.lit(0)).alias("path"), F.coalesce(F.get(F.split(x, ":", -1), F.lit(1)), F.lit("main")).alias("name"))["name"], ["'main'", "'run' || event_id", "'main'", "event_id || '_x'"])
_case("op_s36_grouped_digits", ("n ", None, "1234567asd"), t.grouped_digits, "'n ' || format('{:,}', CAST(CAST(event_id AS VARCHAR) || '1234567' AS BIGINT)) || 'asd'")
_case("op_s29_thousands", ("1,234,567 and ", None, ",000"), t.without_thousands, "CASE WHEN length(CAST(event_id AS VARCHAR)) <= 9 THEN '1234567 and ' || CAST(event_id AS VARCHAR) || '000' END")
_case("op_s25_numbers", ("a $x", None, "$ then 1/2, 3.5 and 1,000 or 7"), t.all_numbers, "['x' || CAST(event_id AS VARCHAR), '1/2', '3.5', '1000', '7']")
_case("op_s26_intervals", ("in (-1, ", None, "] \\cup (3,4) or [5,6)"), t.intervals, "['(-1, ' || CAST(event_id AS VARCHAR) || '] \\cup (3,4)', '[5,6)']")
_case("op_s23_shortest_tail", ("The answer is: 12 and so the answer is ", None), lambda x: t.shortest_tail(x, ["answer is", "answer is:", "never"]), "' ' || CAST(event_id AS VARCHAR)")


@query("op_s09_tighten", r"SELECT page_id, length(regexp_replace(html, '\s*(<|>|/)\s*', '\1', 'g')) AS n FROM pages")
def s09(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(t.tighten(F.col("html"))).alias("n"))


#: A box after some characters; every third text has none.
_BOXED = r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 1, doc_id % 7 * 40) || CASE WHEN doc_id % 3 = 1 THEN '\boxed{' ELSE '\fbox{' END || substr(text, doc_id % 7 * 40 + 1) END AS x FROM documents WHERE text IS NOT NULL"


@query("op_s16_before_boxed", rf"""WITH b AS ({_BOXED}), p AS (SELECT doc_id, string_split(x, ' ') AS w, CASE WHEN strpos(x, '\boxed') > 0 THEN strpos(x, '\boxed') - 1 WHEN strpos(x, '\fbox') > 0 THEN strpos(x, '\fbox') - 1 END AS place FROM b),
 u AS (SELECT doc_id, place, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM p), c AS (SELECT doc_id, place, n, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM u)
 SELECT doc_id, CASE WHEN any_value(place) IS NOT NULL THEN least(count(*) FILTER (WHERE upto < place), any_value(n) - 1) END AS kept FROM c GROUP BY 1""")
def s16(spark, d):
    cut, third = (F.col("doc_id") % 7 * 40).cast("int"), F.col("doc_id") % 3
    box = F.when(third == 1, F.lit("\\boxed{")).otherwise(F.lit("\\fbox{"))
    text = F.when(third == 0, F.col("text")).otherwise(F.concat(F.substring(F.col("text"), F.lit(1), cut), box, F.substring(F.col("text"), cut + 1, F.length("text"))))
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", text.alias("x"))
    return docs.select("doc_id", F.size(t.before_box(F.col("x"), F.split("x", " ", -1))).cast("long").alias("kept"))


@query("op_b30_render", "SELECT item_id, 2 AS n_parts, trim(text) || ' You FIRST think about the reasoning process as an internal monologue and then provide the final answer.\\nRemember: 1. Solve the problem step by step.\\n2. You MUST put the final answer in \\boxed{}.' AS tail FROM benchmark")
def b30(spark, d):
    parts = t.render_prompt(F.concat(F.lit("<image>"), F.trim("text")))
    return table(spark, d, "benchmark").select("item_id", F.size(parts).alias("n_parts"), F.element_at(parts, -1)["text"].alias("tail"))
