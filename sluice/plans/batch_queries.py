"""Queries of the batch algebra, joins and set operations (B, J, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.operators import batch as b
from sluice.session import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("row_id"), "user_id", "event_type", "value")


def _n(df: DataFrame) -> int:
    return df.count()


@query("op_b03_row_count", "SELECT count(*) AS n FROM events")
def b03(spark, d):
    return _events(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("op_b04_slice", "SELECT (event_id - 10) // 3 AS row_id, user_id FROM events WHERE event_id >= 10 AND event_id < 400 AND (event_id - 10) % 3 = 0")
def b04(spark, d):
    return b.slice_rows(_events(spark, d), 10, 400, 3, n=1000).select("row_id", "user_id")


@query("op_b04_fancy_index", "SELECT i.row_id, e.user_id, e.value FROM (VALUES (0, 7), (1, 7), (2, 3), (3, 999), (4, 0)) i(row_id, source) JOIN events e ON e.event_id = i.source")
def b04_fancy(spark, d):
    return b.take_rows(_events(spark, d), b.index_table(spark, [7, 7, 3, 999, 0])).select("row_id", "user_id", "value")


@query("op_b05_select", "SELECT event_id AS row_id, user_id, event_type FROM events")
def b05(spark, d):
    return b.select_columns(_events(spark, d), ["user_id"], ["event_type", "no_such"])


@query("op_b06_pop", "SELECT event_id AS row_id, value FROM events")
def b06(spark, d):
    return b.pop_columns(_events(spark, d), ["value"])[0]


@query("op_b06_rest", "SELECT event_id AS row_id, user_id, event_type FROM events")
def b06_rest(spark, d):
    return b.pop_columns(_events(spark, d), ["value"])[1]


@query("op_b07_rename", "SELECT event_id AS row_id, user_id AS uid, event_type AS kind, value FROM events")
def b07(spark, d):
    return b.rename_columns(_events(spark, d), ["user_id", "event_type"], ["uid", "kind"])


_UNION = "SELECT e.event_id AS row_id, e.user_id, e.value, f.event_type, e.value * 2 AS twice FROM events e JOIN events f USING (event_id)"


@query("op_b08_union_columns", _UNION)
def b08(spark, d):
    e = _events(spark, d)
    return b.union_columns(e.select("row_id", "user_id", "value"), e.select("row_id", "user_id", "event_type", (F.col("value") * 2).alias("twice")))


@query("op_b09_union_dense", "SELECT event_id AS row_id, value, value AS reward FROM events")
def b09(spark, d):
    e = _events(spark, d).select("row_id", "value")
    return b.union_columns(e, e.withColumn("reward", F.col("value")))


@query("op_b10_union_objects", "SELECT event_id AS row_id, event_type, concat('x', event_type) AS multi_modal_inputs FROM events")
def b10(spark, d):
    e = _events(spark, d).select("row_id", "event_type")
    return b.union_columns(e.withColumn("multi_modal_inputs", F.lit("old")), e.withColumn("multi_modal_inputs", F.concat(F.lit("x"), "event_type")))


@query("op_b12_concat", "SELECT event_id AS row_id, user_id FROM events UNION ALL SELECT event_id + (SELECT count(*) FROM events), user_id FROM events WHERE event_id < 50")
def b12(spark, d):
    e = _events(spark, d).select("row_id", "user_id")
    return b.concat_rows([e, e.filter("row_id < 50")])


@query("op_b13_chunk", "SELECT event_id // ((SELECT count(*) FROM events) // 10) AS chunk, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def b13(spark, d):
    e = _events(spark, d)
    return e.groupBy(b.chunk_ids(_n(e), 10).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("op_b14_split", "SELECT event_id // 50 AS part, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def b14(spark, d):
    e = _events(spark, d)
    return e.groupBy(b.split_ids(_n(e), 50).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))


@query("op_b15_repeat_interleaved", "SELECT event_id * 3 + k AS row_id, user_id FROM events, (SELECT unnest(range(3)) AS k)")
def b15(spark, d):
    return b.repeat_rows(_events(spark, d), 3).select("row_id", "user_id")


@query("op_b16_repeat_tiled", "SELECT k * (SELECT count(*) FROM events) + event_id AS row_id, user_id FROM events, (SELECT unnest(range(3)) AS k)")
def b16(spark, d):
    return b.repeat_rows(_events(spark, d), 3, interleave=False).select("row_id", "user_id")


@query("op_b17_repeat_values", "SELECT event_id * 2 + k AS row_id, value FROM events, (SELECT unnest(range(2)) AS k) WHERE event_type = 'view'")
def b17(spark, d):
    return b.repeat_rows(_events(spark, d).filter("event_type = 'view'"), 2).select("row_id", "value")


_PERM = "(SELECT event_id AS row_id, (event_id * 7 + 3) % (SELECT count(*) FROM events) AS source FROM events)"


def _permutation(e: DataFrame) -> DataFrame:
    return e.select("row_id", ((F.col("row_id") * 7 + 3) % _n(e)).alias("source"))


@query("op_b18_reorder", f"SELECT p.row_id, e.user_id FROM {_PERM} p JOIN events e ON e.event_id = p.source")
def b18(spark, d):
    e = _events(spark, d)
    return b.take_rows(e, _permutation(e)).select("row_id", "user_id")


@query("op_b19_inverse", f"SELECT source AS row_id, row_id AS source FROM {_PERM}")
def b19(spark, d):
    return b.inverse_permutation(_permutation(_events(spark, d)))


_PAD = "WITH n AS (SELECT count(*) AS n FROM events), p AS (SELECT n, (64 - n % 64) % 64 AS pad FROM n)"


@query("op_b20_pad", f"{_PAD} SELECT event_id AS row_id, user_id FROM events UNION ALL SELECT n + event_id, user_id FROM events, p WHERE event_id < pad")
def b20(spark, d):
    return b.pad_to_divisor(_events(spark, d), 64)[0].select("row_id", "user_id")


@query("op_b21_unpad", f"{_PAD} SELECT event_id AS row_id, user_id FROM events, p WHERE event_id < n - 5")
def b21(spark, d):
    e = _events(spark, d)
    return b.unpad(e, _n(e), 5).select("row_id", "user_id")


@query("op_b22_fold", "SELECT event_id // ((SELECT count(*) FROM events) // 20) AS fold, list(value ORDER BY event_id) AS value FROM events GROUP BY 1")
def b22(spark, d):
    e = _events(spark, d)
    return b.fold_rows(e, "value", 20, _n(e))


_COLLATE = "SELECT event_type, list(user_id ORDER BY event_id) AS user_id, list(value ORDER BY event_id) AS value FROM events GROUP BY 1"


@query("op_b23_collate", _COLLATE)
def b23(spark, d):
    return b.collate(_events(spark, d), ["user_id", "value"], "event_type")


@query("op_b24_collate_rows", "SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1")
def b24(spark, d):
    return b.collate(_events(spark, d).withColumn("ids", F.col("row_id")), ["ids"], "user_id")


@query("op_b25_collate_features", "SELECT doc_id % 7 AS batch, list(text ORDER BY doc_id) AS text FROM documents GROUP BY 1")
def b25(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", (F.col("doc_id") % 7).alias("batch"))
    return b.collate(docs, ["text"], "batch")


@query("op_b26_mini_batches", "SELECT e AS epoch, event_id // 20 AS batch, count(*) AS n, sum(event_id) AS ids FROM events, (SELECT unnest(range(2)) AS e) GROUP BY 1, 2")
def b26(spark, d):
    e = _events(spark, d)
    return b.mini_batches(e, 20, 2, _n(e)).groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


@query("op_b26_mini_batches_seeded", "SELECT e AS epoch, b AS batch, 20 AS n FROM (SELECT unnest(range(2)) AS e), (SELECT unnest(range((SELECT count(*) FROM events) // 20)) AS b)")
def b26_seeded(spark, d):
    e = _events(spark, d)
    return b.mini_batches(e, 20, 2, _n(e), seed=42).groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("op_b29_sizes", "SELECT count(*) * 8 AS value_bytes, sum(strlen(event_type)) AS type_bytes FROM events")
def b29(spark, d):
    e = _events(spark, d)
    return e.agg(b.size_of("value", e.schema["value"].dataType).alias("value_bytes"), b.size_of("event_type", e.schema["event_type"].dataType).alias("type_bytes"))


@query("op_b34_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def b34(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(25)


@query("op_b35_head_validation", "SELECT item_id FROM benchmark ORDER BY item_id LIMIT 10")
def b35(spark, d):
    return table(spark, d, "benchmark").select("item_id").orderBy("item_id").limit(10)


@query("op_b36_train_batches", "SELECT event_id // 64 AS batch, count(*) AS n FROM events WHERE event_id < (SELECT count(*) // 64 * 64 FROM events) GROUP BY 1")
def b36(spark, d):
    e = _events(spark, d)
    return b.loader_batches(e, 64, _n(e), True).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("op_b36_validation_batches", "SELECT 0 AS batch, count(*) AS n FROM events")
def b36_validation(spark, d):
    e = _events(spark, d)
    return b.loader_batches(e, -1, _n(e), False).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("op_b45_shards", "SELECT event_id // ((SELECT (count(*) + 7 - 1) // 7 FROM events)) AS shard, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def b45(spark, d):
    e = _events(spark, d)
    return e.groupBy(b.shard_ids(_n(e), 7).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))


@query("op_b52_consistency", "SELECT count(*) AS n, count(*) = count(DISTINCT event_id) AND min(event_id) = 0 AND max(event_id) = count(*) - 1 AS ok FROM events")
def b52(spark, d):
    e = _events(spark, d)
    b.check_ids(e)
    return e.agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("ok"))


@query("op_b53_deferred_chunk", "SELECT event_id AS row_id FROM events WHERE event_id // ((SELECT count(*) FROM events) // 4) = 2")
def b53(spark, d):
    e = _events(spark, d)
    whole = b.concat_rows([e.filter("row_id < 300"), e.filter("row_id >= 300").withColumn("row_id", F.col("row_id") - 300)])
    return whole.filter(b.chunk_ids(_n(e), 4) == 2).select("row_id")


@query("op_b58_post_process", "SELECT event_id * 2 + k AS row_id, event_id AS uid, CAST(abs(value) AS BIGINT) + k AS tokens FROM (SELECT event_id, trunc(value) AS value FROM events), (SELECT unnest(range(2)) AS k)")
def b58(spark, d):
    prompts = _events(spark, d).select("row_id", F.col("row_id").alias("uid"), F.abs(F.col("value").cast("long")).alias("size"))
    rollouts = b.repeat_rows(prompts.select("row_id", "size"), 2).select("row_id", (F.col("size") + F.col("row_id") % 2).alias("tokens"))
    return b.union_columns(b.repeat_rows(prompts.select("row_id", "uid"), 2), rollouts)


@query("op_positions", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM labels")
def positions(spark, d):
    return b.positions(table(spark, d, "labels").select("doc_id"), "doc_id")


@query("op_j01_positional_union", "SELECT e.event_id AS row_id, e.value, l.c FROM events e JOIN (SELECT event_id, user_id * 2 AS c FROM events) l USING (event_id)")
def j01(spark, d):
    e = _events(spark, d)
    return b.union_columns(e.select("row_id", "value"), e.select("row_id", (F.col("user_id") * 2).alias("c")))


@query("op_j02_required_lookup", "SELECT l.doc_id, length(d.text) AS n FROM labels l JOIN documents d USING (doc_id)")
def j02(spark, d):
    text = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    found = table(spark, d, "labels").select("doc_id").join(text, "doc_id", "left")
    return found.withColumn("n", F.when(F.col("n").isNull(), F.raise_error(F.lit("a key has no stored value"))).otherwise(F.col("n")))


@query("op_j03_valid_ids", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j03(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("op_j04_resume", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j04(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("op_j05_reference_length", "WITH r AS (SELECT user_id, min(value) AS ref FROM events WHERE event_type = 'purchase' AND value < 50 GROUP BY 1) SELECT event_id, coalesce(ref, 0) AS ref FROM events LEFT JOIN r USING (user_id)")
def j05(spark, d):
    e = table(spark, d, "events")
    ref = e.filter("event_type = 'purchase' AND value < 50").groupBy("user_id").agg(F.min("value").alias("ref"))
    return e.join(ref, "user_id", "left").select("event_id", F.coalesce("ref", F.lit(0.0)).alias("ref"))


@query("op_j06_group_stats", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 6) AS centred FROM events")
def j06(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "events").select("event_id", F.round(F.col("value") - F.avg("value").over(Window.partitionBy("user_id")), 6).alias("centred"))


@query("op_j07_zip", "SELECT b.item_id AS row_id, b.text AS question, d.text AS pred FROM benchmark b JOIN documents d ON b.item_id = d.doc_id")
def j07(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("question"))
    answers = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("pred"))
    return b.union_columns(items, answers)


@query("op_j08_scatter", "SELECT d.doc_id, coalesce(l.quality, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND NOT n_chars > 500")
def j08(spark, d):
    rule = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("rule"))
    asked = rule.filter("rule = 0").select("doc_id").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").alias("api"))
    return rule.join(asked, "doc_id", "left").select("doc_id", F.coalesce("api", "rule").alias("verdict"))


@query("op_j09_grid", "SELECT u.p * 8 + s AS slot, n FROM (SELECT DISTINCT user_id AS p FROM events) u CROSS JOIN (SELECT unnest(range(8)) AS s) LEFT JOIN (SELECT user_id AS p, event_id % 8 AS s, count(*) AS n FROM events GROUP BY 1, 2) e USING (p, s)")
def j09(spark, d):
    # the eight slots of each user that there is, whatever its number
    events = table(spark, d, "events")
    slots = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col("user_id") * 8 + k)
    grid = events.select("user_id").distinct().select(F.explode(slots).alias("slot"))
    seen = events.groupBy((F.col("user_id") * 8 + F.col("event_id") % 8).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(seen, "slot", "left")


@query("op_j10_by_order", "SELECT o.pos, n FROM (VALUES (0, 5), (1, 99999), (2, 3)) o(pos, user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) USING (user_id)")
def j10(spark, d):
    order = spark.createDataFrame([(0, 5), (1, 99999), (2, 3)], "pos int, user_id long")
    return order.join(table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "left").select("pos", "n")


@query("op_j11_grid_wide", "SELECT user_id, " + ", ".join(f"count(CASE WHEN event_id % 4 = {k} THEN 1 END) AS s{k}" for k in range(4)) + " FROM events GROUP BY 1")
def j11(spark, d):
    e = table(spark, d, "events").withColumn("s", F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")))
    return e.groupBy("user_id").pivot("s", ["s0", "s1", "s2", "s3"]).agg(F.count(F.lit(1))).na.fill(0)


@query("op_u01_union_all", "SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def u01(spark, d):
    return table(spark, d, "documents").select("doc_id").unionByName(table(spark, d, "labels").select("doc_id"))


@query("op_u02_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u02(spark, d):
    return table(spark, d, "documents").select("doc_id").distinct().join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("op_u03_coverage", "SELECT count(*) AS n, count(DISTINCT event_id) = count(*) AS once FROM events")
def u03(spark, d):
    e = table(spark, d, "events").groupBy("event_id").agg(F.count(F.lit(1)).alias("k"))
    return e.agg(F.sum("k").alias("n"), (F.max("k") == 1).alias("once"))


@query("op_u04_intersection", "SELECT DISTINCT lang AS k FROM documents INTERSECT SELECT DISTINCT lang FROM documents WHERE n_chars > 3000")
def u04(spark, d):
    x = table(spark, d, "documents")
    return x.select(F.col("lang").alias("k")).intersect(x.filter("n_chars > 3000").select("lang"))


@query("op_u05_same_totals", "SELECT count(DISTINCT n) = 1 AS same FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)")
def u05(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg((F.count_distinct("n") == 1).alias("same"))
