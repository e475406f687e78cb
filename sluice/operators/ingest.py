"""Reading, filtering and shaping of chat data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import text as t
from sluice.operators.batch import unflatten_dict

CONTENT = "array<struct<type:string,text:string,image:string>>"
#: Parts that a path must have and must not have, and the name they mean; the first rule that fits counts.
DATASETS = (
    (("math3k",), (), "Geometry3K"), (("geometry3k",), (), "Geometry3K"), (("math",), (), "Math3K"),
    (("Thyme-RL",), ("val",), "Thyme-train"), (("Thyme-RL", "val"), (), "Thyme-val"),
)
OPEN, CLOSE = "<observation>", "</observation>"
#: Samples whose questions keep the hint to box the answer.
KEEP_HINT = ("Zebra_CoT_visual_search", "Zebra_CoT_count")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A file, or a folder's own parquet files in the order of their names; ``@split`` after the path is dropped.

    Sub-folders are not read. Listing goes through Hadoop's file system, so any store that Spark reads will do.
    """
    path = path.partition("@")[0]
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isFile():
        return spark.read.parquet(path)
    names = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.isFile() and s.getPath().getName().endswith(".parquet"))
    return spark.read.parquet(*names) if names else spark.read.parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object for each line."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One array of objects for each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_many(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Files by extension (.jsonl, .json, .parquet), with ``source_ord`` in the order given; others are errors."""
    out = None
    for i, p in enumerate(paths):
        if p.endswith(".jsonl"):
            df = read_json_lines(spark, p, schema)
        elif p.endswith(".json"):
            df = read_json_array(spark, p, schema)
        elif p.endswith(".parquet"):
            df = read_parquet(spark, p)
        else:
            raise ValueError(f"no reader for {p}")
        df = df.withColumn("source_ord", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def dataset_name(path: Column) -> Column:
    """The name of the first rule that a path fits; an error if there is none."""
    out = F.raise_error(F.concat(F.lit("no dataset name for "), path)).cast("string")
    for parts, without, name in reversed(DATASETS):
        fits = F.lit(True)
        for p in parts:
            fits = fits & path.contains(p)
        for p in without:
            fits = fits & ~path.contains(p)
        out = F.when(fits, name).otherwise(out)
    return out


def decode_image(data: Column) -> Column:
    """Bytes of a base64 text, with or without a data-URL header or padding."""
    body = F.regexp_replace(data, "^data:[^,]*,", "")
    return F.unbase64(F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "="))


def by_valid_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose position is in an id list; an id beyond the rows is an error."""
    most = df.agg(F.max(key)).first()[0]
    bad = ids.filter((F.col(key) < 0) | (F.col(key) > (most if most is not None else -1))).limit(1).collect()
    if bad:
        raise ValueError(f"id {bad[0][0]} is out of range")
    return df.join(ids.select(key), key, "left_semi")


def write_valid_ids(df: DataFrame, key: str, path: str) -> None:
    """Persist ids as text, one for each line; Spark's committer makes the write atomic."""
    df.select(F.col(key).cast("string")).write.text(path)


def read_valid_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The ids of a list."""
    return spark.read.text(path).select(F.col("value").cast("long").alias(key))


def required(df: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """Left join in which a missing value is an error."""
    found = df.join(stored.select(key, value), key, "left")
    return found.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit("nothing stored for "), F.col(key).cast("string")))).otherwise(F.col(value)))


def representation_key(layer: str, dataset: Column, sample: Column) -> Column:
    """The key under which a representation is stored."""
    return F.concat_ws("_", F.lit(layer), dataset, sample)


def write_keyed(df: DataFrame, path: str, partition: str) -> None:
    """Store keyed rows, a folder for each value of ``partition``."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def valid_prompts(df: DataFrame, images: Column, tokens: Column, most: int) -> DataFrame:
    """Rows with exactly one image and a prompt of at most ``most`` tokens."""
    return df.filter((F.size(images) == 1) & (tokens <= most))


def map_question_form(df: DataFrame) -> DataFrame:
    """question and solution as problem and answer, with an image mark; rows without images become null and go."""
    return df.filter(F.size("images") > 0).select("images", F.concat(F.lit("<image>"), "question").alias("problem"), F.col("solution").alias("answer"))


def word_count(x: Column) -> Column:
    """Tokens of the built-in tokenizer: runs without white space."""
    return F.size(F.regexp_extract_all(x, F.lit("\\S+"), F.lit(0)))


def image_counts(content: Column) -> Column:
    """Images in a turn."""
    return F.size(F.filter(content, lambda c: c["type"] == "image"))


def without_assistant_images(data: Column) -> Column:
    """Turns in which the assistant's images are left out."""
    keep = lambda c: c["type"] != "image"
    return F.transform(data, lambda turn: F.struct(turn["role"].alias("role"), F.when(turn["role"] == "assistant", F.filter(turn["content"], keep)).otherwise(turn["content"]).alias("content")))


def _part(c: Column, text: Column, image: Column) -> Column:
    return F.struct(c["type"].alias("type"), text.alias("text"), image.alias("image"))


def _clean_turn(turn: Column, root: str) -> Column:
    """One turn with image paths below ``root`` and texts as the role asks."""
    role, content = turn["role"], turn["content"]
    hint_stays = F.lit(False)
    for name in KEEP_HINT:
        hint_stays = hint_stays | F.coalesce(F.get(content, F.lit(0))["image"], F.lit("")).contains(name)
    prefix = F.lit(root.rstrip("/") + "/" if root else "")

    def clean(c: Column, j: Column) -> Column:
        seen = F.exists(F.slice(content, F.lit(1), j), lambda x: x["type"] == "image")
        untagged = t.replace_all(c["text"], [(OPEN, ""), (CLOSE, "")])
        said = F.when((role == "assistant") & ~seen & c["text"].contains(OPEN), untagged)
        said = said.when((role == "user") & ~hint_stays, t.replace(c["text"], t.BOXED_HINT, "")).when((role == "system") & (j == 0), "You are a helpful assistant.").otherwise(c["text"])
        return _part(c, F.when(c["type"] == "text", said).otherwise(c["text"]), F.when(c["type"] == "image", F.concat(prefix, c["image"])).otherwise(c["image"]))

    return F.struct(role.alias("role"), F.transform(content, clean).alias("content"))


def _bad_image(turn: Column) -> Column:
    """Whether an assistant's image follows a text without placeholder."""
    content = turn["content"]
    flagged = F.transform(content, lambda c, j: (c["type"] == "image") & (j > 0) & F.coalesce((F.get(content, j - 1)["type"] == "text") & ~F.get(content, j - 1)["text"].contains(t.LATENT), F.lit(False)))
    return (turn["role"] == "assistant") & F.exists(flagged, lambda x: x)


def preprocess_chat(df: DataFrame, root: str = "", allow_no_observation: bool = False) -> DataFrame:
    """Clean ``data`` of chat samples and drop those that break a rule.

    Dropped: an assistant image after a text without placeholder; other numbers of assistant images than of
    placeholders; no observation, unless allowed. Observation tags before any image of their turn are removed.
    """
    turns = F.filter("data", lambda x: x["role"] == "assistant")
    images = F.aggregate(F.transform(turns, lambda x: image_counts(x["content"])), F.lit(0), lambda a, x: a + x)
    texts = F.flatten(F.transform(turns, lambda x: F.transform(F.filter(x["content"], lambda c: c["type"] == "text"), lambda c: c["text"])))
    marks = F.aggregate(F.transform(texts, lambda x: t.occurrences(x, t.LATENT)), F.lit(0), lambda a, x: a + x)
    kept = df.filter(~F.exists("data", _bad_image)).filter(images == marks)
    out = kept.withColumn("data", F.transform("data", lambda x: _clean_turn(x, root)))
    seen = F.exists("data", lambda x: (x["role"] == "assistant") & F.exists(x["content"], lambda c: F.coalesce(c["text"].contains(OPEN), F.lit(False))))
    return out if allow_no_observation else out.filter(seen)


def preprocess_questions(df: DataFrame, root: str = "") -> DataFrame:
    """The first two turns, under the same rules for images; observation tags before an image drop the sample."""
    first = df.withColumn("data", F.slice("data", 1, 2))
    kept = first.filter(~F.exists("data", _bad_image))
    early = lambda turn: (turn["role"] == "assistant") & F.exists(F.transform(turn["content"], lambda c, j: F.coalesce(c["text"].contains(OPEN), F.lit(False)) & ~F.exists(F.slice(turn["content"], F.lit(1), j), lambda x: x["type"] == "image")), lambda x: x)
    return kept.filter(~F.exists("data", early)).withColumn("data", F.transform("data", lambda x: _clean_turn(x, root)))


#: Preprocessing by task. The names.
TASKS = {"mm-reasoning": preprocess_chat}


def preprocess(task: str, df: DataFrame, **options) -> DataFrame:
    """The samples as a task's preprocessing makes them; an unknown task is an error."""
    if task not in TASKS:
        raise KeyError(f"no such task: {task}")
    return TASKS[task](df, **options)


def save_position(spark: SparkSession, path: str, step: int, read: int) -> None:
    """Keep how many rows a loader has read by a step, in the folder of that step."""
    spark.createDataFrame([(step, read)], "step long, read long").coalesce(1).write.mode("overwrite").parquet(f"{path}/global_step_{step}")


def resumed(spark: SparkSession, df: DataFrame, position: str, path: str, step: int) -> DataFrame:
    """The rows that a loader has still to read when it goes on from a step; all of them if that step kept no position."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/global_step_{step}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return df
    return df.filter(F.col(position) >= spark.read.parquet(folder.toString()).first().read)


def seeded_place(key: Column, seed: int) -> Column:
    """A text by which rows are in a pseudo-random order that a seed fixes, the same in any system."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def seeded_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in a fixed pseudo-random order of their keys."""
    return df.orderBy(seeded_place(F.col(key), seed), key)


def sampled_order(df: DataFrame, key: str, seed: int, shuffle: bool) -> DataFrame:
    """The order in which a loader reads rows: by a seed, or that of their keys."""
    return seeded_order(df, key, seed) if shuffle else df.orderBy(key)


def seeded_pick(members: Column, key: Column, seed: int) -> Column:
    """One member of a list by a hash of the row's key."""
    number = F.conv(F.substring(seeded_place(key, seed), 1, 8), 16, 10).cast("long")
    return F.get(members, (number % F.greatest(F.size(members), F.lit(1))).cast("int"))


def flatten_struct(df: DataFrame, column: str, sep: str) -> DataFrame:
    """A struct column replaced by its leaves, named by their paths."""

    def leaves(kind: T.DataType, path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from leaves(f.dataType, (*path, f.name))
        else:
            yield path

    found = [reduce(lambda c, name: c.getField(name), path, F.col(column)).alias(sep.join(path)) for path in leaves(df.schema[column].dataType, ())]
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != column), *found)


def unflatten_struct(df: DataFrame, column: str, sep: str, keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """Columns named by paths put into one struct column; those in ``keep`` stay."""
    tree = unflatten_dict({c: F.col(f"`{c}`") for c in df.columns if c not in keep}, sep)
    build = lambda t: F.struct(*((build(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c in keep), build(tree).alias(column))


#: Columns that every generation batch takes, and further ones of batches with images by (strategy, mode).
DENSE, PROMPT, IMAGES = ("input_ids", "attention_mask", "position_ids"), ("raw_prompt_ids",), ("multi_modal_data",)
FURTHER = {
    ("greedy", None): (),
    ("greedy", "train_pre_gen"): ("global_index",),
    ("greedy", "train_rl_gen"): ("problem", "ground_truth", "prompt_before_processor", "global_index", "correct_solutions_text"),
    ("latent", None): ("global_index", "problem", "ground_truth"),
}


def generation_columns(columns: Sequence[str], strategy: str, mode: str | None) -> list[str]:
    """Which columns of a batch go into generation: by what the batch has, the sampling strategy and the mode."""
    if IMAGES[0] not in columns:
        return [*DENSE, *PROMPT]
    rule = FURTHER.get((strategy, mode), FURTHER.get((strategy, None)))
    if rule is None:
        raise ValueError(f"no such sampling strategy: {strategy}")
    return [*DENSE, *PROMPT, *IMAGES, *rule]
