"""Visibility masks as ranges: for each query token the sorted half-open ranges of the keys that it sees.

What a token sees is a union of few sets of places: the keys that all tokens see, up to itself; images and latents of its
step; its block of observations; the question. Each set is found as runs of places by windows inside the row or a part of
it; those of whole rows are joined to the tokens last. A token's ranges are its sets' runs, cut at the token where they are
causal, and merged. No token is ever paired with another one, so rows may be long; a token's ranges are as many as the runs it sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = "array<struct<start:long,end:long>>"
#: Whose observations may be made to see what.
SEEN = (None, "question_and_latents", "latents", "images")


def _with_runs(rows: DataFrame, name: str, member: Column, *keys: str) -> DataFrame:
    """A column of the runs of consecutive places of members among the rows with the same keys; gaps in places end a run."""
    rows = rows.withColumn("_in", F.coalesce(member, F.lit(False)))
    same = Window.partitionBy(*keys, "_in")
    rows = rows.withColumn("_island", F.col("pos") - F.row_number().over(same.orderBy("pos")))
    island = Window.partitionBy(*keys, "_in", "_island")
    rows = rows.withColumn("_first", F.min("pos").over(island)).withColumn("_last", F.max("pos").over(island))
    run = F.when(F.col("_in") & (F.col("pos") == F.col("_first")), F.struct(F.col("pos").cast("long").alias("start"), (F.col("_last") + 1).cast("long").alias("end")))
    return rows.withColumn(name, F.array_sort(F.collect_list(run).over(Window.partitionBy(*keys)))).drop("_in", "_island", "_first", "_last")


def _none() -> Column:
    return F.array().cast(RANGES)


def _with_row_runs(rows: DataFrame, source: DataFrame, row: str, **members: Column) -> DataFrame:
    """A column for each of ``members``: the runs of consecutive places of its members in ``source`` in the whole row.

    A row's runs are made once and joined to its tokens at the end, as a list that grows with the row's length must not
    go with each token through windows and sorts.
    """
    for name, member in members.items():
        placed = source.filter(member).select(row, F.col("pos").cast("long").alias("pos"))
        placed = placed.withColumn("_island", F.col("pos") - F.row_number().over(Window.partitionBy(row).orderBy("pos")))
        runs = placed.groupBy(row, "_island").agg(F.struct(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).alias("_run"))
        runs = runs.groupBy(F.col(row).alias("_row")).agg(F.array_sort(F.collect_list("_run")).alias("_runs"))
        rows = rows.join(runs, F.col(row).eqNullSafe(F.col("_row")), "left").withColumn(name, F.coalesce(F.col("_runs"), _none())).drop("_row", "_runs")
    return rows


def up_to(runs: Column, last: Column) -> Column:
    """What of sorted runs is at most ``last``."""
    cut = lambda r: F.struct(r["start"].alias("start"), F.least(r["end"], last + 1).alias("end"))
    return F.transform(F.filter(runs, lambda r: r["start"] <= last), cut)


def merged(*sets: Column) -> Column:
    """The sorted union of several lists of runs, in which ranges that touch are one."""
    every = F.array_sort(F.concat(*sets))
    more = lambda done, r: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= r["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], r["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(r)))
    return F.aggregate(every, _none(), more)


def _marked(rows: DataFrame, row: str) -> DataFrame:
    # all windows are inside a row, so they share this exchange
    rows = rows.select(row, "pos", "valid", "kind", "step", "block").repartition(row)
    latent = F.when((F.col("kind") == "latent") & F.col("step").isNotNull(), F.col("pos"))
    return rows.withColumn("first_latent", F.min(latent).over(Window.partitionBy(row, "step")))


def visible_ranges(
    rows: DataFrame, row: str = "row_id", keep_images: bool = False, hide_latents: bool = False, hide_question_image: bool = False, latents_see_all: bool = True,
    observations_see: str | None = None, observations_skip_question_image: bool = False,
) -> DataFrame:
    """row, q and ranges: the mask of ``visible_pairs`` with the same rules, for rows of any length.

    Places are distinct inside a row; they may have gaps, which no range covers. A token that sees nothing has no range.
    """
    if observations_see not in SEEN:
        raise ValueError(f"observations cannot be made to see {observations_see}")
    rows = _marked(rows, row)
    kind, pos = F.col("kind"), F.col("pos")
    active = F.col("step").isNotNull() & F.col("first_latent").isNotNull()
    is_latent, is_image, question_image = kind == "latent", kind == "image", kind == "question_image"
    shown = F.col("valid")
    if hide_question_image:
        shown = shown & ~question_image
    if not keep_images:
        shown = shown & ~(active & is_image)
    if hide_latents:  # a step's latents come after its first one, which alone sees itself
        shown = shown & ~(active & is_latent)
    of_row, source = {"shown": shown}, rows
    if hide_question_image:
        of_row["question_images"] = question_image
    if observations_see == "question_and_latents":
        of_row |= {"question": kind == "question", "latents": is_latent}
        rows = rows.withColumn("block_start", F.min("pos").over(Window.partitionBy(row, "block")))
    elif observations_see is None and observations_skip_question_image:
        of_row["shown_text"] = shown & ~question_image & (kind != "question_edge")
    rows = _with_runs(rows, "own_images", is_image & F.col("step").isNotNull(), row, "step")
    rows = _with_runs(rows, "own_latents", is_latent & F.col("step").isNotNull(), row, "step")
    rows = _with_runs(rows, "mates", (kind == "observation") & F.col("step").isNotNull() & F.col("block").isNotNull(), row, "step", "block")
    rows = _with_row_runs(rows, source, row, **of_row)
    before = lambda name: F.when(F.col("valid"), up_to(F.col(name), pos)).otherwise(_none())
    itself = F.when(is_latent & (pos == F.col("first_latent")), F.array(F.struct(pos.cast("long").alias("start"), (pos + 1).cast("long").alias("end")))).otherwise(_none())
    of_latent = [F.col("own_images"), itself if hide_latents else up_to(F.col("own_latents"), pos)]
    if latents_see_all:
        of_latent += [before("shown"), *([F.col("question_images")] if hide_question_image else [])]
    of_observation = [up_to(F.col("mates"), pos)]
    if observations_see == "question_and_latents":
        of_observation += [F.col("question"), up_to(F.col("latents"), F.col("block_start") - 1)]
    elif observations_see == "latents":
        of_observation += [] if hide_latents else [F.col("own_latents")]
    elif observations_see == "images":
        of_observation += [F.col("own_images")]
    else:
        of_observation += [before("shown_text" if observations_skip_question_image else "shown")]
    # a latent outside active steps that is its own first one is not among these, as its step has a first latent
    ranges = F.when(active & is_latent, merged(*of_latent)).when(active & (kind == "observation"), merged(*of_observation)).otherwise(before("shown"))
    return rows.select(row, pos.alias("q"), ranges.alias("ranges"))


def visible_ranges_without_images(rows: DataFrame, row: str = "row_id", hide_latents: bool = False) -> DataFrame:
    """row, q and ranges of the mask of sequences without helper images: valid tokens up to each one; ``hide_latents``
    hides a step's latents from its first one on."""
    rows = _marked(rows, row)
    shown = F.col("valid")
    if hide_latents:
        shown = shown & ~F.coalesce((F.col("kind") == "latent") & F.col("first_latent").isNotNull(), F.lit(False))
    rows = _with_row_runs(rows, rows, row, shown=shown)
    return rows.select(row, F.col("pos").alias("q"), F.when(F.col("valid"), up_to(F.col("shown"), F.col("pos"))).otherwise(_none()).alias("ranges"))


def expanded(ranges: DataFrame, row: str = "row_id") -> DataFrame:
    """row, q, k of all visible pairs."""
    each = F.explode(F.flatten(F.transform("ranges", lambda r: F.sequence(r["start"], r["end"] - 1))))
    return ranges.select(row, "q", each.alias("k"))
