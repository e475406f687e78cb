"""Functions over token arrays and spans as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Label of positions that do not count.
IGNORED = -100


def array_of(xs: Sequence[int]) -> Column:
    """A literal array of longs."""
    return F.array(*(F.lit(int(x)).cast("long") for x in xs))


def _upto(low: Column, high: Column) -> Column:
    """Integers from low to high, none if high is below low."""
    return F.when(high >= low, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))


def _starts(ids: Column, patterns: Sequence[Sequence[int]], start: Column) -> Column:
    """Places from ``start`` on at which a pattern begins; the scan ends where the longest one would not fit."""
    longest = max(map(len, patterns))

    def matches(i: Column) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | (F.slice(ids, i + 1, F.lit(len(p))) == array_of(p))
        return found

    return F.filter(_upto(start, F.size(ids) - longest), matches)


def find_subsequence(ids: Column, patterns: Sequence[int] | Sequence[Sequence[int]], start: int | Column = 0) -> Column:
    """First place of a sub-sequence, or of any of several, from ``start``; -1 if there is none."""
    many = patterns if isinstance(patterns[0], (list, tuple)) else [patterns]
    first = F.get(_starts(ids, many, start if isinstance(start, Column) else F.lit(start)), F.lit(0))
    return F.coalesce(first, F.lit(-1))


def find_all(ids: Column, after: Sequence[int], pattern: Sequence[int]) -> Column:
    """All places of a pattern beyond the first place of ``after``; none if that does not occur."""
    first = find_subsequence(ids, after)
    return F.when(first >= 0, _starts(ids, [pattern], first + 1)).otherwise(F.array().cast("array<int>"))


def labels_after(ids: Column, start: Sequence[int], ignored: Sequence[int] = ()) -> Column:
    """Ids after the first start sequence; IGNORED before and on it, on ignored ids, and everywhere without it."""
    at = find_subsequence(ids, start)
    return F.transform(ids, lambda x, i: F.when((at < 0) | (i < at + len(start)) | x.isin(*ignored) if ignored else (at < 0) | (i < at + len(start)), F.lit(IGNORED)).otherwise(x))


def labels_at(ids: Column, start: Sequence[int], allowed: Column) -> Column:
    """As ``labels_after``, but only allowed positions keep their ids."""
    at = find_subsequence(ids, start)
    return F.transform(ids, lambda x, i: F.when((at < 0) | (i < at + len(start)) | ~F.array_contains(allowed, i), F.lit(IGNORED)).otherwise(x))


def positions_between(starts: Column, ends: Column, skip: int = 0) -> Column:
    """Union of ``[start + skip, end)`` over pairs of arrays, whose lengths must be equal."""
    pairs = F.flatten(F.zip_with(starts, ends, lambda s, e: _upto(s + skip, e - 1)))
    return F.when(F.size(starts) == F.size(ends), pairs).otherwise(F.raise_error(F.lit("starts and ends differ in number")))


def eos_mask(ids: Column, eos: int) -> Column:
    """1 up to and including the first end token, 0 after it."""
    at = F.array_position(ids, eos)
    return F.transform(ids, lambda x, i: ((at == 0) | (i < at)).cast("long"))


def pad_mask(ids: Column, pad: int) -> Column:
    """1 where the id is not padding."""
    return F.transform(ids, lambda x: (x != pad).cast("long"))


def cumulative_positions(mask: DataFrame, row: str, pos: str, value: str, out: str) -> DataFrame:
    """Clipped running sum of a mask, less one (long form)."""
    w = Window.partitionBy(row).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return mask.withColumn(out, F.greatest(F.sum(value).over(w) - 1, F.lit(0)))


def response_positions(prompt: Column, length: Column) -> Column:
    """Prompt positions followed by those of a response of ``length`` tokens."""
    return F.concat(prompt, F.transform(_upto(F.lit(1), length), lambda k: F.element_at(prompt, -1) + k))


def pad_to(ids: Column, length: Column | int, pad: int, left: bool = False) -> Column:
    """Padded to a length; unchanged if long enough."""
    length = length if isinstance(length, Column) else F.lit(length)
    more = F.array_repeat(F.lit(pad).cast("long"), F.greatest(length - F.size(ids), F.lit(0)))
    return F.concat(more, ids) if left else F.concat(ids, more)


def pad_and_clip(ids: Column, length: Column | int, pad: int, left: bool = False) -> Column:
    """Padded to a length, and cut to it at the end."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.slice(pad_to(ids, length, pad, left), F.lit(1), length)


def truncate(ids: Column, most: int, mode: str) -> Column:
    """At most ``most`` ids: the last ones (left), the first ones (right), or an error."""
    if mode == "right":
        return F.slice(ids, 1, most)
    if mode == "left":
        return F.when(F.size(ids) > most, F.slice(ids, -most, most)).otherwise(ids)
    if mode == "error":
        return F.when(F.size(ids) > most, F.raise_error(F.lit(f"longer than {most}"))).otherwise(ids)
    raise NotImplementedError(f"no such truncation: {mode}")


def fit(ids: Column, length: int, pad: int, left_pad: bool, mode: str) -> Column:
    """Padded to a length if shorter, truncated if longer."""
    return F.when(F.size(ids) < length, pad_to(ids, length, pad, left_pad)).otherwise(truncate(ids, length, mode))


def place_reward(score: Column, valid: Column, length: Column) -> Column:
    """Zeros of a length with the score at the last valid position."""
    return F.transform(_upto(F.lit(0), length - 1), lambda i: F.when(i == valid - 1, score).otherwise(0.0))


def place_rewards(scores: Column, places: Column, length: Column) -> Column:
    """Zeros of a length with each score at its place."""
    at = F.map_from_arrays(places, scores)
    return F.transform(_upto(F.lit(0), length - 1), lambda i: F.coalesce(F.element_at(at, i), F.lit(0.0)))


def merge_spans(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching half-open spans of a key become one: a running maximum and islands."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def dyadic_cells(start: Column, end: Column, levels: Column | int) -> Column:
    """The cells (level, cell) of a grid of powers of two that together are exactly [start, end): at most two of each level.

    At level k a cell is 2^k places wide. Of what whole cells of that level the span has, the first one is taken if its
    number is odd, and the last one if it is even, as those do not fill a cell of the next level.
    """
    level = lambda k: F.struct(k.alias("level"), (-F.call_function("shiftright", -start, k)).alias("a"), F.call_function("shiftright", end, k).alias("b"))
    at = F.transform(F.sequence(F.lit(0), F.lit(levels) if isinstance(levels, int) else levels), level)
    cell = lambda x, c: F.struct(x["level"].alias("level"), c.cast("long").alias("cell"))
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("long"))
    first = lambda x: F.when((odd(x["a"]) == 1) & (x["a"] < x["b"]), cell(x, x["a"]))
    last = lambda x: F.when((odd(x["b"]) == 1) & (x["a"] + odd(x["a"]) < x["b"]), cell(x, x["b"] - 1))
    return F.filter(F.flatten(F.transform(at, lambda x: F.array(first(x), last(x)))), lambda c: c.isNotNull())


#: Parts of the points' range, at least, that are cells of the top level; keys up to which rows of other keys are left out first.
PARTS, KEYS = 16, 1 << 20


def _stabbed(points: DataFrame, at: str, spans: DataFrame, start: Column, end: Column, key: str) -> DataFrame:
    """Pairs of a point and a span of the same key that holds it: the point is in exactly one of the span's cells.

    Spans are cut to the range of all points first, and the range has PARTS cells of the top level or more, so that a few
    keys whose spans hold all points are many cells still. Rows are dealt by cells over a fixed number of partitions, as
    adaptive execution goes by bytes, and a planner that does not see how many rows a cut makes would broadcast them.
    """
    place = F.col(at).cast("long")
    low, high = points.agg(F.min(place), F.max(place)).first()
    if low is None:
        low = high = 0
    inner = spans.withColumn("_s", F.greatest(start.cast("long"), F.lit(low).cast("long"))).withColumn("_e", F.when(end > F.lit(high), F.lit(high).cast("long") + 1).otherwise(end.cast("long"))).filter("_s < _e")
    most = inner.agg(F.max(F.col("_e") - F.col("_s")).alias("n")).first().n or 1
    top = max(0, min(most.bit_length(), (high - low + 1).bit_length() - PARTS.bit_length() + 1) - 1)
    ups = F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", place, k).alias("cell")))
    first, last = -F.call_function("shiftright", -F.col("_s"), F.lit(top)), F.call_function("shiftright", F.col("_e"), F.lit(top)) - 1
    whole = F.when(first <= last, F.transform(F.sequence(first, last), lambda c: F.struct(F.lit(top).alias("level"), c.alias("cell")))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))
    cells = F.concat(dyadic_cells(F.col("_s"), F.col("_e"), top - 1), whole) if top else whole
    spark = points.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = lambda df, c: df.withColumn("_c", F.explode(c)).select("*", "_c.level", "_c.cell").drop("_c", "_s", "_e").repartition(n, key, "level", "cell").hint("merge")
    return cut(points, ups).join(cut(inner, cells), [key, "level", "cell"]).drop("level", "cell")


def _of_common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The rows of ``a`` whose key ``b`` has, where few keys say so; else all, and the join leaves the others out."""
    keys = b.select(key).distinct()
    return a.join(F.broadcast(keys), key, "left_semi") if keys.limit(KEYS + 1).count() <= KEYS else a


def overlap_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of half-open spans of integers (start, end and other, other_end) of a key that overlap.

    Of two spans that overlap, either ``start`` lies in the other span, or ``other`` lies behind ``start`` in the first
    one, never both. A span is cut into cells of a dyadic grid, of which a length L has at most 2 log2 L and some PARTS of
    the top level, and a point looks in one cell of each level up to that of the longest span. Whatever meets in a cell is
    a pair, each once, so the join makes no candidates that are dropped. Empty spans, and null keys or ends, are in no pair.
    """
    a, b = a.filter("end > start"), b.filter("other_end > other")
    a, b = _of_common_keys(a, b, key), _of_common_keys(b, a, key)
    inside = _stabbed(a, "start", b, F.col("other"), F.col("other_end"), key)
    behind = _stabbed(b, "other", a, F.col("start").cast("long") + 1, F.col("end"), key)
    columns = [key, *(c for c in a.columns if c != key), *(c for c in b.columns if c != key)]
    return inside.select(*columns).unionAll(behind.select(*columns))


def on_annotated_path(tag: Column) -> Column:
    """Whether a node tag is the root, or every child index on its path is 1."""
    return (tag == "0") | F.forall(F.slice(F.split(tag, "\\."), F.lit(2), F.greatest(F.lit(0), F.size(F.split(tag, "\\.")) - 1)), lambda x: x == "1")


#: Tokens of a row up to which its visibility is given as pairs.
MOST_TOKENS = 4096


def _token_pairs(rows: DataFrame, row: str) -> DataFrame:
    """Pairs of a row's tokens: columns of the query token begin with q_, of the key token with k_."""
    step, block = Window.partitionBy(row, "step"), Window.partitionBy(row, "step", "block")
    latent = F.when((F.col("kind") == "latent") & F.col("step").isNotNull(), F.col("pos"))
    marked = rows.select(row, "pos", "valid", "kind", "step", "block", F.min(latent).over(step).alias("first_latent"), F.min("pos").over(block).alias("block_start"))
    checked = marked.withColumn("pos", F.when(F.col("pos") < MOST_TOKENS, F.col("pos")).otherwise(F.raise_error(F.lit(f"a row has more than {MOST_TOKENS} tokens"))))
    side = lambda c: checked.select(row, *(F.col(x).alias(f"{c}_{x}") for x in checked.columns if x != row))
    return side("q").join(side("k"), row)


def visible_pairs(
    rows: DataFrame, row: str = "row_id", keep_images: bool = False, hide_latents: bool = False, hide_question_image: bool = False, latents_see_all: bool = True,
    observations_see: str | None = None, observations_skip_question_image: bool = False,
) -> DataFrame:
    """The visibility mask of short sequences as a relation (row, q, k, allowed).

    Token rows have pos, valid, kind (text, question, question_image, question_edge for the tags around it, image,
    latent, observation), step (null outside steps) and block (of an observation). Without further rules a token sees
    valid tokens up to itself. A step without latents has no rules. Else
    - its images are seen by its latents alone, unless ``keep_images``;
    - its latents see its images and each other up to themselves, and nothing else unless ``latents_see_all``;
    - a block of observations sees itself up to each token; with ``observations_see`` else only what that names:
      "question_and_latents" (the question without images, and latents before the block), "latents" or "images"
      (those of its step); ``observations_skip_question_image`` hides the question's image and its tags from them.
    ``hide_latents`` hides latents from all tokens behind the step's first one, ``hide_question_image`` the question's
    image from all but latents of steps. Pairs are joined inside a row only; a row with more than MOST_TOKENS is an error.
    """
    if observations_see not in (None, "question_and_latents", "latents", "images"):
        raise ValueError(f"observations cannot be made to see {observations_see}")
    pairs = _token_pairs(rows, row)
    col, off, on = F.col, F.lit(False), F.lit(True)
    causal = col("k_pos") <= col("q_pos")
    key_in_step = col("k_step").isNotNull() & col("k_first_latent").isNotNull()
    own = key_in_step & (col("q_step") == col("k_step"))
    active = col("q_step").isNotNull() & col("q_first_latent").isNotNull()
    question_image = col("k_kind") == "question_image"
    seen = causal & col("q_valid") & col("k_valid")
    if hide_question_image:
        seen = seen & ~question_image
    if not keep_images:
        seen = seen & ~(key_in_step & (col("k_kind") == "image"))
    hidden = key_in_step & (col("k_kind") == "latent") & (col("q_pos") > col("k_first_latent")) if hide_latents else off
    seen = seen & ~hidden
    of_latent = F.when(own & (col("k_kind") == "latent"), causal & ~hidden).when(own & (col("k_kind") == "image"), on)
    if not latents_see_all:
        of_latent = of_latent.otherwise(off)
    elif hide_question_image:
        of_latent = of_latent.when(question_image, on).otherwise(seen)
    else:
        of_latent = of_latent.otherwise(seen)
    of_observation = F.when(own & (col("k_kind") == "observation") & (col("q_block") == col("k_block")), causal)
    if observations_see == "question_and_latents":
        of_observation = of_observation.otherwise((col("k_kind") == "question") | ((col("k_kind") == "latent") & (col("k_pos") < col("q_block_start"))))
    else:
        if observations_skip_question_image:
            of_observation = of_observation.when(question_image | (col("k_kind") == "question_edge"), off)
        if observations_see == "latents":
            of_observation = of_observation.otherwise(off if hide_latents else own & (col("k_kind") == "latent"))
        else:
            of_observation = of_observation.otherwise(seen if observations_see is None else own & (col("k_kind") == "image"))
    allowed = F.when(active & (col("q_kind") == "latent"), of_latent).when(active & (col("q_kind") == "observation"), of_observation).otherwise(seen)
    return pairs.select(row, col("q_pos").alias("q"), col("k_pos").alias("k"), F.coalesce(allowed, off).alias("allowed"))


def visible_pairs_without_images(rows: DataFrame, row: str = "row_id", hide_latents: bool = False) -> DataFrame:
    """The mask of sequences without helper images: valid tokens up to each one; ``hide_latents`` hides a step's
    latents from its first one on."""
    col = F.col
    allowed = (col("k_pos") <= col("q_pos")) & col("q_valid") & col("k_valid")
    if hide_latents:
        allowed = allowed & ~F.coalesce((col("k_kind") == "latent") & (col("q_pos") >= col("k_first_latent")), F.lit(False))
    return _token_pairs(rows, row).select(row, col("q_pos").alias("q"), col("k_pos").alias("k"), allowed.alias("allowed"))
