"""Steps of a token sequence: paired tags, image, latent and observation blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "row_id long, question array<int>, steps array<struct<image:array<int>,latent:array<int>,observations:array<array<int>>>>"


@dataclass(frozen=True)
class Tags:
    """Ids of the tags."""

    image_start: int
    image_end: int
    image_pad: int
    latent_start: int
    latent_end: int
    latent_pad: int
    observation_start: int
    observation_end: int


def pair_tags(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Greedy pairs: each start with the next unused end beyond it; ends before it are skipped."""
    out, k = [], 0
    for s in starts:
        while k < len(ends) and ends[k] <= s:
            k += 1
        if k == len(ends):
            break
        out.append((s, ends[k]))
        k += 1
    return out


def segments(ids: list[int], tags: Tags, images: bool = True) -> tuple[list[int], list[tuple[list[int], list[int], list[list[int]]]]]:
    """(question image, steps): image places, latent places and observation blocks of each step.

    The first image is the question's. A step's text runs from the end of its latents to the start of the next
    image (or latents, without helper ``images``), and holds the observations that lie inside it.
    """
    at = lambda x: [i for i, y in enumerate(ids) if y == x]
    inside = lambda p, want=None: [i for i in range(p[0] + 1, p[1]) if want is None or ids[i] == want]
    pictures = pair_tags(at(tags.image_start), at(tags.image_end))
    latents = pair_tags(at(tags.latent_start), at(tags.latent_end))
    question = inside(pictures[0], tags.image_pad) if pictures else []
    pictures = pictures[1:]
    opens, closes = at(tags.observation_start), at(tags.observation_end)
    borders = [s for s, _ in (pictures if images else latents)]
    steps = []
    for k in range(min(len(pictures), len(latents)) if images else len(latents)):
        begin = latents[k][1]
        end = borders[k + 1] if k + 1 < len(borders) else len(ids)
        blocks = [b for p in pair_tags([s for s in opens if begin <= s < end], [e for e in closes if begin < e <= end]) if (b := inside(p))]
        steps.append((inside(pictures[k], tags.image_pad) if images else [], inside(latents[k], tags.latent_pad), blocks))
    return question, steps


def find_segments(df: DataFrame, tags: Tags, images: bool = True) -> DataFrame:
    """Segments of each row with row_id and ids; rows are independent and never shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [segments(list(x), tags, images) for x in pdf["ids"]]
            steps = [[{"image": i, "latent": a, "observations": o} for i, a, o in s] for _, s in found]
            yield pd.DataFrame({"row_id": pdf["row_id"], "question": [q for q, _ in found], "steps": steps})

    return df.select("row_id", "ids").mapInPandas(run, SCHEMA)


def strip_observations(text: str, open_tag: str = "<observation>", close_tag: str = "</observation>") -> tuple[str, list[tuple[int, int]]]:
    """(text without tags, merged spans of what outermost tags enclosed); an open one closes at the end, a stray close is skipped."""
    clean, spans, depth, size, begin, last = [], [], 0, 0, 0, 0
    for m in re.finditer(f"{re.escape(open_tag)}|{re.escape(close_tag)}", text):
        clean.append(text[last : m.start()])
        size, last = size + m.start() - last, m.end()
        if m[0] == open_tag:
            begin = size if depth == 0 else begin
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                spans.append((begin, size))
    clean.append(text[last:])
    if depth:
        spans.append((begin, size + len(text) - last))
    merged: list[tuple[int, int]] = []
    for s, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], e))
        else:
            merged.append((s, e))
    return "".join(clean), merged


def observed_words(text: str) -> tuple[str, list[int]]:
    """(clean text, numbers of its words that share a character with an observation)."""
    clean, spans = strip_observations(text)
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", clean)]
    return clean, [i for i, (s, e) in enumerate(words) if any(max(s, a) < min(e, b) for a, b in spans)]


def track_observations(df: DataFrame, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """clean_text and observed word numbers of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [observed_words(x or "") for x in pdf[text_col]]
            yield pd.DataFrame({id_col: pdf[id_col], "clean_text": [c for c, _ in found], "observed": [o for _, o in found]})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} long, clean_text string, observed array<int>")


def rope_positions(spans: list[tuple[str, int, int, int]]) -> list[list[int]]:
    """Three rows of positions for spans (kind, frames, height, width); text has its length as height."""
    rows, start = [[], [], []], 0
    for kind, frames, height, width in spans:
        if kind == "text":
            new = [list(range(start, start + height))] * 3
        else:
            grid = [(f, h, w) for f in range(frames) for h in range(height) for w in range(width)]
            new = [[start + g[k] for g in grid] for k in range(3)]
        for r, x in zip(rows, new, strict=True):
            r.extend(x)
        start = max((max(x) for x in new if x), default=start - 1) + 1
    return rows


def paired(df: DataFrame) -> DataFrame:
    """``pairs`` (start, end) of each row's row_id, starts and ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [pair_tags(list(s), list(e)) for s, e in zip(pdf["starts"], pdf["ends"], strict=True)]
            yield pd.DataFrame({"row_id": pdf["row_id"], "pairs": [[[int(a), int(b)] for a, b in x] for x in found]})

    return df.select("row_id", "starts", "ends").mapInPandas(run, "row_id long, pairs array<array<long>>")


def rope_index(df: DataFrame) -> DataFrame:
    """Positions in frames, heights and widths of each row's spans (kind, frames, height, width)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [rope_positions([(s["kind"], int(s["frames"]), int(s["height"]), int(s["width"])) for s in x]) for x in pdf["spans"]]
            yield pd.DataFrame({"row_id": pdf["row_id"]} | {name: [x[k] for x in found] for k, name in enumerate(("frames", "heights", "widths"))})

    return df.select("row_id", "spans").mapInPandas(run, "row_id long, frames array<long>, heights array<long>, widths array<long>")
