"""Personal data by high-recall generators and gradient-boosted trees, in DataFrame functions (operator 5).

Base kinds (email, ip, card, phone) are matched by fixed patterns and rules and always kept. Further generators
propose spans that may overlap them and each other. Features of a candidate's format and of the characters
around it go through boosted trees, written out as CASE expressions, and a threshold for each kind, calibrated
on examples that did not train, selects those to redact.

The trees are fitted on the driver from EXAMPLES made examples of candidates with a fixed seed: no row of the
data trains them, so their size and cost do not depend on it.

Positions come from the pieces between matches (split) and the matches (regexp_extract_all), whose lengths in
code points are summed; so a text is read a fixed number of times, however long it is. Patterns are written
without backtracking into earlier characters: quantifiers are possessive, and a match starts only where a run
of its characters does or the match before ended, which leaves the leftmost matches as they are.

Defined results: a null text is empty, with no spans; repeated rows each give a row; adjacent matches are
separate spans.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of kinds in all lists: the base kinds first.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "secret", "ssn")
KINDS = BASE_KINDS + MORE_KINDS
#: Pattern of each base kind, with a pattern that a text must have for it to be tried.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][0-9\x20-]{11}[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
#: (kind, pattern, what a text must have) of the further generators.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|<at>) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,63}+){1,5}+", r"[\[(<]at[\])>]"),
    ("phone", r"(?<![0-9A-Za-z.+-])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]{1,2}[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])", r"[0-9]{3}"),
    ("phone", r"(?<![0-9])00[1-9][0-9\x20().-]{7,18}[0-9](?![0-9])", r"00[1-9]"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[.\x20-]{1,2}[0-9]{4}){3}(?![0-9])", r"[0-9]{4}[.\x20-]"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,63}[0-9])[A-Za-z0-9_-]{16,128}+(?![A-Za-z0-9_-])", r"[A-Za-z0-9_-]{16}"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-"),
)
#: Characters around a candidate that its features see.
BEFORE, AFTER = 28, 8
#: Code points of the blocks from which a redacted text is put together.
BLOCK = 1024
#: Words before a candidate, matched in lower case.
CONTEXT = {
    "phone_word": r"phone|tel\b|tel[.:]|call|mobile|cell|fax|whatsapp|contact|dial",
    "id_word": r"ssn|social|sin\b|tax|passport|national",
    "bank_word": r"card|visa|master|bank|iban|account|acct|credit|payment",
    "mail_word": r"mail|reach|write to|contact",
    "secret_word": r"token|key|secret|passw|api|auth|bearer|credential",
    "count_word": r"order|ref|version|isbn|item|sku|page|build|invoice|release|commit|section|part|doi|total",
}
FEATURES = ("size", "digits", "upper", "lower", "marks", "distinct_digits", "hex_only", "leading_plus", "first_zero", "luhn", "glued", *CONTEXT, *(f"is_{k}" for k in KINDS))
EXAMPLES, TREES, DEPTH, RATE, LEAST_LEAF, SEED, PRECISION = 4000, 30, 3, 0.3, 12, 5, 0.97


def _running(xs: Column) -> Column:
    """Running sums of an array of longs, in blocks, so that no long array is copied for each of its entries."""
    block = 256
    slots = F.sequence(F.lit(0), ((F.size(xs) - 1) / block).cast("int"))
    part = lambda c: F.slice(xs, c * block + 1, F.lit(block))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    totals = F.transform(slots, lambda c: F.aggregate(part(c), F.lit(0).cast("long"), lambda a, x: a + x))
    offsets = F.aggregate(totals, F.array(F.lit(0).cast("long")), grow)
    with_offsets = F.zip_with(slots, F.slice(offsets, F.lit(1), F.size(slots)), lambda c, o: F.struct(c.alias("c"), o.alias("o")))
    return F.flatten(F.transform(with_offsets, lambda b: F.slice(F.aggregate(part(b["c"]), F.array(b["o"]), grow), 2, block)))


def _pieces(text: Column, pattern: str, needs: str) -> Column:
    """Gaps and matches of a pattern, null if there is none."""
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(needs), found)


def _spans(pieces: Column) -> Column:
    """start, end, value, before, after of each match, in order."""
    gaps, hits = pieces["gaps"], pieces["hits"]
    n = F.size(hits)
    ends = _running(F.zip_with(F.slice(gaps, F.lit(1), n), hits, lambda a, b: (F.length(a) + F.length(b)).cast("long")))
    zipped = F.zip_with(F.zip_with(hits, ends, lambda v, e: F.struct(v.alias("v"), e.alias("e"))), F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("b"), F.slice(gaps, F.lit(2), n).alias("a")), lambda x, g: F.struct(
        (x["e"] - F.length(x["v"])).alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.right(g["b"], F.lit(BEFORE)).alias("before"), F.left(g["a"], F.lit(AFTER)).alias("after"),
    ))
    kind = "array<struct<s:long,e:long,v:string,before:string,after:string>>"
    return F.when(n > 0, zipped.cast(kind)).otherwise(F.array().cast(kind))


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 1, twice).otherwise(x)

    return F.when(n.between(2, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.|$)){4}$") & ~v.rlike(r"(?:^|\.)(?:\.|$)")
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


# features: once for columns, once for the made examples


def _feature_columns(kind: str, c: Column) -> dict[str, Column]:
    v, before = c["v"], c["before"]
    only = lambda chars: F.length(F.regexp_replace(v, f"[^{chars}]", ""))
    digits = F.regexp_replace(v, "[^0-9]", "")
    out = {
        "size": F.length(v), "digits": F.length(digits), "upper": only("A-Z"), "lower": only("a-z"), "marks": F.length(v) - only("A-Za-z0-9"),
        "distinct_digits": F.size(F.array_remove(F.array_distinct(F.split(digits, "")), "")), "hex_only": v.rlike("^[0-9a-f]+$").cast("int"),
        "leading_plus": v.startswith("+").cast("int"), "first_zero": v.startswith("00").cast("int"), "luhn": _luhn(digits).cast("int"),
        "glued": (before.rlike("[$€£#/=._-]$") | c["after"].rlike("^(?:[%€$/_]|[.,-][0-9])")).cast("int"),
    }
    out |= {name: F.lower(before).rlike(pattern).cast("int") for name, pattern in CONTEXT.items()}
    return out | {f"is_{k}": F.lit(int(k == kind)) for k in KINDS}


def luhn(digits: str) -> bool:
    """Luhn's check in Python, for the made examples and tests."""
    if not 2 <= len(digits) <= 19:
        return False
    total = 0
    for i, ch in enumerate(reversed(digits)):
        x = int(ch) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def feature_row(kind: str, v: str, before: str, after: str) -> list[int]:
    """The same features in Python."""
    digits = re.sub("[^0-9]", "", v)
    only = lambda chars: len(re.sub(f"[^{chars}]", "", v))
    out = {
        "size": len(v), "digits": len(digits), "upper": only("A-Z"), "lower": only("a-z"), "marks": len(v) - only("A-Za-z0-9"), "distinct_digits": len(set(digits)),
        "hex_only": bool(re.search("^[0-9a-f]+$", v)), "leading_plus": v.startswith("+"), "first_zero": v.startswith("00"), "luhn": luhn(digits),
        "glued": bool(re.search("[$€£#/=._-]$", before) or re.search("^(?:[%€$/_]|[.,-][0-9])", after)),
    }
    out |= {name: bool(re.search(pattern, before.lower())) for name, pattern in CONTEXT.items()}
    return [int(out.get(f, f == f"is_{kind}")) for f in FEATURES]


def _example(rng: random.Random) -> tuple[str, str, str, str, int]:
    """(kind, value, before, after, label) of a made candidate."""
    num = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    plain = f"{word()} {word()} "
    hint = lambda *w: plain + rng.choice(w) + rng.choice([": ", " ", " is "]) if rng.random() < 0.5 else plain
    misled = lambda: plain + rng.choice(["order", "ref", "version", "invoice", "sku", "isbn", "item", "total"]) + rng.choice([" ", ": ", " #"])
    after = rng.choice([" ", ".", ", ", "\n", ""])
    case = rng.randrange(12)
    if case == 0:
        return "email", f"{word()}{rng.choice(['[at]', ' (at) ', ' [at] '])}{word()}{rng.choice(['.', ' [dot] ', '(dot)'])}com", hint("mail", "contact"), after, 1
    if case == 1:
        return "phone", rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"]), hint("call", "tel", "phone"), after, 1
    if case == 2:
        return "phone", f"00{rng.randint(1, 9)}{num(1)} {num(3)} {num(3)} {num(3)}", hint("call", "fax"), after, 1
    if case == 3:
        return "phone", rng.choice([f"{num(4)} {num(4)} {num(4)}", f"{num(2)}-{num(3)}{num(3)}", f"{num(4)}-{num(4)}"]), misled(), rng.choice([" ", "%", "/7", ".5"]), 0
    if case == 4:
        digits = num(15)
        value = next(digits + str(d) for d in range(10) if luhn(digits + str(d)))
        return "card", rng.choice([". ", "  ", "-"]).join(value[i : i + 4] for i in (0, 4, 8, 12)), hint("card", "visa", "payment"), after, 1
    if case == 5:
        value = num(16)
        while luhn(value):
            value = num(16)
        return "card", rng.choice([". ", " ", "-"]).join(value[i : i + 4] for i in (0, 4, 8, 12)), misled() if rng.random() < 0.5 else plain, after, 0
    if case == 6:
        return "iban", rng.choice(["DE", "FR", "GB", "ES"]) + num(2) + " ".join(["", *(num(4) for _ in range(rng.randint(4, 5)))]), hint("iban", "account"), after, 1
    if case == 7:
        return "iban", rng.choice(["AB", "SK", "QX"]) + num(2) + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=12)), misled(), after, 0
    if case == 8:
        value = rng.choice(["AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), "".join(rng.choices("0123456789abcdef", k=rng.choice([32, 40, 64]))), "sk_" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rng.randint(20, 40)))])
        return "secret", value, hint("token = \"", "key", "secret", "api key"), rng.choice(["\"", " ", "\n"]), 1
    if case == 9:
        return "secret", rng.choice([f"{word()}-{word()}-{word()}-{num(2)}", f"{num(4)}-{num(2)}-{num(2)}-{word()}{word()}", f"{word()}_{word()}_{word()}{num(1)}", num(rng.randint(16, 20))]), misled() if rng.random() < 0.5 else plain, after, 0
    if case == 10:
        return "ssn", f"{num(3)}-{num(2)}-{num(4)}", hint("ssn", "social security", "tax id"), after, 1
    return "ssn", f"{num(3)}-{num(2)}-{num(4)}", misled(), after, 0


@dataclass
class Tree:
    """A node: a split by ``feature <= at``, or a leaf with a value."""

    value: float = 0.0
    feature: int = -1
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.at, self.low.scores(x), self.high.scores(x))

    def column(self, c: Column) -> Column:
        if self.feature < 0:
            return F.lit(float(self.value))
        return F.when(c[FEATURES[self.feature]] <= self.at, self.low.column(c)).otherwise(self.high.column(c))


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int) -> Tree:
    """A tree by second-order gain."""
    best = (1e-6, -1, 0.0)
    total_g, total_h = gradient.sum(), weight.sum()
    if depth:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, g, h = x[order, f], np.cumsum(gradient[order]), np.cumsum(weight[order])
            cut = np.flatnonzero(v[1:] != v[:-1])
            cut = cut[(cut + 1 >= LEAST_LEAF) & (len(v) - cut - 1 >= LEAST_LEAF)]
            if len(cut):
                gain = g[cut] ** 2 / (h[cut] + 1) + (total_g - g[cut]) ** 2 / (total_h - h[cut] + 1) - total_g**2 / (total_h + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(v[cut[k]] + v[cut[k] + 1]) / 2)
    if best[1] < 0:
        return Tree(value=float(-RATE * total_g / (total_h + 1)))
    low = x[:, best[1]] <= best[2]
    return Tree(feature=best[1], at=best[2], low=_grow(x[low], gradient[low], weight[low], depth - 1), high=_grow(x[~low], gradient[~low], weight[~low], depth - 1))


@lru_cache(maxsize=1)
def fitted() -> tuple[list[Tree], dict[str, float]]:
    """The boosted trees and each kind's threshold: the least score with PRECISION on examples that did not train."""
    rng = random.Random(SEED)
    made = [_example(rng) for _ in range(EXAMPLES)]
    x, y = np.array([feature_row(*m[:4]) for m in made], float), np.array([m[4] for m in made], float)
    half = EXAMPLES // 2
    score, trees = np.zeros(EXAMPLES), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score[:half]))
        trees.append(_grow(x[:half], p - y[:half], p * (1 - p), DEPTH))
        score += trees[-1].scores(x)
    thresholds = {}
    for kind in KINDS:
        held = [(s, t) for s, t, m in zip(score[half:].tolist(), y[half:].tolist(), made[half:], strict=True) if m[0] == kind]
        right, threshold = 0, 0.0
        for n, (s, t) in enumerate(sorted(held, reverse=True), 1):
            right += t
            if right / n >= PRECISION:
                threshold = s
        thresholds[kind] = max(threshold, 0.0)
    return trees, thresholds


def _is_valid(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["v"])


def _with_features(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), *(c.alias(n) for n, c in _feature_columns(kind, x).items()))


def _selected(trees: list[Tree], threshold: float) -> Callable[[Column], Column]:
    return lambda x: sum((t.column(x) for t in trees), F.lit(0.0)) >= threshold


def _written(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"])


def _with_spans(rows: DataFrame) -> DataFrame:
    """``rows`` has the columns own (any struct) and text (no nulls); arrays ``base_<kind>`` and ``all_<kind>`` are added."""
    trees, thresholds = fitted()
    rows = rows.select(
        "own", "text", *(_pieces(F.col("text"), *BASE[k]).alias(f"p_{k}") for k in BASE_KINDS),
        *(_pieces(F.col("text"), pattern, needs).alias(f"g_{i}") for i, (_, pattern, needs) in enumerate(GENERATORS)),
    )
    none = F.array().cast("array<struct<s:long,e:long>>")
    place = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    base, more = [], []
    for k in BASE_KINDS:
        found = F.filter(_spans(F.col(f"p_{k}")), _is_valid(k))
        base.append(F.when(F.col(f"p_{k}").isNotNull(), F.transform(found, place)).otherwise(none).alias(f"base_{k}"))
    for i, (k, _, _) in enumerate(GENERATORS):
        kept = F.filter(F.transform(_spans(F.col(f"g_{i}")), _with_features(k)), _selected(trees, thresholds[k]))
        more.append(F.when(F.col(f"g_{i}").isNotNull(), F.transform(kept, place)).otherwise(none).alias(f"m_{i}"))
    found = rows.select("own", "text", *base, *more)
    for k in KINDS:
        own = [F.col(f"base_{k}")] * (k in BASE_KINDS) + [F.col(f"m_{i}") for i, g in enumerate(GENERATORS) if g[0] == k]
        found = found.withColumn(f"all_{k}", F.array_sort(F.array_distinct(F.concat(*own))) if len(own) > 1 else own[0])
    return found.select("own", "text", *(f"base_{k}" for k in BASE_KINDS), *(f"all_{k}" for k in KINDS))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and for each kind an array of spans (s, e in code points, e exclusive): ``base_<kind>``, ``all_<kind>``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = _with_spans(docs.select(F.struct(F.col(id_col).alias("id")).alias("own"), text.alias("text")))
    return found.select(F.col("own.id").alias(id_col), *(f"base_{k}" for k in BASE_KINDS), *(f"all_{k}" for k in KINDS))


def spans_text(prefix: str, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, joined by commas."""
    return F.array_join(F.concat(*(F.transform(f"{prefix}_{k}", _written(k)) for k in kinds)), ",")


def _marked(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), F.lit(kind).alias("kind"))


def _joined_spans(spans: Column) -> Column:
    """Sorted spans (s, n the negative end, kind) as disjoint ones: overlapping spans become one of the first one's kind."""
    kind = "array<struct<s:long,e:long,kind:string>>"
    entry = lambda s, e, k: F.struct(s.alias("s"), e.alias("e"), k.alias("kind"))

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(entry(last["s"], F.greatest(last["e"], -x["n"]), last["kind"])))
        return F.when((F.size(acc) > 0) & (x["s"] < F.get(acc, F.size(acc) - 1)["e"]), wider).otherwise(F.concat(acc, F.array(entry(x["s"], -x["n"], x["kind"])))).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), add)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with all selected spans, base ones and those of the trees, replaced by ``<kind>`` in the text.

    Spans are found in the whole text first and replaced at once. Of overlapping spans the one that starts first,
    of these the longest, names the kind of their union. A null text stays null.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = _with_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), text.alias("text")))
    spans = _joined_spans(F.array_sort(F.concat(*(F.transform(f"all_{k}", _marked(k)) for k in KINDS))))
    cut = found.select("own", "text", spans.alias("spans"))
    # blocks of BLOCK code points, so that a part of a long text is cut out of the blocks that it lies in
    blocks = F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    cut = cut.select("own", "spans", blocks.alias("blocks"), F.length("text").cast("long").alias("n"))

    def between(a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        inside = F.array_join(F.slice("blocks", first + 1, F.ceil(b / BLOCK).cast("int") - first), "")
        return F.when(a < b, F.substring(inside, (a % BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    before = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda x: x["e"]))
    parts = F.transform("spans", lambda x, i: F.concat(between(F.get(before, i), x["s"]), F.lit("<"), x["kind"], F.lit(">")))
    whole = F.concat(F.array_join(parts, ""), between(F.element_at(before, -1), F.col("n")))
    replaced = F.when(F.size("spans") > 0, whole).otherwise(F.col(f"own.`{text_col}`"))
    return cut.select(*(replaced.alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in docs.columns))
