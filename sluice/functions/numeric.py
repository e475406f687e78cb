"""Elementwise numeric functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    """``x`` between bounds."""
    return F.least(F.greatest(x, low if isinstance(low, Column) else F.lit(float(low))), high if isinstance(high, Column) else F.lit(float(high)))


def kl(lp: Column, ref: Column, kind: str) -> Column:
    """Divergence estimates of log-probabilities; ``full`` takes arrays over a vocabulary; others are errors."""
    d = lp - ref if kind != "full" else None
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        k = clamp(ref - lp, -10, 10)
        return clamp(F.exp(k) - k - 1, -10, 10)
    if kind == "full":
        return F.aggregate(F.zip_with(ref, lp, lambda r, x: F.exp(x) * (x - r)), F.lit(0.0), lambda a, x: a + x)
    raise NotImplementedError(f"no such divergence: {kind}")


def penalised_reward(score: Column, lp: Column, ref: Column, beta: float) -> Column:
    """Score less the weighted log-ratio."""
    return score - beta * (lp - ref)


def adaptive_coefficient(beta: float, current: float, steps: int, target: float, horizon: float) -> float:
    """The KL coefficient after an update; the relative error counts within 0.2."""
    return beta * (1 + min(0.2, max(-0.2, current / target - 1)) * steps / horizon)


class KLController:
    """Coefficient of the KL penalty, fixed or adaptive."""

    def __init__(self, kind: str, coefficient: float, target: float = 0.0, horizon: float = 0.0):
        if kind not in {"fixed", "adaptive"}:
            raise ValueError(f"no such controller: {kind}")
        if kind == "adaptive" and horizon <= 0:
            raise ValueError("the horizon must be positive")
        self.kind, self.coefficient, self.target, self.horizon = kind, coefficient, target, horizon

    def update(self, current: float, steps: int) -> None:
        if self.kind == "adaptive":
            self.coefficient = adaptive_coefficient(self.coefficient, current, steps, self.target, self.horizon)


def policy_loss(old: Column, new: Column, adv: Column, low: float, high: float, dual: float) -> dict[str, Column]:
    """Elementwise terms of the dual-clipped policy loss: loss, high_clip, low_clip, kl."""
    ratio_log = clamp(new - old, -10, 10)
    plain = -adv * F.exp(ratio_log)
    clipped = -adv * F.exp(clamp(ratio_log, math.log(1 - low), math.log(1 + high)))
    floor = -adv * dual
    upper = F.greatest(plain, clipped)
    return {
        "loss": F.when(adv < 0, F.least(upper, floor)).otherwise(upper), "high_clip": (plain < clipped).cast("double"),
        "low_clip": ((upper > floor) & (adv < 0)).cast("double"), "kl": -ratio_log,
    }


def value_loss(pred: Column, ret: Column, old: Column, clip: float) -> dict[str, Column]:
    """Elementwise terms of the clipped value loss: loss (already halved), clipped."""
    near = clamp(pred, old - clip, old + clip)
    a, b = (pred - ret) * (pred - ret), (near - ret) * (near - ret)
    return {"loss": 0.5 * F.greatest(a, b), "clipped": (a < b).cast("double")}


def log_prob(logits: Column, label: Column) -> Column:
    """Log-probability of an index under logits, stable for large ones."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.element_at(logits, (label + 1).cast("int")) - top - F.log(total)


def dot(a: Column, b: Column) -> Column:
    """Inner product of arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of arrays."""
    return dot(a, b) / (norm(a) * norm(b))


def normalise(v: Column, eps: float = 1e-8) -> Column:
    """``v / (|v| + eps)``."""
    n = norm(v) + eps
    return F.transform(v, lambda x: x.cast("double") / n)


def latent_log_prob(z: Column, mean: Column, sigma: float) -> Column:
    """Gaussian log-density without its constant."""
    d = F.zip_with(z, mean, lambda a, b: (a - b).cast("double"))
    return -0.5 * dot(d, d) / (sigma * sigma)


def resize(width: Column, height: Column, least: int, most: int) -> Column:
    """Struct (width, height) scaled into pixel bounds: the upper first, then the lower; sizes are truncated."""
    def scaled(w: Column, h: Column, limit: int, when: Column) -> tuple[Column, Column]:
        f = F.sqrt(F.lit(float(limit)) / (w * h))
        return F.when(when, (w * f).cast("int")).otherwise(w), F.when(when, (h * f).cast("int")).otherwise(h)

    w, h = scaled(width, height, most, width * height > most)
    w, h = scaled(w, h, least, w * h < least)
    return F.struct(w.alias("width"), h.alias("height"))


def floor_to(x: Column, unit: int) -> Column:
    """Largest multiple of ``unit`` not above ``x``, at least one unit."""
    return F.greatest(F.lit(unit), (F.floor(x / unit) * unit).cast("int"))


def budget_size(width: Column, height: Column, total_area: Column, budget: float) -> Column:
    """Struct (width, height) when the images of a sample share an area budget; unchanged if they fit."""
    f = F.sqrt(F.lit(float(budget)) / total_area)
    fits = total_area <= budget
    return F.struct(F.when(fits, width).otherwise(floor_to(width * f, 28)).alias("width"), F.when(fits, height).otherwise(floor_to(height * f, 28)).alias("height"))


def warmup(step: Column, steps: int) -> Column:
    """Linear warm-up factor."""
    return F.least(F.lit(1.0), step / float(max(1, steps)))


def is_scientific(text: Column) -> Column:
    """Whether a text is a number in scientific notation."""
    return text.rlike(r"^[+-]?\d+(\.\d*)?[Ee][+-]?\d+$")


def flops(sum_tokens: Column, sum_squares: Column, layers: int, hidden: int, inner: int, heads: int, kv_heads: int, vocabulary: int, seconds: Column) -> Column:
    """Achieved tera-operations a second of a decoder, from token counts."""
    head = hidden // heads
    dense = (hidden * inner * 3 + hidden * (heads * head * 2 + kv_heads * head * 2)) * layers + vocabulary * hidden * 2
    return (6.0 * dense * sum_tokens + 12.0 * sum_squares * head * heads * layers) / seconds / 1e12


#: Peak operations a second by device name; the first name that occurs counts.
DEVICE_PEAKS = (("H100", 989e12), ("H800", 989e12), ("A100", 312e12), ("A800", 312e12), ("L40", 181.05e12), ("L20", 119.5e12), ("H20", 148e12), ("910B", 354e12))


def device_peak(name: Column) -> Column:
    """Peak of a device by name; infinite if unknown."""
    out = F.lit(float("inf"))
    for key, peak in reversed(DEVICE_PEAKS):
        out = F.when(name.contains(key), F.lit(peak)).otherwise(out)
    return out
