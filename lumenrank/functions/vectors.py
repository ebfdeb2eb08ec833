"""Row vectors as array columns: every function maps Columns to a Column and stays inside the JVM.

Similarities add up in double. Denominators that can be zero are guarded, as ANSI mode raises on division by zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    """Sum of an array of doubles; 0 if it is empty."""
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _over(v: Column, value: Column, body) -> Column:
    """body(v, value), with value computed once rather than for every element."""
    return F.element_at(F.transform(F.array(value), lambda s: body(v, s)), 1)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    base = norm(a) * norm(b)
    return F.when(base == 0, 0.0).otherwise(dot(a, b) / F.when(base == 0, 1.0).otherwise(base))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector is unchanged. `rmsnorm` in the tensor language is this same function."""
    return _over(v, norm(v), lambda w, n: F.transform(w, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / F.when(n == 0, 1.0).otherwise(n))))


rmsnorm = normalize


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Shifted by the maximum; a temperature of 0 or less counts as 1."""
    t = temperature if temperature > 0 else 1.0
    shifted = _over(doubles(v), F.array_max(doubles(v)), lambda w, m: F.transform(w, lambda x: F.exp((x - m) / t)))
    return _over(shifted, total(shifted), lambda w, s: F.transform(w, lambda x: x / s))


def layernorm(v: Column, eps: float = 1e-5) -> Column:
    """Population variance, no affine part."""
    n = F.greatest(F.size(v), F.lit(1)).cast("double")
    mean = total(doubles(v)) / n
    centred = _over(doubles(v), mean, lambda w, m: F.transform(w, lambda x: x - m))
    return _over(centred, F.sqrt(dot(centred, centred) / n + eps), lambda w, d: F.transform(w, lambda x: x / d))


def gelu(x: Column) -> Column:
    """The tanh approximation."""
    x = x.cast("double")
    return 0.5 * x * (1 + F.tanh(0.7978845608 * (x + 0.044715 * x * x * x)))


def rope(v: Column, position: Column) -> Column:
    """Rotary embedding of a row: pairs (c, c + 1) turn by position / 10000^(c / size)."""
    n = F.size(v)

    def at(i: Column) -> Column:
        c = i - i % 2
        angle = position.cast("double") / F.pow(F.lit(10000.0), c / n)
        x, y = F.get(v, c).cast("double"), F.coalesce(F.get(v, c + 1).cast("double"), F.lit(0.0))
        turned = F.when(i % 2 == 0, x * F.cos(angle) - y * F.sin(angle)).otherwise(x * F.sin(angle) + y * F.cos(angle))
        return F.when(c + 1 >= n, x).otherwise(turned)

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def prefix(v: Column, dims: int) -> Column:
    """The first dims components, at unit length again."""
    return normalize(F.slice(v, 1, dims))


def elementwise(op: str, a: Column, b: Column) -> Column:
    """+ - * / of two rows of one shape; x / 0 is infinite or NaN as IEEE has it."""

    def divide(x: Column, y: Column) -> Column:
        special = F.when(x.isNull() | F.isnan(x) | (x == 0), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        return F.when(y == 0, special).otherwise(x / F.when(y == 0, 1.0).otherwise(y))

    ops = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": divide}
    return F.zip_with(a, b, lambda x, y: ops[op](x.cast("double"), y.cast("double")))


def fake_quantize(v: Column, bits: int, largest: Column) -> Column:
    """Symmetric quantisation to bits and back; scale = largest / (2^(bits-1) - 1), halves away from zero."""
    levels = float((1 << (bits - 1)) - 1)
    scale = largest.cast("double") / levels
    return F.transform(v, lambda x: F.when(largest == 0, 0.0).otherwise(F.round(x.cast("double") / F.when(largest == 0, 1.0).otherwise(scale)) * scale))


def mean_pool(rows: Column, mask: Column | None = None) -> Column:
    """Mean of an array of rows where the mask is not 0; all zeros if nothing is left."""
    kept = rows if mask is None else F.transform(F.filter(F.arrays_zip(rows.alias("r"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["r"])
    n = F.size(kept)
    zeros = F.transform(F.get(rows, F.lit(0)), lambda x: F.lit(0.0))
    summed = F.aggregate(kept, zeros, lambda s, r: F.zip_with(s, r, lambda x, y: x + y.cast("double")))
    return F.transform(summed, lambda x: F.when(n == 0, 0.0).otherwise(x / F.greatest(n, F.lit(1))))


def qnorm_encode(norm_value: Column) -> Column:
    """A positive norm as one byte over ln in [-16, 16]."""
    ln = F.ln(F.greatest(norm_value.cast("double"), F.lit(math.exp(-16))))
    return F.round((F.least(F.greatest(ln, F.lit(-16.0)), F.lit(16.0)) + 16) / 32 * 255).cast("int")


def qnorm_decode(code: Column) -> Column:
    return F.exp(code.cast("double") / 255 * 32 - 16)


def erf(x: Column) -> Column:
    """Error function by a rational approximation (absolute error below 1.5e-7)."""
    a = F.abs(x.cast("double"))
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x.cast("double")) * (1 - poly * F.exp(-a * a))
