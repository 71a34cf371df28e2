"""Element-wise mathematics with the floating point results of an array library.

ANSI mode raises on division by zero and Spark's logarithm gives null for non-positive input; the
functions here return infinity and NaN instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a.isNull(), F.lit(None)).when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NaN for a zero divisor."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.lit(NAN)).otherwise(a - b * F.floor(F.try_divide(a, b)))


def logarithm(x: Column, base: float | None = None) -> Column:
    x = x.cast("double")
    value = F.ln(x) if base is None else (F.log10(x) if base == 10 else F.log2(x) if base == 2 else F.ln(x) / math.log(base))
    return F.when(x > 0, value).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


def truncate(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def is_infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(INF)


def unary(x: Column) -> dict[str, Column]:
    """Every one-argument function by name."""
    x = x.cast("double")
    return {
        "neg": -x,
        "abs": F.abs(x),
        "sign": F.signum(x),
        "square": x * x,
        "sqrt": F.sqrt(x),
        "cbrt": F.cbrt(x),
        "floor": F.floor(x).cast("double"),
        "ceil": F.ceil(x).cast("double"),
        "round": F.rint(x),
        "trunc": truncate(x),
        "exp": F.exp(x),
        "log": logarithm(x),
        "log10": logarithm(x, 10),
        "log2": logarithm(x, 2),
        "sin": F.sin(x),
        "cos": F.cos(x),
        "tan": F.tan(x),
        "asin": F.asin(x),
        "acos": F.acos(x),
        "atan": F.atan(x),
        "sinh": F.sinh(x),
        "cosh": F.cosh(x),
        "tanh": F.tanh(x),
        "asinh": F.asinh(x),
        "acosh": F.acosh(x),
        "atanh": F.atanh(x),
        "degrees": F.degrees(x),
        "radians": F.radians(x),
        "erfinv": erfinv(x),
    }


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


# Giles' single-precision approximation of the inverse error function (2010), highest
# power first, for the central and the tail region.
ERFINV_CENTRE = [
    2.81022636e-08, 3.43273939e-07, -3.5233877e-06, -4.39150654e-06, 0.00021858087,
    -0.00125372503, -0.00417768164, 0.246640727, 1.50140941,
]
ERFINV_TAIL = [
    -0.000200214257, 0.000100950558, 0.00134934322, -0.00367342844, 0.00573950773,
    -0.0076224613, 0.00943887047, 1.00167406, 2.83297682,
]


def erfinv(x: Column) -> Column:
    """Inverse error function; relative error below 1e-6, infinite at +-1, NaN outside."""
    inside = F.abs(x) < 1
    w = -F.ln(F.when(inside, (1 - x) * (1 + x)).otherwise(F.lit(1.0)))
    centre = _polynomial(ERFINV_CENTRE, w - 2.5)
    tail = _polynomial(ERFINV_TAIL, F.sqrt(w) - 3.0)
    value = F.when(w < 5, centre).otherwise(tail) * x
    return F.when(inside, value).when(x == 1, F.lit(INF)).when(x == -1, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


# Fixed values of the self-normalising unit.
SELU_ALPHA = 1.6732632423543772
SELU_SCALE = 1.0507009873554805


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function through the error function series of Abramowitz/Stegun 7.1.26."""
    # Abramowitz and Stegun, formula 7.1.26, highest power first.
    z = F.abs(x) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - _polynomial([1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592], t) * t * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def activations(x: Column, alpha: float = 1.0, leak: float = 0.01, beta: float = 1.0) -> dict[str, Column]:
    """Every activation by name. ``gelu`` uses the distribution function accurate to about 1e-7."""
    x = x.cast("double")
    negative = F.expm1(F.least(x, F.lit(0.0)))
    return {
        "relu": F.greatest(x, F.lit(0.0)),
        "sigmoid": sigmoid(x),
        "tanh": F.tanh(x),
        "softplus": softplus(x),
        "softsign": x / (1 + F.abs(x)),
        "leaky_relu": F.when(x > 0, x).otherwise(leak * x),
        "elu": F.when(x > 0, x).otherwise(alpha * negative),
        "selu": SELU_SCALE * F.when(x > 0, x).otherwise(SELU_ALPHA * negative),
        "gelu": x * normal_cdf(x),
        "swish": x * sigmoid(beta * x),
        "mish": x * F.tanh(softplus(x)),
    }


def prelu(x: Column, slope: Column) -> Column:
    return F.when(x > 0, x).otherwise(slope * x)


def seeded_bits(seed: int, *keys) -> Column:
    """52 bits that depend only on the seed and the keys: the head of the MD5 of their texts, which any engine can repeat."""
    texts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary")), 1, 13), 16, 10).cast("long")


def seeded_uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) that depends only on the seed and the keys."""
    return seeded_bits(seed, *keys) * F.lit(2.0**-52)


def dropout(x: Column, rate: float, seed: int, *keys) -> Column:
    """Zero with probability ``rate``, the rest scaled by ``1 / (1 - rate)``."""
    return F.when(seeded_uniform(seed, *keys) < rate, F.lit(0.0)).otherwise(x / (1.0 - rate))
