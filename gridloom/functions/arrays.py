"""Column functions on packed arrays (one array per row), all evaluated inside the JVM.

A lambda body is evaluated once per element, so anything that does not depend on the element is
computed first and bound with :func:`let`. A plain column is bound too: the optimizer may put the expression
behind it into the lambda when it merges projections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def product(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(1.0), lambda acc, x: acc * x)


def mean(arr: Column) -> Column:
    return let(arr, lambda a: total(a) / F.nullif(F.size(a), F.lit(0)))


def norm(arr: Column, order: int = 2) -> Column:
    if order == 1:
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    if order == 2:
        return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * x))
    powered = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.pow(F.abs(x), F.lit(float(order))))
    return F.pow(powered, F.lit(1.0 / order))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def arg_max(arr: Column) -> Column:
    """0-based position of the first largest element."""
    return F.array_position(arr, F.array_max(arr)).cast("int") - 1


def arg_min(arr: Column) -> Column:
    return F.array_position(arr, F.array_min(arr)).cast("int") - 1


def arg_sort(arr: Column, ascending: bool = True) -> Column:
    """0-based positions in sorted order; equal values keep their order."""
    if ascending:
        keyed = F.transform(arr, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    else:
        keyed = F.transform(arr, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.sort_array(keyed), lambda s: s["i"])


def log_softmax(arr: Column) -> Column:
    return let(
        F.array_max(arr),
        lambda top: let(
            F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)),
            lambda mass: F.transform(arr, lambda x: x - top - F.ln(mass)),
        ),
    )


def softmax(arr: Column) -> Column:
    return let(
        F.array_max(arr),
        lambda top: let(
            F.transform(arr, lambda x: F.exp(x - top)),
            lambda powers: let(total(powers), lambda mass: F.transform(powers, lambda p: p / mass)),
        ),
    )


def layer_norm(arr: Column, epsilon: float = 1e-5) -> Column:
    return let(
        mean(arr),
        lambda m: let(
            F.sqrt(mean(F.transform(arr, lambda x: (x - m) * (x - m))) + F.lit(epsilon)),
            lambda spread: F.transform(arr, lambda x: (x - m) / spread),
        ),
    )


def one_hot(index: Column, width: int, on: float = 1.0, off: float = 0.0) -> Column:
    places = F.sequence(F.lit(0), F.lit(width - 1))
    return let(index, lambda at: F.transform(places, lambda i: F.when(i == at, F.lit(float(on))).otherwise(F.lit(float(off)))))


def pick(arr: Column, index: Column) -> Column:
    """Element at a 0-based index column; a negative index counts from the end."""
    return F.element_at(arr, F.when(index < 0, index).otherwise(index + 1).cast("int"))


def stepped(arr: Column, start: int = 0, stop: int | None = None, step: int = 1) -> Column:
    """``start:stop:step`` with negative bounds counted from the end."""

    def cut(size: Column) -> Column:
        first = F.lit(start) if start >= 0 else size + start
        last = size if stop is None else (F.lit(stop) if stop >= 0 else size + stop)
        return F.filter(arr, lambda x, i: (i >= first) & (i < last) & ((i - first) % step == 0))

    return let(F.size(arr), cut)


def masked(arr: Column, mask: Column) -> Column:
    """Elements whose mask entry is true."""
    return let(mask, lambda m: F.filter(arr, lambda x, i: F.get(m, i)))


def set_where(arr: Column, condition: Callable[[Column, Column], Column], value: Column) -> Column:
    """Replace the elements for which ``condition(element, position)`` holds."""
    return let(value, lambda v: F.transform(arr, lambda x, i: F.when(condition(x, i), v).otherwise(x)))


def sequence_mask(arr: Column, length: Column, value: float = 0.0) -> Column:
    """Elements at positions from ``length`` on become ``value``."""
    return let(length, lambda n: F.transform(arr, lambda x, i: F.when(i < n, x).otherwise(F.lit(value))))


def nonzero(arr: Column) -> Column:
    """Positions of elements that are not zero."""
    return F.filter(
        F.transform(arr, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull()
    )


def clip(col: Column, low, high) -> Column:
    return F.greatest(F.least(col, F.lit(high)), F.lit(low))


def tile(arr: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(arr, times))


def repeat_each(arr: Column, times: int) -> Column:
    return F.flatten(F.transform(arr, lambda x: F.array_repeat(x, times)))


def like(arr: Column, value: float) -> Column:
    return F.transform(arr, lambda _: F.lit(float(value)))


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    """True if both arrays have the same size and every pair is close."""

    def near(x: Column, y: Column) -> Column:
        ok = F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)
        ok = (~F.isnan(x) & ~F.isnan(y) & ok) | (x == y)
        if not equal_nan:
            return ok & ~F.isnan(x) & ~F.isnan(y)
        return ok | (F.isnan(x) & F.isnan(y))

    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, near), lambda ok: ok)


def pad(arr: Column, value: Column, width: Column | int) -> Column:
    """Append ``value`` until the array has ``width`` elements; longer arrays stay."""
    width = F.lit(width) if isinstance(width, int) else width
    return let(arr, lambda a: F.concat(a, F.array_repeat(value, F.greatest(F.lit(0), width - F.size(a)).cast("int"))))


def fit(arr: Column, value: Column, width: int) -> Column:
    """Cut or pad to exactly ``width`` elements."""
    return F.slice(F.concat(arr, F.array_repeat(value, width)), 1, width)


def section_equal(position: Column, size: Column, parts: int) -> Column:
    """Section number when an axis is split into equal parts."""
    return F.floor(position * parts / size).cast("int")


def section_at(position: Column, cuts: list[int]) -> Column:
    """Section number when an axis is split before the given positions."""
    out = F.lit(0)
    for cut in cuts:
        out = out + (position >= cut).cast("int")
    return out


def top_k(classes: Column, probs: Column, k: int) -> Column:
    """The ``k`` most probable (class, prob) pairs, ties by position."""
    pairs = F.zip_with(classes, probs, lambda c, p: F.struct((-p).alias("key"), c.alias("class")))
    placed = F.transform(pairs, lambda s, i: F.struct(s["key"].alias("key"), i.alias("i"), s["class"].alias("class")))
    return F.transform(
        F.slice(F.sort_array(placed), 1, k), lambda s: F.struct(s["class"].alias("class"), (-s["key"]).alias("prob"))
    )
