"""Arrays of any number of dimensions as tables (i0, i1, ..., v): reshaping, transposing, reducing, broadcasting.

Absent cells are absent, so sparse arrays cost what they hold.
"""

from __future__ import annotations

from collections.abc import Callable
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the side that is sent to all tasks where two arrays share no dimension, at most.
OUTER_CELLS = 1_000_000


def _axes(n: int) -> list[str]:
    return [f"i{d}" for d in range(n)]


def flat_position(shape: list[int]) -> Column:
    """Row-major position of (i0, i1, ...)."""
    out = F.lit(0).cast("long")
    for c, n in zip(_axes(len(shape)), shape, strict=True):
        out = out * n + F.col(c)
    return out


def place(position: Column, shape: list[int]) -> list[Column]:
    """The indices of a row-major position, named i0, i1, ..."""
    return [(F.floor(position / prod(shape[d + 1 :])) % n).cast("long").alias(f"i{d}") for d, n in enumerate(shape)]


def reshape(a: DataFrame, old: list[int], new: list[int]) -> DataFrame:
    """The same cells in another shape of the same size; one of ``new`` may be -1."""
    if new.count(-1) == 1:
        rest = prod(n for n in new if n != -1)
        new = [prod(old) // rest if n == -1 and rest else n for n in new]
    if prod(old) != prod(new):
        raise ValueError(f"{old} and {new} differ in size")
    return a.select(flat_position(old).alias("__at"), "v").select(*place(F.col("__at"), new), "v")


def permute(a: DataFrame, axes: list[int]) -> DataFrame:
    """Dimension d of the result is dimension axes[d] of ``a``."""
    if sorted(axes) != list(range(len(axes))):
        raise ValueError(f"not a permutation: {axes}")
    return a.select(*[F.col(f"i{x}").alias(f"i{d}") for d, x in enumerate(axes)], "v")


def reduce(a: DataFrame, dims: int, axes: list[int], how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """An aggregate over ``axes``, which go."""
    left = [d for d in range(dims) if d not in axes]
    return a.groupBy(*[F.col(f"i{x}").alias(f"i{d}") for d, x in enumerate(left)]).agg(how(F.col("v")).alias("v"))


def combine(a: DataFrame, shape_a: list[int], b: DataFrame, shape_b: list[int], how: Callable[[Column, Column], Column]) -> tuple[DataFrame, list[int]]:
    """Cellwise ``how`` with broadcasting, and the shape of the result; cells that one side lacks are absent.

    Shapes are matched from the last dimension on and a 1 goes with any size. The
    join is on the dimensions that both sides have in full; without any, one side
    must be of OUTER_CELLS cells at most, which is checked.
    """
    dims = max(len(shape_a), len(shape_b))
    wide = lambda shape: [1] * (dims - len(shape)) + list(shape)
    sa, sb = wide(shape_a), wide(shape_b)
    if any(x != y and 1 not in (x, y) for x, y in zip(sa, sb, strict=True)):
        raise ValueError(f"shapes {shape_a} and {shape_b} do not go together")
    moved = lambda df, shape, side: df.select(*[F.col(f"i{d}").alias(f"{side}{d + dims - len(shape)}") for d in range(len(shape))], F.col("v").alias(f"{side}v"))
    left, right = moved(a, shape_a, "l"), moved(b, shape_b, "r")
    shared = [d for d in range(dims) if d >= dims - min(len(shape_a), len(shape_b)) and sa[d] == sb[d] and sa[d] > 1]
    if shared:
        both = left.join(right, [F.col(f"l{d}") == F.col(f"r{d}") for d in shared])
    elif right.limit(OUTER_CELLS + 1).count() <= OUTER_CELLS:
        both = left.crossJoin(F.broadcast(right))
    elif left.limit(OUTER_CELLS + 1).count() <= OUTER_CELLS:
        both = right.crossJoin(F.broadcast(left))
    else:
        raise ValueError(f"no dimension in common and more than {OUTER_CELLS} cells on both sides")
    has = set(both.columns)
    index = [F.col(f"l{d}" if f"l{d}" in has and (sa[d] > 1 or f"r{d}" not in has) else f"r{d}").alias(f"i{d}") for d in range(dims)]
    return both.select(*index, how(F.col("lv"), F.col("rv")).alias("v")), [max(x, y) for x, y in zip(sa, sb, strict=True)]
