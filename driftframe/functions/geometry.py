"""Vector algebra as column expressions: all of it stays in generated code.

A vector is a sequence of three columns; a cell is a sequence of three such rows (lattice vectors). The
entries of a constant cell are plain numbers: its inverse is then computed once, and products with its
zeros never reach the plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

Entry = Column | float
Vector = Sequence[Entry]
AXES = ("x", "y", "z")
#: Column names of a cell, row by row.
CELL = tuple(f"{row}{axis}" for row in "abc" for axis in AXES)


def vector(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def cell_of(prefix: str = "") -> list[list[Column]]:
    """The cell in columns ax..cz."""
    return [[F.col(prefix + n) for n in CELL[3 * i : 3 * i + 3]] for i in range(3)]


def constant_cell(rows: Sequence[Sequence[float]]) -> list[list[float]]:
    return [[float(v) for v in row] for row in rows]


def _number(x: Entry) -> bool:
    return not isinstance(x, Column)


def product_of(a: Entry, b: Entry) -> Entry:
    """a * b, without a multiplication by 0 or 1."""
    for x, y in ((a, b), (b, a)):
        if _number(x):
            return x * y if _number(y) else 0.0 if x == 0 else y if x == 1 else y * F.lit(x)
    return a * b


def total(terms: Sequence[Entry]) -> Entry:
    """The sum, without zeros."""
    numbers = sum(t for t in terms if _number(t))
    columns = [t for t in terms if not _number(t)]
    if not columns:
        return numbers
    out = columns[0]
    for t in columns[1:]:
        out = out + t
    return out + F.lit(numbers) if numbers else out


def column(x: Entry) -> Column:
    return F.lit(float(x)) if _number(x) else x


def root(x: Entry) -> Entry:
    return math.sqrt(x) if _number(x) else F.sqrt(x)


def dot(a: Vector, b: Vector) -> Entry:
    return total([product_of(x, y) for x, y in zip(a, b)])


def norm2(a: Vector) -> Entry:
    return dot(a, a)


def norm(a: Vector) -> Entry:
    return root(norm2(a))


def cross(a: Vector, b: Vector) -> list[Entry]:
    return [total([product_of(a[(i + 1) % 3], b[(i + 2) % 3]), product_of(-1.0, product_of(a[(i + 2) % 3], b[(i + 1) % 3]))]) for i in range(3)]


def det(cell: Sequence[Vector]) -> Entry:
    """Signed volume of a cell."""
    return dot(cell[0], cross(cell[1], cell[2]))


def inverse(cell: Sequence[Vector]) -> list[list[Entry]]:
    """Rows of the inverse matrix: the adjugate over the determinant."""
    volume = det(cell)
    columns = [cross(cell[(i + 1) % 3], cell[(i + 2) % 3]) for i in range(3)]
    return [[columns[j][i] / volume for j in range(3)] for i in range(3)]


def times(v: Vector, matrix: Sequence[Vector]) -> list[Entry]:
    """Row vector times matrix."""
    return [total([product_of(v[i], matrix[i][j]) for i in range(3)]) for j in range(3)]


def wrap(c: Column) -> Column:
    """Into [0, 1), as a floor modulo."""
    return c - F.floor(c)


def truncated(c: Column) -> Column:
    """Remainder by 1 that keeps the sign of its argument."""
    return c % F.lit(1.0)


def nearest(c: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.round(c, 0)


def fractional(v: Vector, cell: Sequence[Vector]) -> list[Entry]:
    return times(v, inverse(cell))


def right_angled(cell: Sequence[Sequence[float]]) -> bool:
    return not any(cell[i][j] for i in range(3) for j in range(3) if i != j)


def folded(v: Vector, cell: Sequence[Vector]) -> list[Column]:
    """A position moved into the cell."""
    return times([wrap(f) for f in fractional(v, cell)], cell)


def nearest_corner(fraction: Vector, cell: Sequence[Vector], orthorhombic: bool = False) -> Column:
    """Distance of a wrapped fractional difference to the nearest of the cell's eight corners.

    For axes at right angles the nearest corner is found axis by axis.
    """
    if orthorhombic:
        along = [product_of(F.least(f, 1 - f), cell[i][i]) for i, f in enumerate(fraction)]
        return norm(along)
    squares = [norm2(times([f - F.lit(k) if k else f for f, k in zip(fraction, corner)], cell)) for corner in product((0.0, 1.0), repeat=3)]
    return F.sqrt(F.least(*squares))


def angle(a: Vector, b: Vector) -> Column:
    """In degrees; the cosine is clamped, so that parallel vectors give no NaN."""
    cosine = dot(a, b) / F.sqrt(norm2(a) * norm2(b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def log_scaled(v: Vector, least: float = 1e-8) -> list[Column]:
    """ln(|v| + 2)/|v| times v; shorter vectors than ``least`` stay."""
    size = norm(v)
    return [F.when(size < least, c).otherwise(F.ln(size + 2) / F.greatest(size, F.lit(least)) * c) for c in v]


def histogram_bin(value: Column, width: float, bins: int) -> Column:
    """Bin number of a value in [0, bins*width]; the last bin holds its upper edge."""
    return F.least(F.floor(value / F.lit(width)), F.lit(bins - 1)).cast("int")
