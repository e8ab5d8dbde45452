"""Distances between vectors: as columns over arrays, and for whole batches in tasks.

All arithmetic is in doubles. `l1_sqrt` is the square root of the L1 distance, which users of older
clouds know as their L1; `l1` is the plain sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

COSINE_FLOOR = 1e-5


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def sq_l2(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return total(F.zip_with(a, b, square))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sq_l2(a, b))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def l1_sqrt(a: Column, b: Column) -> Column:
    return F.sqrt(l1(a, b))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def sq_norm(a: Column) -> Column:
    return total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def l1_norm(a: Column) -> Column:
    return total(F.transform(a, lambda x: F.abs(x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; the product of norms is held above a floor."""
    return dot(a, b) / F.greatest(F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b)), F.lit(COSINE_FLOOR))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


#: Distances by name, as columns.
COLUMNS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2, "l1": l1, "l1_sqrt": l1_sqrt, "linf": linf, "cosine": cosine_distance}


def _cosine_rows(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((point * point).sum())
    return 1.0 - rows @ point / np.maximum(norms, COSINE_FLOOR)


#: The same distances, of each row of a matrix to one point.
ROWS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l2": lambda rows, point: np.sqrt(((rows - point) ** 2).sum(axis=1)),
    "l1": lambda rows, point: np.abs(rows - point).sum(axis=1),
    "l1_sqrt": lambda rows, point: np.sqrt(np.abs(rows - point).sum(axis=1)),
    "linf": lambda rows, point: np.abs(rows - point).max(axis=1, initial=0.0),
    "cosine": _cosine_rows,
}


BUILT_IN = frozenset(COLUMNS)


def register(name: str, column: Callable[[Column, Column], Column], rows: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Adds a metric of the user's, as a column of two vectors and for the rows of a matrix; both must
    give the same figures. Trees and neighbour searches by the tree need the triangle inequality. A
    name that is taken must be unregistered first."""
    if name in COLUMNS:
        raise ValueError(f"metric {name} is there already")
    COLUMNS[name], ROWS[name] = column, rows


def unregister(name: str) -> None:
    """Takes a metric of the user's out again."""
    if name in BUILT_IN:
        raise ValueError(f"metric {name} is built in")
    COLUMNS.pop(name, None)
    ROWS.pop(name, None)


def rows_to_point(name: str, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Distance of each row to one point; the same figures as the columns give."""
    if name not in ROWS:
        raise ValueError(f"unknown metric {name}")
    return ROWS[name](rows, point)


def pairwise(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """len(a) x len(b) distances. L2 by the product form, precise enough to pick candidates from."""
    if name == "l2":
        sq = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
        return np.sqrt(np.maximum(sq, 0.0))
    return np.stack([rows_to_point(name, b, p) for p in a]) if len(a) else np.zeros((0, len(b)))


def slack(a: np.ndarray, b: np.ndarray) -> float:
    """What a figure of `pairwise` may be off by: its product form loses half the digits of the norms."""
    longest = [float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0)) for x in (a, b)]
    return 1e-9 + 1e-7 * sum(longest)


def sparse_sq_l2(ai: Column, av: Column, bi: Column, bv: Column) -> Column:
    """Of two sparse vectors, as index and value arrays; absent entries are 0."""
    a, b = F.map_from_arrays(ai, doubles(av)), F.map_from_arrays(bi, doubles(bv))
    return total(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.pow(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), 2))))


def sparse_l2(ai: Column, av: Column, bi: Column, bv: Column) -> Column:
    return F.sqrt(sparse_sq_l2(ai, av, bi, bv))


def sparse_l1(ai: Column, av: Column, bi: Column, bv: Column) -> Column:
    a, b = F.map_from_arrays(ai, doubles(av)), F.map_from_arrays(bi, doubles(bv))
    return total(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))))


def sparse_l1_sqrt(ai: Column, av: Column, bi: Column, bv: Column) -> Column:
    return F.sqrt(sparse_l1(ai, av, bi, bv))


def sparse_dot(ai: Column, av: Column, bi: Column, bv: Column) -> Column:
    a, b = F.map_from_arrays(ai, doubles(av)), F.map_from_arrays(bi, doubles(bv))
    return total(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x * y, F.lit(0.0)))))


def sparse_cosine_distance(ai: Column, av: Column, bi: Column, bv: Column) -> Column:
    return F.lit(1.0) - sparse_dot(ai, av, bi, bv) / F.greatest(F.sqrt(sq_norm(av)) * F.sqrt(sq_norm(bv)), F.lit(COSINE_FLOOR))


#: Distances of sparse vectors by name, as columns of index and value arrays. Norms of sparse vectors are
#: sq_norm and l1_norm of their values.
SPARSE = {"l2": sparse_l2, "l1": sparse_l1, "l1_sqrt": sparse_l1_sqrt, "cosine": sparse_cosine_distance}


def densify(dim: Column | int, index: Column, value: Column) -> Column:
    """The whole vector of `dim` entries of a sparse one."""
    n = F.lit(dim) if isinstance(dim, int) else dim
    entries = F.map_from_arrays(index, doubles(value))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.element_at(entries, i.cast("int")), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))
