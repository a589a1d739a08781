"""Distances between vectors, as Catalyst expressions and as numpy kernels that agree with them to the last bit.

``l2`` is squared Euclidean and ``euclidean`` its root; ``cosine`` and ``dot`` are 1 minus the similarity. A cosine with a
zero vector is 1. All sums run dimension by dimension in double precision, so every form gives one value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / length)


def _rows(f: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of f over dimensions, in their order; x and y broadcast against each other but for the last axis."""
    out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    for d in range(x.shape[-1]):
        out += f(x[..., d], y[..., d])
    return out


def _np_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    times = lambda a, b: a * b
    length = np.sqrt(_rows(times, x, x)) * np.sqrt(_rows(times, y, y))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length == 0, 1.0, 1 - _rows(times, x, y) / length)


@dataclass(frozen=True)
class Metric:
    """column(a, b): the expression. exact(x, y): row by row. rough(q, x): all pairs by BLAS, equal but for rounding, or None."""

    name: str
    column: Callable[[Column, Column], Column]
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray]
    rough: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


def _rough_l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(axis=1)[:, None] - 2 * (q @ x.T) + (x * x).sum(axis=1)[None], 0)


def _rough_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length == 0, 1.0, 1 - (q @ x.T) / length)


_difference = lambda a, b: (a - b) * (a - b)
_METRICS = {
    m.name: m
    for m in (
        Metric("l2", squared, lambda x, y: _rows(_difference, x, y), _rough_l2),
        Metric("euclidean", lambda a, b: F.sqrt(squared(a, b)), lambda x, y: np.sqrt(_rows(_difference, x, y)), lambda q, x: np.sqrt(_rough_l2(q, x))),
        Metric("cosine", _cosine, _np_cosine, _rough_cosine),
        Metric("dot", lambda a, b: 1 - dot(a, b), lambda x, y: 1 - _rows(lambda a, b: a * b, x, y), lambda q, x: 1 - q @ x.T),
    )
}


def metric(name: str | Metric) -> Metric:
    """A metric by name, or as it is (a metric of one's own)."""
    if isinstance(name, Metric):
        return name
    if name not in _METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(_METRICS))}")
    return _METRICS[name]


def register(own: Metric) -> None:
    """Make a metric known by its name, on the driver and in what is sent to workers."""
    _METRICS[own.name] = own


def unrolled_l2(a: str, b: str, dim: int) -> Column:
    """Squared Euclidean as one arithmetic expression, which stays inside whole-stage code generation."""
    out = F.lit(0.0)
    for d in range(dim):
        gap = F.get(F.col(a), F.lit(d)).cast("double") - F.get(F.col(b), F.lit(d)).cast("double")
        out = out + gap * gap
    return out


def normalized(v: Column | str) -> Column:
    """A vector at unit length; a zero vector stays as it is."""
    v = doubles(v)
    length = norm(v)
    return F.when(length == 0, v).otherwise(F.transform(v, lambda x: x / length))


def engine_info() -> str:
    """Versions of what computes distances."""
    import pyarrow
    import pyspark

    return f"spark {pyspark.__version__}, numpy {np.__version__}, arrow {pyarrow.__version__}"
