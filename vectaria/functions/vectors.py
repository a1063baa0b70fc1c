"""Scalar vector functions as column expressions, and checks of vector columns.

Distances are squared Euclidean, in double, summed in order of position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _double(x: Column) -> Column:
    return x.cast("double")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)


def l2_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y))))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)))


def norm_sq(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: _double(x) * _double(x)))


def l2_precomp(q_sq: Column, v_sq: Column, dot: Column) -> Column:
    """Squared distance from squared norms and the inner product."""
    return q_sq + v_sq - 2 * dot


def l2_normalize(v: Column) -> Column:
    """Unit vector; a norm of at most 1e-10 gives the zero vector."""
    norm = F.sqrt(norm_sq(v))
    return F.when(norm <= 1e-10, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: _double(x) / norm))


def scan_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(vec_id, embedding) of a table; the schema is checked here, each row when it is read.

    A null vector, a null element or another length raises an error that names the dimension.
    """
    kind = df.schema[vec_col].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise ValueError(f"{vec_col} must be an array of numbers, not {kind.simpleString()}")
    v = F.col(vec_col).cast("array<float>")
    bad = v.isNull() | (F.size(v) != dim) | F.exists(v, lambda x: x.isNull())
    checked = F.when(bad, F.raise_error(F.lit(f"expected vectors of {dim} numbers without nulls")).cast("array<float>")).otherwise(v)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), checked.alias("embedding"))


def check_dimension(df: DataFrame, vec_col: str, dim: int) -> None:
    """Raises ValueError if some vector of ``df`` is null, has nulls or another length than ``dim``."""
    v = F.col(vec_col)
    bad = v.isNull() | (F.size(v) != dim) | F.exists(v, lambda x: x.isNull())
    if not df.where(bad).limit(1).isEmpty():
        raise ValueError(f"expected vectors of {dim} numbers without nulls")
