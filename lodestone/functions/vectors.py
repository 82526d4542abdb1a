"""Scalar functions on vectors, as Catalyst expressions in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.types import NORM_TOLERANCE


def dot(a: Column, b: Column) -> Column:
    """Sum of products in index order; null where lengths differ or anything is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clamped to [-1, 1]; null for vectors of other lengths, or of zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    # least() and greatest() skip null, so they are asked only where there is a value.
    return F.when((norms > 0) & dot(a, b).isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def l2_normalize(v: Column) -> Column:
    """Unit vector as float32, divided in double precision; null for zero, null or non-finite."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(squared_norm(v))
    usable = norm.isNotNull() & ~F.isnan(norm) & (norm > 0) & (norm < float("inf"))
    return F.when(usable, F.transform(wide, lambda x: (x / norm).cast("float")))


def is_valid(v: Column, dimensions: Column) -> Column:
    """Of these dimensions, finite, and of unit norm within the tolerance; never null."""
    norm = squared_norm(v)
    return F.coalesce((F.size(v) == dimensions) & ~F.isnan(norm) & (F.abs(norm - 1) <= NORM_TOLERANCE), F.lit(False))


def vector_bytes(v: list) -> bytes:
    return np.asarray(v, "<f4").tobytes()


@F.pandas_udf(T.StringType())
def vector_sha256(vectors: pd.Series) -> pd.Series:
    """Digest of the little-endian float32 values; null for null."""
    return vectors.map(lambda v: None if v is None else hashlib.sha256(vector_bytes(v)).hexdigest())

