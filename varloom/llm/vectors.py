"""Integer vectors, which the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A component's integer stays within this, so that sums of products of up to 64 components fit a long.
LARGEST = 1 << 27


def usable(vector: str) -> Column:
    """True for a vector that is neither null nor holds a null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component x, taken as double."""

    def one(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x.cast("double") * float(scale), F.lit(float(LARGEST))), F.lit(float(-LARGEST))))

    return F.transform(vector, one)


def written(rows: DataFrame, vector: str, scale: int, keep: list[Column], tables: common.Tables) -> tuple[DataFrame, int, int]:
    """A table of rows with usable vectors: keep, rid (a number of its own for each row) and ints; the largest length and absolute component.

    Shorter vectors count as filled up with zeros.
    """
    df = rows.filter(usable(vector)).select(*keep, F.monotonically_increasing_id().alias("rid"), integers(vector, scale).alias("ints"))
    df = tables.write(df, "vectors")
    top = F.greatest(F.abs(F.array_max("ints")), F.abs(F.array_min("ints")))
    width, most = df.agg(F.coalesce(F.max(F.size("ints")), F.lit(0)), F.coalesce(F.max(top), F.lit(0))).first()
    return df, int(width), int(most)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, filled up with zeros to width."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def kind_for(most: int) -> str:
    """The smallest little-endian type that holds components up to most."""
    return "<i2" if most < 1 << 15 else "<i4"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as whole numbers: through floats where these are exact, else by integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)
