"""Integer vectors for the searches: validity, quantisation, numbered rows, bounded blocks, Arrow to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiccases.llm.common import saved

#: components (rows times dimension) of one block; bounds what a task holds
BLOCK_VALUES = 1 << 20
#: stands for a missing vec_id, so that such rows come last among ties
NO_ID = 2 ** 63 - 1


def whole_vectors(embeddings: DataFrame, scale: int, *columns: Column) -> DataFrame:
    """(row, vec_id, v, columns): rows with a vector of finite components only, v = floor(scale * component).

    Stored; ``row`` numbers the stored rows, so it is the same in every later job.
    """
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    kept = saved(embeddings.where(F.col("embedding").isNotNull() & good)
                 .select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v"), *columns), "vectors")
    return kept.withColumn("row", F.monotonically_increasing_id())


def extent(vectors: DataFrame, factor: int) -> tuple[int, int]:
    """(rows, dimension); an ArithmeticError if ``factor`` times an inner product may not fit into 64 bits."""
    n, dim, low, high = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")),
                                    F.max(F.array_max("v"))).first()
    most = max(abs(low or 0), abs(high or 0))
    if factor * (dim or 0) * most * most >= 2 ** 63:
        raise ArithmeticError(f"inner products of components up to {most} may exceed 64 bits")
    return n, dim or 0


def block_rows(dim: int, values: int = BLOCK_VALUES) -> int:
    return max(1, values // max(1, dim))


def block_of(row: Column, blocks: int) -> Column:
    """A block's number; rows are spread evenly, so a block has about the mean number of rows."""
    return F.pmod(F.xxhash64(row), F.lit(blocks)).cast("long")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists as an int64 matrix; shorter ones are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def numbers(column: pa.Array | pa.ChunkedArray, kind=np.int64) -> np.ndarray:
    return column.to_numpy().astype(kind, copy=False)
