"""All pairs of vectors by matrix products: the block form of an all-pairs join whose relation is a dot product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors per block.
BLOCK = 1024
#: Bytes of vectors that a task may hold in a hash table.
HASHED_BYTES = 256 << 20


def dot_pairs(v: DataFrame, n: int, node_id: str, vector: str, source: str, target: str, relation: str, threshold: float, length: int, scale: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(source, target, relation): pairs pos_s < pos_t whose scaled dot product is at least ``threshold`` in size.

    ``v`` has a dense ``__pos``; ``length`` is that of the vectors. Vectors of a block of positions are packed into one row; each pair of blocks is one
    matrix product in an Arrow batch, and only the pairs kept leave it. NULL vectors and
    vectors with a NULL element pair with none. Blocks shrink while there are fewer block pairs than would keep the cores busy.
    """
    g = max(1, math.ceil(n / block), min(12, math.ceil(n / 128)))
    kind = v.schema[node_id].dataType
    at = F.floor(F.col("__pos") * g / max(n, 1)).cast("int")
    fine = v.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    rows = fine.select(at.alias("b"), F.struct("__pos", F.col(node_id).alias("id"), F.col(vector).cast("array<double>").alias("z")).alias("r"))
    packed = rows.groupBy("b").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # at most a block of rows each
    packed = packed.select("b", F.transform("rs", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rs", lambda r: r["z"])).alias("z"))
    b = F.col("b")
    left = packed.select(F.explode(F.transform(F.sequence(b, F.lit(g - 1)), lambda j: b * g + j)).alias("k"), F.col("ids").alias("ids_s"), F.col("z").alias("z_s"))
    right = packed.select(F.explode(F.transform(F.sequence(F.lit(0), b), lambda i: i * g + b)).alias("k"), F.col("ids").alias("ids_t"), F.col("z").alias("z_t"))
    schema = T.StructType([T.StructField(source, kind), T.StructField(target, kind), T.StructField(relation, T.DoubleType())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, key in enumerate(batch["k"].to_pylist()):
                cell = lambda name: batch[name][k].values  # noqa: B023, E731
                ids_s, ids_t = cell("ids_s"), cell("ids_t")
                x = cell("z_s").to_numpy(zero_copy_only=False).reshape(len(ids_s), -1)
                y = cell("z_t").to_numpy(zero_copy_only=False).reshape(len(ids_t), -1)
                product = x @ y.T * scale
                keep = np.abs(product) >= threshold
                if key // g == key % g:
                    keep &= np.triu(np.ones(keep.shape, dtype=bool), 1)
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([ids_s.take(pa.array(i)), ids_t.take(pa.array(j)), pa.array(product[i, j])], names=[source, target, relation])

    # each vector takes part in g block pairs; a hash table can't spill, so a side that might not fit a task is sorted instead
    tasks = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = n * (g + 1) / 2 * 8 * max(1, length) / tasks <= HASHED_BYTES
    joined = left.join(right.hint("shuffle_hash" if fits else "merge"), "k")
    return joined.mapInArrow(multiply, schema)
