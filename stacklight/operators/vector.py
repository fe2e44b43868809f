"""Cosine search over unit vectors: single queries as expressions, query sets in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer

from ..session import cut, spread

#: Bytes of query vectors that one pass over the index may carry to every task.
BLOCK_BYTES = 64 << 20


def dot(vector: Column, query: list[float]) -> Column:
    """Dot product in double precision, rounded so that ties are ties everywhere. Null for a null vector."""
    other = F.array(*[F.lit(float(x)) for x in query])
    product = F.aggregate(F.zip_with(vector, other, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return F.round(product, 6)


def nearest(index: DataFrame, query: list[float], k: int, predicate: Column | None = None, key: str = "id", vector: str = "vec") -> DataFrame:
    """(key, score, rank): the k rows nearest to a unit vector among those the predicate admits.

    Score descending, then key. The predicate is pushed into the scan, only key, vector and
    the predicate's columns are read, and each task keeps k rows.
    """
    rows = index.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = rows if predicate is None else rows.where(predicate)
    best = rows.select(F.col(key), dot(F.col(vector), query).alias("score")).orderBy(F.desc("score"), F.asc(key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))))


def nearest_many(index: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vec", query_key: str = "query_id", keep_self: bool = True) -> DataFrame:
    """(query_id, key, score, rank): the k nearest rows of each query vector.

    queries: (query_id, vector). Query vectors go out in blocks of at most BLOCK_BYTES, one after the other: the driver
    and every task hold one block at a time, and each block's result is written before the next. A
    task multiplies whole batches of rows with the block and keeps k rows per query, so the shuffle carries k rows per
    query and task. A query meets the rows whose vectors have its own length; rows and queries with null keys
    or vectors take no part.
    """
    q = queries.where(F.col(query_key).isNotNull() & F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).alias("v"))
    size = q.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v") * 8 + 64).alias("bytes")).first()
    rows = spread(index.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v")))
    kind = index.schema[key].dataType.simpleString()
    q_kind = queries.schema[query_key].dataType.simpleString()
    schema = f"q {q_kind}, key {kind}, score double"
    blocks = -(-(size["bytes"] or 0) // BLOCK_BYTES)
    # hashing spreads queries evenly over blocks without ordering them
    numbered = q.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(blocks, 1))))
    parts = [_block(rows, numbered.where(F.col("block") == b).drop("block"), k if keep_self else k + 1, schema) for b in range(blocks)]
    found = parts[0] if parts else index.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        found = found.unionByName(p)
    if not keep_self:
        found = found.where(~F.col("q").cast("string").eqNullSafe(F.col("key").cast("string")))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "rank")


def _block(rows: DataFrame, queries: DataFrame, k: int, schema: str) -> DataFrame:
    got = queries.collect()  # at most about BLOCK_BYTES
    by_width: dict[int, tuple[list, np.ndarray]] = {}
    for width in {len(r["v"]) for r in got}:
        same = [r for r in got if len(r["v"]) == width]
        by_width[width] = ([r["q"] for r in same], np.array([r["v"] for r in same], np.float64).reshape(len(same), width))
    shared = rows.sparkSession.sparkContext.broadcast(by_width)
    q_type = queries.schema["q"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {w: [[] for _ in names] for w, (names, _) in shared.value.items()}
        limits = {w: np.full(len(names), -np.inf) for w, (names, _) in shared.value.items()}
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            vectors = batch.column(1)
            lengths = np.asarray(vectors.value_lengths())
            for width, (_, matrix) in shared.value.items():
                at = np.flatnonzero(lengths == width)
                if not len(at):
                    continue
                keys = batch.column(0).take(pa.array(at)).to_pylist()
                table = np.array(vectors.take(pa.array(at)).to_pylist(), np.float64).reshape(len(at), width)
                scores = np.round(matrix @ table.T, 6)
                # only rows that reach a query's k-th best so far can enter; ties stay until keys decide
                reach = scores >= limits[width][:, None]
                for i in np.flatnonzero(reach.any(axis=1)):
                    row = scores[i]
                    some = np.flatnonzero(reach[i])
                    if len(some) > k:
                        some = some[row[some] >= np.partition(row[some], len(some) - k)[len(some) - k]]
                    best[width][i] = sorted(best[width][i] + [(-float(row[j]), keys[j]) for j in some])[:k]
                    if len(best[width][i]) == k:
                        limits[width][i] = -best[width][i][-1][0]
        if key_type is not None:
            out = [(n, key, -s) for w, (names, _) in shared.value.items() for n, rows_ in zip(names, best[w]) for s, key in rows_]
            kinds = [pa.int64() if q_type == "bigint" else pa.int32() if q_type == "int" else pa.string(), key_type, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["q", "key", "score"])

    found = cut(rows.mapInArrow(run, schema))
    shared.destroy()
    return found


def hashed_embedding(df: DataFrame, text: str, dimensions: int = 256, out: str = "vec") -> DataFrame:
    """A deterministic stand-in for an embedding model: hashed word counts of unit length.

    Null and blank texts are refused by dropping the row, as a model would refuse them.
    """
    some = df.where(F.trim(text) != "")
    words = Tokenizer(inputCol=text, outputCol="__w").transform(some)
    counted = HashingTF(numFeatures=dimensions, inputCol="__w", outputCol="__c").transform(words)
    return Normalizer(inputCol="__c", outputCol=out).transform(counted).drop("__w", "__c")
