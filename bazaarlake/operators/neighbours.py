"""Nearest vectors by cosine distance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos of two arrays; null where one is null, empty, a zero vector, or of another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def nearest_to(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, distance) of the k nearest vectors to one; a top-k in every task and one merge."""
    return vectors.select(key, cosine_distance(F.col(vector), F.array(*(F.lit(float(v)) for v in query))).alias("distance")).where("distance is not null").orderBy("distance", key).limit(k)


#: Query vectors of a block and vectors of a chunk; a task multiplies one with the other.
BLOCK, CHUNK = 1_000, 4_000


def _packed(rows: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """(name, name_id, name_v): rows in groups of about ``size``, each group's keys and vectors as two arrays."""
    parts = max(1, -(-rows.count() // size))
    grouped = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias(name)).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias("r"))
    return grouped.select(name, F.col("r.id").alias(f"{name}_id"), F.col("r.v").alias(f"{name}_v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query, rank, key, distance): the k nearest vectors of each query vector but itself, exactly.

    Queries against all vectors, in blocks: every block of queries meets every chunk of vectors in some task, which
    multiplies the two and keeps k per query; the candidates, k per query and chunk, are merged. Nothing comes to the
    driver. Null, empty and zero vectors and those of another length than the query have no distance and are
    none; ties go to the lower key; repeated rows repeat.
    """
    usable = lambda df: df.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(key, vector)
    pairs = _packed(usable(queries), key, vector, block, "b").crossJoin(_packed(usable(vectors), key, vector, chunk, "c"))
    kind = vectors.schema[key].dataType.simpleString()

    def unit(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
        m = np.array([v for v in rows if len(v) == width], np.float64).reshape(-1, width)
        n = np.linalg.norm(m, axis=1)
        at = np.array([j for j, v in enumerate(rows) if len(v) == width], np.int64)
        good = n > 0
        return at[good], m[good] / n[good, None]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, keys, out = np.asarray(r.b_id), np.asarray(r.c_id), []
                for width in sorted({len(v) for v in r.b_v}):
                    q_at, q = unit(r.b_v, width)
                    c_at, m = unit(r.c_v, width)
                    if not len(q_at) or not len(c_at):
                        continue
                    far = 1 - q @ m.T
                    take = np.argpartition(far, min(k, far.shape[1] - 1), axis=1)[:, : k + 1]
                    edge = np.take_along_axis(far, take, 1).max(axis=1)
                    for row, at in enumerate(q_at):
                        found = sorted((far[row, j], keys[c_at[j]]) for j in np.flatnonzero(far[row] <= edge[row]) if keys[c_at[j]] != ids[at])
                        out.extend((ids[at], d, i) for d, i in found[:k])
                yield pd.DataFrame(out, columns=["query", "distance", key])

    best = pairs.mapInPandas(run, f"query {kind}, distance double, `{key}` {kind}")
    # A group has k rows of each chunk at most.
    top = best.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", key))), 1, k).alias("t"))
    return top.select("query", F.posexplode("t").alias("rank", "t")).select("query", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col(f"t.{key}").alias(key), F.col("t.distance").alias("distance"))
