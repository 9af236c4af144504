"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are kept in blocks; a block holds its vectors and, for each dimension, their places sorted by
that component. A query walks the lists from the end its sign favours, some places of all lists at a
time, scores each vector it meets, and stops as soon as the sum of its components' products at the
depth reached is below the kth score it holds: nothing unseen can then enter, not even by a tie. The
kth score found in one block is the first bound for the next.

Null vectors and those with a null, NaN or infinite component take no part, nor do rows without a
vec_id. Queries meet candidates of their own dimension only; an empty vector scores 0. A query's own
rows are those with its vec_id. Repeated candidate rows count each, repeated query rows once; queries that share a
vec_id but not a vector are ranked each by itself. Ties go to the smaller vec_id. Empty tables give an empty one. Scaled
components are int64, scores exact as long as they fit into 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import partitions
from strandwise.session import written

SCALE = 1024
BLOCK, QUERY_BLOCK = 8192, 512
#: Places read from each list in a query's first round; doubled each time.
FIRST_DEPTH = 16


def scaled(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def usable(df: DataFrame) -> DataFrame:
    """vec_id and integer components of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("x"))


def packed_blocks(frames: Iterator[pd.DataFrame], most: int, lists: bool) -> Iterator[pd.DataFrame]:
    """Rows of one dimension, at most so many a block, as (dim, n, ids, matrix, lists)."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def block(dim: int, rows: list) -> pd.DataFrame:
        ids = np.concatenate([i for i, _ in rows])
        x = np.concatenate([m for _, m in rows])
        order = np.argsort(x, axis=0, kind="stable").astype("<u2").tobytes() if lists else b""
        return pd.DataFrame({"dim": [dim], "n": [len(ids)], "ids": [ids.astype("<i8").tobytes()], "matrix": [x.astype("<i8").tobytes()], "lists": [order]})

    for frame in frames:
        sizes = frame["x"].map(len).to_numpy()
        for dim in np.unique(sizes):
            part = frame[sizes == dim]
            ids = part["vec_id"].to_numpy(np.int64)
            x = np.stack([np.asarray(v, np.int64) for v in part["x"]]) if dim else np.zeros((len(ids), 0), np.int64)
            rows = held.setdefault(int(dim), [])
            rows.append((ids, x))
            while sum(len(i) for i, _ in rows) >= most:
                ids, x = np.concatenate([i for i, _ in rows]), np.concatenate([m for _, m in rows])
                yield block(int(dim), [(ids[:most], x[:most])])
                rows[:] = [(ids[most:], x[most:])] if len(ids) > most else []
    for dim, rows in held.items():
        if rows:
            yield block(dim, rows)


def threshold_search(ids: np.ndarray, x: np.ndarray, order: np.ndarray, own: int, q: np.ndarray, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of rows that may be among the best k: at most k, none below the bound kth."""
    n, dims = len(ids), np.flatnonzero(q)
    x_used = x[:, dims]
    weight = q[dims].astype(x.dtype)
    lists = np.where((weight > 0)[None, :], order[::-1, dims], order[:, dims])
    unseen = ids != own
    best_ids, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, reach = 0, FIRST_DEPTH if len(dims) else n
    while depth < n:
        end = min(reach, n)
        met = np.zeros(n, bool)
        if len(dims):
            met[lists[depth:end].ravel()] = True
        else:
            met[:] = True
        met &= unseen
        unseen &= ~met
        rows = np.flatnonzero(met)
        scores = np.rint(x_used[rows] @ weight).astype(np.int64) if x.dtype.kind == "f" else x_used[rows] @ weight
        good = scores >= kth
        best_ids, best_scores = np.concatenate([best_ids, ids[rows[good]]]), np.concatenate([best_scores, scores[good]])
        if len(best_ids) > k:
            top = np.lexsort((best_ids, -best_scores))[:k]
            best_ids, best_scores = best_ids[top], best_scores[top]
        if len(best_ids) >= k:
            kth = max(kth, best_scores.min())
        if not unseen.any():
            break
        bound = float((x_used[lists[end - 1, np.arange(len(dims))], np.arange(len(dims))] * weight).sum()) if len(dims) else 0.0
        if kth > bound:
            break
        depth, reach = end, end + 2 * (end - depth)
    return best_ids, best_scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Each query's k best candidates by integer inner product: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    block = "dim int, n int, ids binary, matrix binary, lists binary"
    wanted = written(usable(queries).dropDuplicates(["vec_id", "x"]), "topk-queries")
    n_blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    copies = partitions(spark)
    asked = wanted.repartition(n_blocks).mapInPandas(lambda f: packed_blocks(f, QUERY_BLOCK, False), block)
    asked = written(asked, "topk-query-blocks").withColumn("q", F.monotonically_increasing_id())
    asked = asked.select("dim", "q", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    blocks = usable(vectors).mapInPandas(lambda f: packed_blocks(f, BLOCK, True), block)
    blocks = blocks.withColumn("copy", F.pmod(F.xxhash64("ids"), F.lit(copies)).cast("int"))
    pairs = blocks.join(asked.hint("shuffle_hash"), ["dim", "copy"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kth = -1, np.zeros(0)
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids, x = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.matrix, "<i8").reshape(row.n, row.dim)
                order = np.frombuffer(row.lists, "<u2").reshape(row.n, row.dim)
                q_ids = np.frombuffer(row.q_ids, "<i8")
                qs = np.frombuffer(row.q_matrix, "<i8").reshape(len(q_ids), row.dim)
                if float(np.abs(x).max(initial=0)) * float(np.abs(qs).max(initial=0)) * row.dim < 2**53:
                    x = x.astype(np.float64)
                if row.q != last:
                    last, kth = row.q, np.full(len(q_ids), -np.inf)
                out = []
                for i, (own, q) in enumerate(zip(q_ids, qs)):
                    found, scores = threshold_search(ids, x, order, own, q, k, kth[i])
                    out.append((np.full(len(found), row.q * QUERY_BLOCK + i), np.full(len(found), own), found, scores))
                    if len(scores) >= k:
                        kth[i] = max(kth[i], scores.min())
                if any(len(o[0]) for o in out):
                    yield pd.DataFrame({name: np.concatenate([o[j] for o in out]) for j, name in enumerate(("row", "query_id", "vec_id", "score"))})

    found = pairs.select("n", "dim", "ids", "matrix", "lists", "q", "q_ids", "q_matrix").mapInPandas(search, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
