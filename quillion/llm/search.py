"""Exact top-k by integer inner product: branch and bound over dimensions held in columns.

Vectors are quantised to floor(256 * x). Candidates are dealt to groups of about ``GROUP`` components and queries
to groups of about ``QUERIES``; every pair of groups is one task's work, with the candidates laid out one array a
dimension. For a query the dimensions come in falling order of its own weight, ``STEP`` at a time: partial sums grow, the
mass that remains (the norms of the dimensions not yet seen, by Cauchy-Schwarz) bounds each candidate's score from
both sides, and those whose upper bound is under the k-th lower bound are compacted away. The survivors' sums are
exact. The first group is searched before the others, so that these begin with a bar: the query's k-th score there.
Groups return k rows a query, and a last ranking takes the best k. Vectors travel as the smallest integers that hold all of them.

The queries are a stated set and meet all rows in blocks; a group of rows is a task's whole input, so memory is
that of two groups whatever the table. Equal vectors are candidates like any others; ties go to the smaller id.

Defined results: vectors that are null or hold null or non-finite components take no part; nor do empty ones;
vectors of different lengths are not compared; a row is never its own candidate, but another row with the same id
is one; a row whose id is null is a candidate after all others of its score, and no query; a query row that is
repeated gives its results once for each; a score beyond 64 bits counts as the largest
or smallest that they hold; very long vectors make groups of fewer; columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stash

SCALE = 256
#: Components of the candidates, and of the queries, that a task holds (about).
GROUP = 1 << 20
QUERIES = 1 << 20
#: Dimensions taken between two bounds.
STEP = 16
#: Stands for a null id, and sorts last.
NO_ID = (1 << 63) - 1


def top(query: np.ndarray, own: int, columns: np.ndarray, squares: np.ndarray, uids: np.ndarray, ids: np.ndarray, k: int, bar: float = -math.inf, step: int = STEP) -> list[tuple[int, int]]:
    """[(score, position)], best first, of the k best or of all of them that reach the bar. columns: dimension by candidate; squares: their
    squared norms; all float64, whole-numbered and small enough to be exact."""
    order = np.argsort(-np.abs(query), kind="stable")
    left = float(query @ query)
    alive = np.flatnonzero((uids != own) & (np.sqrt(squares * left) + 1.0 >= bar))
    score, mass = np.zeros(len(alive)), squares[alive].copy()
    for at in range(0, len(order), step):
        dims = order[at : at + step]
        part = columns[dims]
        if len(alive) < columns.shape[1]:
            part = part[:, alive]
        score += query[dims] @ part
        left -= float(query[dims] @ query[dims])
        if at + step < len(order) and len(alive):
            mass -= np.einsum("ij,ij->j", part, part)
            reach = np.sqrt(np.maximum(mass, 0) * max(left, 0.0)) + 1.0
            if len(alive) > k:
                low = score - reach
                bar = max(bar, np.partition(low, len(low) - k)[len(low) - k])
            keep = score + reach >= bar
            if keep.sum() < 0.8 * len(alive):
                alive, score, mass = alive[keep], score[keep], mass[keep]
    if len(alive) > k:
        bar = np.partition(score, len(score) - k)[len(score) - k]
        best = np.flatnonzero(score >= bar)
        alive, score = alive[best], score[best]
    found = sorted(zip((-score).tolist(), ids[alive].tolist(), alive.tolist()))[:k]
    return [(int(-s), p) for s, _, p in found]


def _exact(queries: np.ndarray, columns: np.ndarray) -> bool:
    """Whether all sums are whole numbers that float64 holds exactly."""
    a, b = np.abs(queries).max(initial=0), np.abs(columns).max(initial=0)
    return max(a, b) ** 2 * max(1, queries.shape[1]) < 2**52


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[tuple] = []
    for size, asked in queries.groupby("size", sort=False):
        held = rows[rows["size"] == size]
        if not len(held):
            continue
        q, c = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (asked, held))
        uids, ids = held["uid"].to_numpy(), held["id"].to_numpy()
        if _exact(q, c):
            columns = np.ascontiguousarray(c.T)
            squares = np.einsum("ij,ij->j", columns, columns)
            for own, name, v, bar in zip(asked["uid"], asked["id"], q, asked["bar"]):
                out += [(own, name, int(uids[p]), int(ids[p]), s) for s, p in top(v, own, columns, squares, uids, ids, k, -math.inf if math.isnan(bar) else bar)]
        else:  # components too large for exact float64 sums: whole numbers of any size
            for own, name, v in zip(asked["uid"], asked["id"], q):
                whole = [int(x) for x in v]
                scored = sorted((-sum(a * int(b) for a, b in zip(whole, row)), i, u) for row, i, u in zip(c, ids.tolist(), uids.tolist()) if u != own)
                out += [(own, name, u, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for s, i, u in scored[:k]]
    return pd.DataFrame(out, columns=["query_uid", "query_id", "uid", "vec_id", "score"]).astype("int64")


def quantised(vectors: DataFrame, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """uid, id, size and v (the quantised vector as doubles) of the vectors that take part, written to the shared folder."""
    v = F.transform(F.col(vector), lambda x: _floor(x.cast("double") * SCALE))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    fit = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return stash(fit.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(vector_id).cast("long"), F.lit(NO_ID)).alias("id"), F.size(vector).alias("size"), v.alias("v")), "vectors")


def _floor(x: F.Column) -> F.Column:
    """As a double: floor() gives a 64-bit integer, and a component may be beyond that."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, group: int = GROUP, asked: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score. rows, queries: of quantised(), the queries among the rows."""
    total = lambda df: df.agg(F.sum("size")).first()[0] or 0
    parts, blocks = max(1, -(-total(rows) // group)), max(1, -(-total(queries) // asked))
    dealt = lambda df, count: F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int")
    largest = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0
    kind = next((k for k, most in (("smallint", 1 << 15), ("int", 1 << 31)) if largest < most), "double")
    rows, queries = (df.withColumn("v", F.col("v").cast(f"array<{kind}>")) for df in (rows, queries))
    right = rows.withColumn("part", dealt(rows, parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def searched(bars: DataFrame, first: int, last: int) -> DataFrame:
        left = bars.withColumn("block", dealt(queries, blocks)).withColumn("part", F.explode(F.sequence(F.lit(first), F.lit(last))))
        left = left.select(*(F.col(c).alias(c) for c in left.columns))  # columns of their own, for the cogroup
        pairs = left.groupBy("part", "block").cogroup(right.where(F.col("part").between(first, last)).groupBy("part", "block"))
        return pairs.applyInPandas(lambda a, b: _search(a, b, k), "query_uid long, query_id long, uid long, vec_id long, score long")

    found = searched(queries.withColumn("bar", F.lit(None).cast("double")), 0, 0)
    if parts > 1:
        found = stash(found, "first")
        # k scores or more that are there make a bar; less, where sums are not exact in double
        bars = found.groupBy("query_uid").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("bar")).where((F.col("n") >= k) & (F.abs("bar") < 2.0**52))
        asked_again = queries.join(small(bars.select(F.col("query_uid").alias("uid"), "bar")), "uid", "left")
        found = found.unionByName(searched(asked_again, 1, parts - 1))
    order = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def stated_queries(rows: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``."""
    return rows.where((F.pmod("id", F.lit(every)) == 0) & (F.col("id") != NO_ID))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.u AS qu, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.u <> c.u AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qu ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
