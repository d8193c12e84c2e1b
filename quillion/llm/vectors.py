"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with cosine >= t are within eps = sqrt(2 - 2t) of each other, and no further apart on any set of
orthogonal directions. The leading principal directions (of all vectors: sums of products made on the executors)
carry a grid with cells of that width. Vectors are sorted by their cells, first direction first, and the
sequence is cut into blocks. Intervals of the sequence are joined from the whole one down: a pair of intervals whose boxes, on
all leading directions, are more than eps apart is skipped, the others are replaced by the pairs of their ``FAN`` parts (equi-joins on the
parent, so that no key has more than FAN rows a pair), down to pairs of blocks. To a pair of blocks go only those vectors that come within eps of
the other block's box, and each is one task's work. There the intervals are halved again and again in the same way; small ones are compared,
in single precision with a margin first and then in double precision.

Equal vectors are one point with a count, so a vector that a third of the rows share costs nothing more, and what leaves a
task is one row for each point: its links there and its smallest neighbour in the local components. No list of
pairs is made.

Defined results: a vector that is null, empty, zero or has null or non-finite components links with nothing;
vectors of different lengths do not link; repeated rows link with each other; a row whose vec_id is
null has a null component_id unless it is linked with one that has an id; very long vectors make blocks of fewer; columns may have any
names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, small, stash

COSINE = 0.95
#: Leading directions in the grid.
DIRECTIONS = 12
#: Components of the vectors of a block, about; and vectors of an interval that is not halved again.
BLOCK = 1 << 19
LEAF = 512
#: Parts of an interval.
FAN = 8


def points(vectors: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """rid, n, least (id) and v, a row for each different vector that can link, written to the shared folder."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    fit = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & some)
    grouped = fit.groupBy(F.col(vector).alias("v")).agg(F.count("*").alias("n"), F.min(vector_id).alias("least"))
    return stash(grouped.select(F.monotonically_increasing_id().alias("rid"), "n", "least", "v"), "points")


def _units(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square leaves the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(vectors: DataFrame, count: int = DIRECTIONS) -> dict[int, np.ndarray]:
    """The leading principal directions of the unit vectors, for each length that vectors have."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for size, rows in frame.groupby(frame["v"].map(len))["v"]:
                x = _units(rows)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)  # the last row and column hold sums and the count
                sums[size] = sums.get(size, 0) + x.T @ x
        for size, s in sums.items():
            yield pd.DataFrame({"size": size, "i": range(size + 1), "row": list(s)})

    added = [F.sum(F.get("row", F.col("j"))).alias("x")]
    made = vectors.select("v").mapInPandas(run, "size int, i int, row array<double>")
    made = made.select("size", "i", "row", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("j")).groupBy("size", "i", "j").agg(*added).toPandas()
    out = {}
    for size, own in made.groupby("size"):
        s = np.zeros((size + 1, size + 1))
        s[own["i"], own["j"]] = own["x"]
        n, mean = s[-1, -1], s[-1, :-1] / s[-1, -1]
        _, vectors_ = np.linalg.eigh(s[:-1, :-1] / n - np.outer(mean, mean))
        out[int(size)] = vectors_[:, ::-1][:, : min(count, size)].T.copy()
    return out


def ordered(vectors: DataFrame, basis: dict[int, np.ndarray], eps: float, block: int = BLOCK) -> DataFrame:
    """The points with at (their projection) and block: a number of the interval of the grid order, by length."""

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = frame["v"].map(len)
            at, cell = pd.Series(index=frame.index, dtype=object), pd.Series(index=frame.index, dtype=object)
            for k, rows in frame.groupby(size)["v"]:
                p = _units(rows) @ basis[int(k)].T
                at[rows.index], cell[rows.index] = list(p), list(np.floor(p / eps).astype(np.int32))
            yield frame.assign(size=size.astype("int32"), at=at, cell=cell)

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for frame in frames:
            yield frame.drop(columns=["cell"]).assign(part=np.int32(part), nth=np.arange(n, n + len(frame)))
            n += len(frame)

    kind = "float" if dict(vectors.dtypes)["v"] == "array<float>" else "double"
    shape = f"rid long, n long, least long, v array<{kind}>, size int, at array<double>"
    placed = stash(vectors.withColumn("v", F.col("v").cast(f"array<{kind}>")).mapInPandas(project, f"{shape}, cell array<int>"), "projected")
    keys = ["size", "cell", "rid"]
    sorted_ = stash(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(number, f"{shape}, part int, nth long"), "ordered")
    before, starts = 0, []
    for row in sorted_.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        starts.append((row["part"], before))
        before += row["n"]
    offsets = sorted_.sparkSession.createDataFrame(starts, "part int, first long")
    where = F.floor((F.col("first") + F.col("nth")) / F.greatest(F.floor(F.lit(block) / F.col("size")), F.lit(1)))
    return stash(sorted_.join(F.broadcast(offsets), "part").withColumn("block", where.cast("long")).drop("part", "nth", "first"), "blocks")


def _apart(one: F.Column, other: F.Column) -> F.Column:
    """The square of the distance of two boxes, arrays of (low, high)."""
    gaps = F.zip_with(one, other, lambda x, y: F.greatest(x["low"] - y["high"], y["low"] - x["high"], F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def block_pairs(rows: DataFrame, eps: float, fan: int = FAN) -> DataFrame:
    """size, a, b (a <= b), box_a, box_b: pairs of blocks whose boxes come within eps."""
    spread = rows.select("size", "block", F.posexplode("at")).groupBy("size", "block", "pos").agg(F.min("col").alias("low"), F.max("col").alias("high"))
    spread = stash(spread, "boxes")
    last = spread.agg(F.max("block")).first()[0] or 0

    def boxes(width: int) -> DataFrame:
        """Of the intervals of so many blocks."""
        node = F.floor(F.col("block") / width).cast("long")
        sides = spread.groupBy("size", node.alias("node"), "pos").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        box = F.transform(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))), lambda x: F.struct(x["low"], x["high"]))
        return sides.groupBy("size", "node").agg(box.alias("box"))

    width = 1
    while width <= last:
        width *= fan
    whole = stash(boxes(width), "intervals")
    pairs = whole.select("size", F.col("node").alias("a"), F.col("node").alias("b"), F.col("box").alias("box_a"), F.col("box").alias("box_b"))
    while width > 1:
        width //= fan
        parts = stash(boxes(width), "intervals").withColumn("parent", F.floor(F.col("node") / fan).cast("long"))
        left, right = (parts.select("size", F.col("parent").alias(c), F.col("node").alias(f"{c}_part"), F.col("box").alias(f"box_{c}")) for c in "ab")
        met = pairs.select("size", "a", "b").join(left, ["size", "a"]).join(right, ["size", "b"])
        met = met.select("size", F.col("a_part").alias("a"), F.col("b_part").alias("b"), "box_a", "box_b")
        pairs = stash(met.where((F.col("a") <= F.col("b")) & (_apart(F.col("box_a"), F.col("box_b")) <= eps * eps * (1 + 1e-9))), "pairs")
    return pairs


class _Forest:
    """Components of points under batches of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _root(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.parent[i], self.parent[j]
            if (a == b).all():
                return
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            self._root()


def _linked(a: pd.DataFrame, b: pd.DataFrame, same: bool, cosine: float, eps: float, leaf: int) -> pd.DataFrame:
    """rid, other (smallest rid of its component here), links (rows linked) of the points that have links."""
    if not len(a) or not len(b) and not same:
        return pd.DataFrame({"rid": [], "other": [], "links": []}, dtype="int64")
    both = a if same else pd.concat([a, b], ignore_index=True)
    unit, at = _units(both["v"]), np.stack([np.asarray(x, dtype=np.float64) for x in both["at"]])
    single, weight, rid = unit.astype(np.float32), both["n"].to_numpy(), both["rid"].to_numpy()
    order = np.lexsort((rid, *np.floor(at / eps).T[::-1]))  # the grid order again; a side's own rows stay together
    n = len(a)
    links, forest = np.zeros(len(both), dtype=np.int64), _Forest(len(both))
    margin, reach = 1e-6 * unit.shape[1] + 1e-6, eps * eps * (1 + 1e-9)

    def compare(x: np.ndarray, y: np.ndarray, itself: bool) -> None:
        i, j = np.nonzero(single[x] @ single[y].T >= cosine - margin)
        if itself:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        i, j = x[i], y[j]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            near = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
            p, q = p[near], q[near]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            forest.join(p, q)

    def visit(x: np.ndarray, y: np.ndarray, itself: bool) -> None:
        if not itself:
            gap = np.maximum(0, np.maximum(at[x].min(axis=0) - at[y].max(axis=0), at[y].min(axis=0) - at[x].max(axis=0)))
            if gap @ gap > reach:
                return
        if len(x) <= leaf and len(y) <= leaf:
            compare(x, y, itself)
        elif itself:
            h = len(x) // 2
            visit(x[:h], x[:h], True)
            visit(x[h:], x[h:], True)
            visit(x[:h], x[h:], False)
        elif len(x) >= len(y):
            visit(x[: len(x) // 2], y, False)
            visit(x[len(x) // 2 :], y, False)
        else:
            visit(x, y[: len(y) // 2], False)
            visit(x, y[len(y) // 2 :], False)

    if same:
        visit(order, order, True)
    else:
        visit(order[order < n], order[order >= n], False)
    hit = np.flatnonzero(links)
    least = np.full(len(both), np.iinfo(np.int64).max)
    np.minimum.at(least, forest.parent, rid)
    return pd.DataFrame({"rid": rid[hit], "other": least[forest.parent[hit]], "links": links[hit]})


def links(rows: DataFrame, pairs: DataFrame, cosine: float, eps: float, leaf: int = LEAF) -> DataFrame:
    """rid, other, links: a row for each point of each pair of blocks in which it has links."""
    # a point far from the other block's box on the leading directions links with nothing there
    near = lambda box: (F.col("a") == F.col("b")) | (_apart(F.transform("at", lambda x: F.struct(x.alias("low"), x.alias("high"))), box) <= eps * eps * (1 + 1e-9))
    left_pairs = small(pairs.select("size", "a", "b", F.col("box_b").alias("box")))
    right_pairs = small(pairs.where("a < b").select("size", "a", "b", F.col("box_a").alias("box")))
    own = rows.select("rid", "n", "v", "at", "size", "block")
    left = own.withColumnRenamed("block", "a").join(left_pairs, ["size", "a"]).where(near(F.col("box"))).drop("box")
    fresh = [F.col(c).alias(c) for c in ("rid", "n", "v", "at", "size")]  # columns of their own, for the cogroup
    right = own.select(*fresh, F.col("block").alias("b")).join(right_pairs, ["size", "b"]).where(near(F.col("box"))).drop("box")

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return _linked(x, y, key[1] == key[2], cosine, eps, leaf)

    keys = ["size", "a", "b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "rid long, other long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vector_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    eps = math.sqrt(2 - 2 * cosine)
    distinct = points(vectors, vector_id, vector)
    rows = ordered(distinct, directions(distinct), eps, block)
    found = stash(links(rows, block_pairs(rows, eps), cosine, eps), "links")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found, "rid", "other").select(F.col("node").alias("rid"), "root")
    named = distinct.select("rid", "n", "least", "v").join(counts, "rid", "left").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    named = stash(named.select("root", "least", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "counted")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("v").alias("_v"), "n_links", "component_id")
    every = vectors.select(F.col(vector_id).alias("vec_id"), F.col(vector).alias("_w"))
    out = every.join(named, F.col("_w") == F.col("_v"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN m ON vec_id = m.a
"""
