"""Texts whose sets of word shingles have a Jaccard similarity of a threshold or more: min-hash bands, then whole sets.

A text has ``BANDS`` keys, each of ``ROWS`` minima of its shingles under random permutations. Two sets of similarity s share a
key with probability 1 - (1 - s ** ROWS) ** BANDS: all but 1.3e-7 of the pairs at 0.8, all but 7e-11 at 0.85. What shares a key
is compared by the whole sets of its whole texts, so that nothing below the threshold is linked.

A pair has its whole sets compared only if the texts' bits leave it open. Each shingle sets one of ``BITS`` bits of its text; a bit that x has and
y has not is a shingle at least that y has not. So x has at least d(x, y) shingles of its own and y at least d(y, x), they share at most
c = min(|x| - d(x, y), |y| - d(y, x)), and their similarity is c / (c + d(x, y) + d(y, x)) at most. Where that is under the threshold there
is no link: the bound costs comparisons, never a link. It is a condition of the join, so such a pair is never a row; the join still looks at it.

Links are sought between components, not inside them: texts already joined are not compared. Where a key's pairs across components are
more than ``LINEAR`` times the texts, each key's central text, that whose keys have the most texts in all, is compared with the key's others first, which
joins most of what belongs together. Then those of its n texts whose share of the hash range is under PIVOTS / n are compared with all others, and are done; ``GROWTH`` times
as many follow, until the pairs left are that few or a round finds no link, and all that is left is compared. So a group of
near copies takes a few comparisons a text, not one a pair, and every pair that may matter has its turn. No key is ever held by one
task: counts are combined before the shuffle, and the rest is equi-joins that adaptive execution splits.

Defined results: words and shingles as in simhash.py, fewer than five words make one shingle; null, empty and blank
texts have no keys and are linked to nothing here; an empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, give_back, remove, small, stash, stashed

#: Fixed values of the pipeline's stage: words of a shingle, and the similarity as a fraction.
SHINGLE = 5
OVER, UNDER = 4, 5
BANDS, ROWS = 40, 5
#: Shingles permuted at a time.
CHUNK = 1 << 11
#: A key's first comparisons, and how many times as many follow.
PIVOTS, GROWTH = 2, 8
#: Bits of a text that its shingles set.
BITS = 1024
#: Pairs that are compared at once, times the texts.
LINEAR = 4


class Permutations(NamedTuple):
    """Of 32 bits, which equal minima of different shingles cost a comparison, never a link."""

    mask: np.ndarray
    factor: np.ndarray

    @classmethod
    def make(cls, count: int = BANDS * ROWS, seed: int = 42) -> Permutations:
        mask, factor = np.random.default_rng(seed).integers(0, 1 << 32, (2, count, 1), dtype=np.uint32)
        return cls(mask, factor | np.uint32(1))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        half = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.mask), (1 << 32) - 1, dtype=np.uint32)
        for at in range(0, len(half), CHUNK):
            mixed = half[None, at : at + CHUNK] ^ self.mask
            mixed *= self.factor
            np.minimum(least, mixed.min(axis=1), out=least)
        return least


def keys(minima: np.ndarray) -> np.ndarray:
    """The keys of a text's bands, signed."""
    rows, odd = minima.reshape(BANDS, ROWS).astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
    made = np.arange(1, BANDS + 1, dtype=np.uint64) * odd
    for k in range(ROWS):
        made = (made ^ rows[:, k]) * odd
        made ^= made >> np.uint64(29)
    return made.view(np.int64)


def bits(hashes: np.ndarray) -> np.ndarray:
    """The bits of a text's shingles, as signed longs."""
    flags = np.zeros(BITS, dtype=bool)
    flags[hashes % np.uint64(BITS)] = True
    return np.packbits(flags, bitorder="little").view(np.int64)


#: A text's bits as columns of their own, which a join's condition reads fastest, and how many are set.
WORDS = [f"bits{i}" for i in range(BITS // 64)]


def _spread(marks: DataFrame) -> list[Column]:
    """WORDS and ones of the column bits, if marks has it."""
    if "bits" not in marks.columns:
        return []
    words = [F.get("bits", F.lit(i)) for i in range(len(WORDS))]
    return [*(c.alias(name) for c, name in zip(words, WORDS)), reduce(Column.__add__, map(F.bit_count, words)).alias("ones")]


def _open() -> Column:
    """Whether the sizes and bits of two texts, those of one after p_, leave it open that they are similar.

    With d(x, y) = ones(x) - both the bound c / (c + d(x, y) + d(y, x)) >= OVER / UNDER has each bit counted once."""
    both = reduce(Column.__add__, (F.bit_count(F.col(c).bitwiseAND(F.col(f"p_{c}"))) for c in WORDS))
    more = F.least(F.col("p_size") - F.col("p_ones"), F.col("size") - F.col("ones"))
    return (UNDER + OVER) * both + (UNDER - OVER) * more >= OVER * (F.col("p_ones") + F.col("ones"))


def _similar(pairs: DataFrame, hashes) -> DataFrame:
    """a, b of the pairs (p_uid, uid, a, b, x_text, y_text) that are similar. hashes: from the UTF-8 text to its different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, held = [], None, None
            for x, y in zip(batch.column(2), batch.column(3)):
                x = x.as_py()
                if x != last:
                    last, held = x, hashes(x.encode())
                other = hashes(y.as_py().encode())
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(UNDER * both >= OVER * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    # few bytes for long work, so dealt to as many tasks as there are; a pivot that many texts meet goes to all of them
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(tasks, "uid").sortWithinPartitions("p_uid")
    return dealt.select("a", "b", "x_text", "y_text").mapInArrow(run, "a long, b long")


def _central(now: DataFrame) -> DataFrame:
    """Of each key the row whose text's keys have the most texts in all. now is read three times; pass a stashed table."""
    weights = small(now.groupBy("uid").agg(F.sum("n").alias("weight")))
    order = F.struct((-F.col("weight")).alias("least"), "place", "uid")
    heads = now.select("key", "uid", "place").join(weights, "uid").groupBy("key").agg(F.min(order).alias("head"))
    return now.join(heads.select("key", F.col("head.uid").alias("uid")), ["key", "uid"])


def links(marks: DataFrame, texts: Callable[[DataFrame], DataFrame], hashes: Callable[[bytes], np.ndarray], near: DataFrame) -> DataFrame:
    """a, b: near and links of the names of similar texts, enough of them to join every component.

    marks: uid, name, size (of the set), keys and perhaps bits, a row for each different text; texts: from a table of uids to
    uid, text; hashes: from a UTF-8 text to its different shingles; near: a, b, names joined already."""
    dealt = marks.select("uid", F.explode("keys").alias("key"))
    place = F.pmod(F.xxhash64("uid"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    several = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sketched = marks.select("uid", "name", "size", *_spread(marks))
    met = dealt.join(several, "key").join(sketched, "uid")
    met = stash(met.withColumn("place", place), "met")
    found, roots, own, joined = near.select("a", "b"), None, [], -1

    def rooted(df: DataFrame) -> DataFrame:
        if roots is None:  # before the first comparisons each name is by itself
            return df.withColumn("root", F.col("name"))
        return df.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))

    low, high, total = 0, 0, marks.count()  # the central texts first, then those up to PIVOTS
    while True:
        rest = rooted(met.where(F.col("place") * F.col("n") >= low))
        if roots is not None:
            rest, path = stashed(rest, "rest")
            own.append(path)
        shares = rest.groupBy("key", "root").agg(F.count("*").cast("double").alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("q"))
        mixed, path = stashed(shares.select("key", ((F.col("c") * F.col("c") - F.col("q")) / 2).alias("pairs")).where("pairs > 0"), "mixed")
        left = mixed.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
        if not left:
            return found
        before, joined = joined, found.count()
        if last := left <= LINEAR * total or joined == before:
            high = float("inf")
        now = stash(rest.join(small(mixed.select("key")), "key"), "active")
        remove(marks.sparkSession, own)
        own.append(path)
        met = now.drop("root")
        first = now.where(F.col("place") * F.col("n") < high) if high else _central(now)
        first = first.select("key", *(F.col(c).alias(f"p_{c}") for c in (*sketched.columns, "place", "root")))
        later = (F.col("place") > F.col("p_place")) | ((F.col("place") == F.col("p_place")) & (F.col("uid") > F.col("p_uid")))
        later = later if high else F.col("uid") != F.col("p_uid")
        fits = (F.col("root") != F.col("p_root")) & (UNDER * F.least("size", "p_size") >= OVER * F.greatest("size", "p_size"))
        fits = fits & _open() if "ones" in sketched.columns else fits
        pairs = first.join(now, "key").where(later & fits)
        pairs, pairs_path = stashed(pairs.select("p_uid", "uid", F.col("p_name").alias("a"), F.col("name").alias("b")).distinct(), "pairs")
        wanted = pairs.select("uid").union(pairs.select("p_uid")).distinct()
        written, texts_path = stashed(texts(small(wanted)), "compared")
        x = written.select(F.col("uid").alias("p_uid"), F.col("text").alias("x_text"))
        whole = pairs.join(x, "p_uid").join(written.select("uid", F.col("text").alias("y_text")), "uid")
        found = stash(found.union(_similar(whole, hashes).distinct()), "similar")
        remove(marks.sparkSession, [pairs_path, texts_path])
        if last:
            return found
        roots = stash(components(found, "a", "b"), "roots")
        low, high = high, high * GROWTH + PIVOTS
