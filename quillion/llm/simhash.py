"""SimHash near-duplicates by anchor points of a covering code.

Fingerprint: 64 bits by majority over the XXH64 hashes of a document's word shingles. Anchors: the words of
the perfect [63, 57] Hamming code over the low 63 bits (covering radius 1). Two fingerprints at distance 2
or less have a point within 1 of both, and that point has an anchor within 1 of it; so both lie within
radius + 1 = 2 of one anchor. Every fingerprint goes to all anchors that near (1 or 32 of them, found from
the syndrome alone), and an anchor compares what it got on all 64 bits. Copying within radius + threshold
= 3, as the plain bound has it, would find the same links with 652 anchors for each fingerprint.

Only distinct fingerprints are copied, so a group of equal texts is one point, and an anchor's ball holds at
most 2 * (1 + 63 + 1953) of them whatever the input: no group grows with the data. Per anchor only a
spanning forest of the links leaves the task.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; fewer than
three words make one shingle; repeated rows stay; a null doc_id stays and counts as the largest; a very long text is hashed in parts; of equal
fingerprints one stands in for all; columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .jaccard import SHINGLE
from .shared import components, give_back, small, small_batches, stash

SEED = 42
DISTANCE = 2
#: Shingles hashed at a time, so that a very long text needs little memory.
CHUNK = 1 << 15


def shingles(text: bytes, width: int = 3) -> np.ndarray:
    """The hashes of a UTF-8 text's word shingles in order, repeats included, as big-endian unsigned integers."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, ">u8")
    digest, width, parts = xxhash.xxh64_digest, min(width, len(words)), []
    for at in range(0, len(words) - width + 1, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        parts.append(b"".join([digest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(width)))]))
    return np.frombuffer(b"".join(parts), dtype=">u8")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles' hashes as a signed 64-bit integer; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit integer."""
    return majority(shingles(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary() if not pa.types.is_large_string(batch.column(1).type) else pa.large_binary())
            fps = [fingerprint(x.as_py() or b"", shingle) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def anchors(fp: F.Column) -> F.Column:
    """Array of the code words within distance 2 of the low 63 bits of fp.

    Position i of the code (1 to 63) is bit i - 1, and the syndrome s is the exclusive or of the positions set.
    Turning positions i and i ^ s (0 standing for none) makes the syndrome zero: 32 pairs, or the word itself.
    """
    low = fp.bitwiseAND(F.lit((1 << 63) - 1).cast("long"))
    syndrome = F.lit(0)
    for bit in range(6):
        mask = sum(1 << (i - 1) for i in range(1, 64) if i >> bit & 1)
        odd = F.bit_count(fp.bitwiseAND(F.lit(mask).cast("long"))).cast("int").bitwiseAND(F.lit(1))
        syndrome = syndrome.bitwiseOR(F.shiftleft(odd, bit))
    return F.when(syndrome == 0, F.array(low)).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i < i.bitwiseXOR(syndrome)),
            lambda i: low.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(syndrome))),
        )
    )


def _bit(position: F.Column) -> F.Column:
    return F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("long"), position - 1)).otherwise(F.lit(0).cast("long"))


def _forest(points: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join the points of each component under the links of at most this distance."""
    left, out = points, []
    while len(left) > 1:
        inside = np.zeros(len(left), dtype=bool)
        inside[0] = True
        todo = [left[0]]
        while todo:
            at = todo.pop()
            new = ~inside & (np.bitwise_count(left ^ at) <= distance)
            inside |= new
            todo += list(left[new])
            out += [(at, x) for x in left[new]]
        left = left[~inside]
    return out


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links between different fingerprints (column fp, distinct), enough of them to join every component."""
    if not 0 <= distance <= 2:
        raise ValueError("this code serves distances up to 2")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, points = np.empty(0, np.int64), np.empty(0, np.int64)

        def compared(anchor: np.ndarray, points: np.ndarray) -> pd.DataFrame:
            cuts = np.flatnonzero(np.diff(anchor)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(anchor))
            more = ends - starts > 1
            found = []
            two = starts[ends - starts == 2]
            x, y = points[two].view(np.uint64), points[two + 1].view(np.uint64)
            near = np.bitwise_count(x ^ y) <= distance
            pairs = np.stack([points[two][near], points[two + 1][near]], axis=1)
            for s, e in zip(starts[more & (ends - starts > 2)], ends[more & (ends - starts > 2)]):
                found += _forest(points[s:e].view(np.uint64), distance)
            found = np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, 2) if found else np.empty((0, 2), np.int64)
            both = np.concatenate([pairs, found])
            return pd.DataFrame({"a": both.max(axis=1), "b": both.min(axis=1)}).drop_duplicates() if len(both) else pd.DataFrame({"a": [], "b": []}, dtype="int64")

        for frame in frames:
            anchor = np.concatenate([anchor, frame["anchor"].to_numpy()])
            points = np.concatenate([points, frame["fp"].to_numpy()])
            if len(anchor) and anchor[0] != anchor[-1]:
                last = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
                yield compared(anchor[:last], points[:last])
                anchor, points = anchor[last:], points[last:]
        if len(anchor):
            yield compared(anchor, points)

    # 32 copies of each are made, so dealt to many tasks, which adaptive execution would take together for their small size
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copied = distinct.select("fp").repartition(tasks).select(F.explode(anchors(F.col("fp"))).alias("anchor"), "fp")
    return copied.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id of its component."""
    marked = stash(fingerprints(docs, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(distinct, distance), "a", "b")
    joined = distinct.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _different(text: bytes) -> np.ndarray:
    return np.unique(shingles(text, SHINGLE).astype(np.uint64))


def _marks(docs: DataFrame) -> DataFrame:
    """id, no_id, k1, k2 (the text's hashes), fp, size (of the set of shingles), keys and bits of the columns id, text, k1, k2."""
    permutations, keys_of, bits_of = jaccard.Permutations.make(), jaccard.keys, jaccard.bits  # names of their own: a module is not sent to tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4).cast(pa.binary() if not pa.types.is_large_string(batch.column(4).type) else pa.large_binary())
            fps, sizes, keys, bits = [], [], [], []
            for text in texts:
                hashes = shingles(text.as_py() or b"", SHINGLE)
                own = np.unique(hashes.astype(np.uint64))
                fps.append(majority(hashes))
                sizes.append(len(own))
                keys.append(keys_of(permutations.minima(own)) if len(own) else [])
                bits.append(bits_of(own) if len(own) else [])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, bits)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["id", "no_id", "k1", "k2", "fp", "size", "keys", "bits"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "id long, no_id boolean, k1 long, k2 long, fp long, size long, keys array<long>, bits array<long>")


def representatives(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id (null last).

    Links are those of near fingerprints of five-word shingles, and between the components that these make those of
    jaccard.py, whole sets of five-word shingles of similarity 0.8 or more. A text stands in for its copies; rows of the
    same doc_id and text are one document, of which the first in the order of their JSON stays. Null, empty and blank texts are one
    component. Columns may have any names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever docs calls its columns
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    whole = F.coalesce(text.cast("string"), F.lit(""))
    key = {"id": F.coalesce(doc_id.cast("long"), F.lit(0)), "no_id": doc_id.isNull(), "k1": F.xxhash64(whole), "k2": F.xxhash64(F.lit(1), whole)}
    rows = docs.toDF(*names).withColumns(key)
    marked = stash(_marks(rows.select(*key, whole.alias("text"))), "marks")
    marked = marked.withColumn("uid", F.xxhash64("k1", "k2"))
    different = marked.groupBy("k1", "k2").agg(*(F.any_value(c).alias(c) for c in ("uid", "fp", "size", "keys", "bits")))
    near = stash(links(marked.select("fp").distinct(), distance), "near")

    def texts(wanted: DataFrame) -> DataFrame:
        own = marked.join(wanted, "uid", "left_semi").groupBy("uid", "k1", "k2").agg(F.min(F.struct("no_id", "id")).alias("first")).select("uid", "k1", "k2", "first.*")
        return rows.select(*key, whole.alias("text")).join(small(own), list(key)).select("uid", "text").dropDuplicates(["uid"])

    similar = jaccard.links(different.select("uid", F.col("fp").alias("name"), "size", "keys", "bits"), texts, _different, near)
    joined = components(similar, "a", "b").select(F.col("node").alias("fp"), "root")
    rooted = marked.select(*key, "fp").join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stash(rooted.groupBy("root", *key).agg(F.count("*").alias("n")), "named")
    first = named.groupBy("root").agg(F.min(F.struct("no_id", "id", "k1", "k2", "n")).alias("first")).select("first.*")
    gone = named.select(*key).join(first, list(key), "left_anti")
    again = first.where("n > 1").select(*key)
    left = rows.join(small(gone), list(key), "left_anti")
    again = small(again)
    once = left.join(again, list(key), "left_anti").select(*names)
    one = rows.join(again, list(key), "left_semi").groupBy(*key).agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("row")).select("row.*")
    return once.unionByName(one).toDF(*docs.columns)
