"""Near-duplicates of the pipeline's stage: five-word shingles, similarity 0.8 or more."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillion.llm import jaccard, simhash


def similarity(a, b):
    x, y = (set(zip(*(t.split()[i:] for i in range(5)))) for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_finds_all_of_similarity(spark):
    """One changed word of 200 is similarity 0.95, four about 0.82: of each pair one text stays. Eight, 0.68: both do."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, kept = [], 0
    for k, changes in enumerate([1, 4, 4, 4, 8, 8] * 5):
        first = [rng.choice(words) for _ in range(200)]
        second = list(first)
        for i in range(changes):
            second[10 + 20 * i] = "new"
        texts = [" ".join(first), " ".join(second)]
        rows += [(2 * k + i, t) for i, t in enumerate(texts)]
        kept += 1 if similarity(*texts) >= 0.8 else 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.representatives(docs).count() == kept == 40


def test_links_join_what_brute_force_joins(spark):
    """Random groups of near copies, and a line that all texts have."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice((4, 30, 90)))]
        for _ in range(14):
            made = list(base)
            for _ in range(rng.randrange(4)):
                made[rng.randrange(len(made))] = rng.choice(words)
            texts.append(" ".join(made) + " this line is one that every text here ends with")
    texts = sorted(set(texts))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if similarity(texts[a], texts[b]) >= 0.8:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    made = jaccard.Permutations.make()
    rows = [(i, i, len(h), jaccard.keys(made.minima(h)).tolist()) for i, h in enumerate(simhash._different(t.encode()) for t in texts)]
    marks = spark.createDataFrame(rows, "uid long, name long, size long, keys array<long>")
    none = spark.createDataFrame([], "a long, b long")
    got = list(range(len(texts)))
    for r in jaccard.links(marks, lambda wanted: df.join(wanted, "uid", "left_semi"), simhash._different, none).collect():
        x, y = got[r["a"]], got[r["b"]]
        got = [min(x, y) if g in (x, y) else g for g in got]
    assert got == root and len(set(root)) < len(texts)


def test_keys_are_shared_as_often_as_reckoned():
    """One band of sets of similarity 0.8 is shared with probability 0.8 ** ROWS."""
    rng = np.random.default_rng(1)
    made, shared = jaccard.Permutations.make(), []
    for _ in range(300):
        h = rng.integers(0, 1 << 64, 180, dtype=np.uint64)
        a, b = (jaccard.keys(made.minima(x)) for x in (h[:162], h[18:]))  # 144 of 180
        shared.append(np.mean(a == b))
    assert abs(np.mean(shared) - 0.8**jaccard.ROWS) < 0.02 and min(shared) > 0


def test_representatives_odd(spark, odd_docs, empty_docs, clashing):
    """One document of equal texts, nulls and blanks one component, the smallest id stays, a repeated row once."""
    kept = simhash.representatives(odd_docs).collect()
    texts = [r["text"] for r in kept]
    assert len(texts) == len(set(texts)) and sum(not (t or "").strip() for t in texts) == 1
    seen = {" ".join(r["text"].split()) for r in odd_docs.collect() if (r["text"] or "").strip()}
    assert {" ".join(t.split()) for t in texts if (t or "").strip()} == seen
    assert {r["doc_id"] for r in kept} == {0, 3, 4, 5, 6, 7, 9, 10, 11, None} | {r["doc_id"] for r in kept if r["text"] == "another text of the same id"}
    again = simhash.representatives(clashing)
    assert again.columns == clashing.columns and again.count() == len(kept)
    empty = simhash.representatives(empty_docs)
    assert empty.columns == empty_docs.columns and empty.count() == 0


def test_bound_of_bits_loses_no_link(spark):
    """Sets of every similarity, long ones too: what is similar is left open, and of short ones far below the threshold nothing."""
    rng = np.random.default_rng(2)
    rows, wanted = [], []
    for size in (1, 3, 40, 150, 900, 3000):
        for own in (0, 0.03, 0.09, 0.11, 0.12, 0.3, 0.9):
            h = np.unique(rng.integers(0, 1 << 64, 2 * size, dtype=np.uint64))[: 2 * size]
            a, b = np.sort(rng.permutation(h)[:size]), None
            kept = size - round(own * size)
            b = np.unique(np.concatenate([rng.permutation(a)[:kept], np.setdiff1d(h, a)[: size - kept]]))
            both = len(np.intersect1d(a, b))
            wanted.append((both / (len(a) + len(b) - both), size))
            rows.append((len(rows), len(a), jaccard.bits(a).tolist(), len(b), jaccard.bits(b).tolist()))
    df = spark.createDataFrame(rows, "i long, size long, bits array<long>, p_size long, p_bits array<long>")
    x = df.select("i", "size", *jaccard._spread(df.select("bits")))
    y = df.select("i", F.col("p_size").alias("size"), F.col("p_bits").alias("bits"))
    y = y.select("i", *(c.alias(f"p_{n}") for c, n in zip([F.col("size"), *jaccard._spread(y)], ["size", *jaccard.WORDS, "ones"])))
    got = {r["i"]: r["open"] for r in x.join(y, "i").select("i", jaccard._open().alias("open")).collect()}
    assert all(got[i] for i, (s, _) in enumerate(wanted) if s >= 0.8)
    assert not any(got[i] for i, (s, size) in enumerate(wanted) if s < 0.7 and 3 < size <= 150)


def test_near_copies_make_few_pairs(spark, monkeypatch):
    """Many texts of one template, most of them less alike than the threshold: few have their texts compared, and none is lost."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for _ in range(240):
        made = list(base)
        for _ in range(rng.randrange(1, 12)):
            made[rng.randrange(len(made))] = rng.choice(words)
        texts.append(" ".join(made))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and similarity(texts[a], texts[b]) >= 0.8:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    compared, similar = [], jaccard._similar
    monkeypatch.setattr(jaccard, "_similar", lambda pairs, hashes: compared.append(pairs.count()) or similar(pairs, hashes))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.representatives(docs).collect()} == set(root)
    assert 40 < len(set(root)) < 200 and sum(compared) < 8 * len(texts)
