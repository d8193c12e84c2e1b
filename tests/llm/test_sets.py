"""Mixing, packing, near-duplicates and search."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillion.llm import mixing, packing, search, simhash, vectors

from helpers import prose

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, rest = {}, set(order), sum(sizes.values())
    while left:
        total = sum(weights[s] for s in left)
        over = {s for s in left if rest * weights[s] > 3 * sizes[s] * total}
        if not over:
            return target | {s: rest * weights[s] / total for s in left}
        target |= {s: 3 * sizes[s] for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        left -= over
    return target


def check_mix(rows, sources):
    sizes, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
    wanted = brute_targets(dict(sizes))
    for s in sources:
        assert target[s] == pytest.approx(wanted[s]) and 0 <= target[s] - taken[s] < 1


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 5, 70, 300))), rng.choice(["a", "a", "a", "a", "b", "c", "é", "𝄞", None])) for i in range(300)] + [(1, "x y", "tiny"), (7, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parts, out = mixing.mix(mixing.sizes(docs))
    out = out.collect()
    assert len(out) == len(rows)
    check_mix(out, {r[2] for r in rows})
    # parts: every slot once, and no more words than a block has
    words = parts.groupBy("slot").agg(F.sum("n_words").alias("n")).collect()
    assert sorted(r["slot"] for r in words) == list(range(len(words))) and max(r["n"] for r in words) <= mixing.BLOCK
    by = {r["uid"]: r["taken"] for r in out}
    assert {r["uid"]: r["n"] for r in parts.groupBy("uid").agg(F.sum("n_words").alias("n")).collect()} == {u: t for u, t in by.items() if t}
    again = mixing.mix(mixing.sizes(docs.repartition(5)))[1].collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)


def test_schedule_is_even(spark):
    docs = spark.createDataFrame([(i, "w " * 640, s) for i, s in enumerate(["a"] * 10 + ["b"] * 10 + ["c"] * 10)], "doc_id long, text string, source string")
    sized = mixing.sizes(docs)
    plan = mixing.planned(mixing.targets(sized.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))))
    slots = [r["source_key"]["s"] for r in mixing.schedule(plan).orderBy("slot").collect()]
    share = {s: slots.count(s) / len(slots) for s in "abc"}
    for n in range(20, len(slots)):  # every prefix is close to the weights
        for s in "abc":
            assert abs(slots[:n].count(s) - n * share[s]) < 3


def test_the_step_decides_when(spark, monkeypatch):
    """Another step, other slots: for each document, and in the order in which the mixed documents are written."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, f"{i} " * rng.randint(1, 200), rng.choice("abc")) for i in range(120)], "doc_id long, text string, source string")

    def made():
        out = mixing.mix(mixing.sizes(docs))[1].collect()
        order = [r["doc_id"] for r in mixing.mixed_documents(docs).collect()]
        return {r["doc_id"]: r["first_slot"] for r in out}, order, {r["doc_id"]: r["taken"] for r in out}

    slots, order, taken = made()
    assert order[0] == min((s, i) for i, s in slots.items() if s is not None)[1]
    firsts = list(dict.fromkeys(order))
    assert [slots[i] for i in firsts] == sorted(slots[i] for i in firsts)
    monkeypatch.setattr(mixing, "golden_step", lambda slots: 1)
    other_slots, other_order, same = made()
    assert same == taken and other_slots != slots and other_order != order


def test_many_sources(spark):
    """Running sums over ranges, targets and slots of more sources than there are ranges."""
    rng = random.Random(12)
    rows = [(i, "w " * rng.choice((0, 1, 30, 900)), f"s{rng.randrange(70)}" if rng.random() < 0.98 else None) for i in range(400)]
    out = mixing.mix(mixing.sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")))[1].collect()
    check_mix(out, {r[2] for r in rows})


def test_mix_odd(spark, odd_docs, empty_docs, clashing):
    out = mixing.mix(mixing.sizes(odd_docs))[1].collect()
    assert len(out) == odd_docs.count()
    check_mix(out, {r["source"] for r in out})
    assert mixing.mix(mixing.sizes(empty_docs))[1].count() == 0
    blank = mixing.mix(mixing.sizes(odd_docs.withColumn("text", F.lit(None).cast("string"))))[1].collect()
    assert {(r["taken"], r["target"]) for r in blank} == {(0, 0.0)}
    mixed = mixing.mixed_documents(clashing)
    assert mixed.columns == clashing.columns
    assert mixed.select(F.sum(mixing.words("text"))).first()[0] == sum(r["taken"] for r in out) and mixed.where("n_chars <> length(text)").count() == 0
    named = mixing.mix(mixing.sizes(clashing))[1].collect()
    assert sorted((r["taken"], r["size"]) for r in named) == sorted((r["taken"], r["size"]) for r in out)
    nothing = mixing.mixed_documents(empty_docs)
    assert nothing.columns == empty_docs.columns and nothing.count() == 0


# packing


def check_pack(rows, docs, library):
    sequences, left = defaultdict(list), defaultdict(int)
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in docs]
    by = defaultdict(list)
    for i, x in ids:
        by[i].append(x)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = [x[r["start"] : r["start"] + r["length"]] for x in by[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert r["ids_crc32"] in {zlib.crc32(struct.pack(f"<{len(p)}I", *p)) for p in part}
        left[r["doc_id"]] += r["length"]
    assert left == {i: sum(map(len, x)) for i, x in by.items()}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= packing.CAPACITY
    return sum(map(len, (x for _, x in ids))) / (len(sequences) * packing.CAPACITY)


def test_pack(spark, odd_docs, empty_docs):
    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    docs = [(i, prose(rng, rng.randint(1, 1500))) for i in range(150)]
    out = packing.pack(packing.cut_documents(spark.createDataFrame(docs, "doc_id long, text string"), VOCABULARY)).collect()
    assert check_pack(out, docs, library) > 0.96
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check_pack(packing.pack(packing.cut_documents(odd_docs, VOCABULARY)).collect(), odd, library)
    assert packing.pack(packing.cut_documents(empty_docs, VOCABULARY)).count() == 0


def test_pack_cuts_what_does_not_go_together(spark):
    """Rests of a little over half a sequence: whole, each would take a sequence of its own."""
    library = Tokenizer.from_file(VOCABULARY)
    docs = [(i, "the " * (1100 + i % 3)) for i in range(60)]
    out = packing.pack(packing.cut_documents(spark.createDataFrame(docs, "doc_id long, text string"), VOCABULARY)).collect()
    assert check_pack(out, docs, library) > 0.95 and len({r["sequence_id"] for r in out}) <= 34


def test_checksum_of_a_rest():
    rng = random.Random(3)
    data = rng.randbytes(9000)
    for at, end in [(0, 0), (0, 9000), (1, 2), (256, 8192), (8999, 9000), *((rng.randrange(4000), rng.randrange(4000, 9000)) for _ in range(30))]:
        assert packing._rest_checksum(zlib.crc32(data[:end]), zlib.crc32(data[:at]), end - at) == zlib.crc32(data[at:end])


@pytest.mark.parametrize("lengths", [[138], [175], [238], [129, 131, 255], list(range(140, 256)), [86], [4, 250]])
def test_cuts_leave_little_padding(lengths):
    """Whatever the lengths: parts are multiples of the grid, no more rests are cut than there are, and the gaps are gone."""
    rng = np.random.default_rng(2)
    demand = np.zeros(256, dtype=np.int64)
    demand[np.array(lengths) - 1] = rng.integers(500, 2000, len(lengths))
    total = int(demand @ np.arange(1, 257))
    cut = demand.copy()
    for length, parts, n in packing.choose_cuts(demand, 256, 4):
        assert n > 0 and all(p > 0 and p % 4 == 0 for p in parts) and sum(parts) < length
        cut[length - 1] -= n
        for p in (*parts, length - sum(parts)):
            cut[p - 1] += n
    assert (cut[np.array(lengths) - 1] >= 0).all() and int(cut @ np.arange(1, 257)) == total
    assert packing.plan(cut, 256)["sequences"] <= 1.02 * total / 256 + 2


def test_linear_program():
    """Against the bound by total length, which is reached where small lengths abound."""
    rng = np.random.default_rng(0)
    demand = rng.integers(50, 500, 64)
    demand[32:] //= 8
    patterns, amount = packing.solve(demand, 64)
    assert np.allclose((patterns * amount[:, None]).sum(axis=0), demand) and (patterns @ np.arange(1, 65) <= 64).all()
    bound = (demand * np.arange(1, 65)).sum() / 64
    assert bound - 1e-6 <= amount.sum() <= bound * 1.001
    whole, copies = packing.whole_patterns(demand, 64)
    assert ((whole * copies[:, None]).sum(axis=0) == demand).all() and copies.sum() <= bound * 1.01 + 2
    assert packing.plan(np.zeros(64, dtype=np.int64), 64)["sequences"] == 0
    one = np.zeros(64, dtype=np.int64)
    one[63] = 5
    assert packing.plan(one, 64)["sequences"] == 5


# SimHash


def plain_fingerprint(text, shingle=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \x0b\x1c", "One", "one TWO", "a b c", "É é A\u00a0b c d", prose(rng, 500)]
    got = [simhash.fingerprint((t or "").encode()) & (1 << 64) - 1 for t in texts]
    assert got == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert [simhash.fingerprint((t or "").encode()) & (1 << 64) - 1 for t in texts] == got
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert xxhash.xxh64_intdigest(b"a b c", 42) == row["h"] & (1 << 64) - 1


def test_anchors(spark):
    rng = random.Random(0)
    fps = [rng.getrandbits(64) - (1 << 63) for _ in range(40)] + [0, -1, 1, (1 << 63) - 1]
    for r in spark.createDataFrame([(x,) for x in fps], "fp long").select("fp", simhash.anchors(F.col("fp")).alias("a")).collect():
        low = r["fp"] & (1 << 63) - 1
        assert len(set(r["a"])) == len(r["a"]) in (1, 32)
        for a in r["a"]:
            syndrome = 0
            for i in range(63):
                syndrome ^= (i + 1) * (a >> i & 1)
            assert syndrome == 0 and bin(a ^ low).count("1") <= 2


@pytest.mark.parametrize("seed", [1, 2])
def test_links(spark, seed):
    rng = random.Random(seed)
    points = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 8))):
            points.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    points = sorted(points)
    base = rng.getrandbits(64)  # a dense ball
    points = sorted({*points, *(base ^ (1 << i) for i in range(64)), *(base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i))})
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                parent[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = simhash.links(spark.createDataFrame([(signed(p),) for p in points], "fp long")).collect()
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") in (1, 2) for r in out)
    got = {p: p for p in points}

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in out:
        got[root(r["a"] & (1 << 64) - 1)] = root(r["b"] & (1 << 64) - 1)
    groups = lambda f: sorted(sorted(p for p in points if f(p) == r) for r in {f(p) for p in points})
    assert groups(root) == groups(find)


def test_near_duplicates(spark, odd_docs, odd_texts, empty_docs, clashing):
    out = simhash.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[0]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (0, 1, 2)} == {0} and by[8]["component_id"] == 7
    assert by[7]["fingerprint"] == f"{plain_fingerprint(odd_texts[7]):016x}" and by[None]["component_id"] is None
    kept = simhash.representatives(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()))
    assert ids == [-1, 0, 3, 4, 5, 5, 6, 7, 9, 10, 11]  # 1, 2 and 8 are copies; of the three equal rows of 5 one stays, and its other text
    assert simhash.near_duplicates(empty_docs).count() == 0 and simhash.representatives(empty_docs).count() == 0


# vectors


def odd_vectors(spark, rng, n=300, size=16):
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(size)]
        for _ in range(rng.choice((1, 1, 1, 3))):
            rows.append([len(rows), [x + rng.gauss(0, 0.08) for x in v], 0])
    rows += [[len(rows) + k, v, None] for k, v in enumerate([None, [], [0.0] * size, [None] * size, [float("nan")] + [1.0] * (size - 1), [float("inf")] * size, [1.0] * 3, [2.0] * 3, [1e30] * size, [-1e30] * size])]
    rows += [[len(rows) + k, rows[0][1], 1] for k in range(30)] + [rows[1], [None, rows[2][1], 1]]
    schema = "vec_id long, embedding array<float>, label int"
    return spark.createDataFrame(rows, schema).withColumns({"uid": F.lit(1), "rid": F.lit(2), "n": F.lit(3), "v": F.lit(4), "size": F.lit(5)})


def usable(rows):
    out = []
    for k, r in enumerate(rows):
        v = r["embedding"]
        if v and all(x is not None and np.isfinite(x) for x in v):
            out.append((k, r["vec_id"], np.array(v, dtype=np.float64)))
    return out


def test_search(spark):
    df = odd_vectors(spark, random.Random(3))
    rows = usable(df.collect())
    quantised = search.quantised(df)
    out = search.nearest(quantised, search.stated_queries(quantised, 10), 5, group=700, asked=90).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = lambda v: [int(np.floor(x * 256)) for x in v]
    queries = [(k, i, v) for k, i, v in rows if i is not None and i % 10 == 0]
    assert set(got) == {i for _, i, _ in queries}
    for k, i, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(whole(v), whole(w))), j if j is not None else search.NO_ID) for m, j, w in rows if m != k and len(w) == len(v))
        beyond = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
        wanted = sorted((-beyond(-s), j) for s, j in scored)[:5]
        assert [(-s, j if j is not None else search.NO_ID) for _, j, s in got[i]] == wanted


def test_search_odd(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5, -0.5]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    rows = search.quantised(df)
    out = sorted(map(tuple, search.nearest(rows, search.stated_queries(rows, 50), 5).collect()))
    self_ = 256 * 256 + 512 * 512
    cross = 256 * 128 + 512 * -128
    assert out == sorted([(0, 1, 0, self_), (0, 2, 3, 0), (0, 3, 50, cross)] * 2 + [(50, 1, 3, 0), (50, 2, 0, cross), (50, 3, 0, cross)])
    nothing = search.quantised(df.limit(0))
    assert search.nearest(nothing, nothing, 5).count() == 0


def test_branch_and_bound():
    rng = np.random.default_rng(5)
    for size, step in ((8, 3), (64, 16), (5, 16)):
        rows = rng.integers(-200, 200, (400, size)).astype(float)
        rows[100:150] = rows[:50]
        columns, squares = np.ascontiguousarray(rows.T), (rows**2).sum(axis=1)
        ids = rng.permutation(400)
        for q in range(0, 400, 37):
            scored = sorted((-int(rows[q] @ rows[j]), int(ids[j])) for j in range(400) if j != q)[:5]
            assert [(-s, int(ids[p])) for s, p in search.top(rows[q], q, columns, squares, np.arange(400), ids, 5, step=step)] == scored
            bar = -scored[2][0]
            reached = [x for x in scored if -x[0] >= bar]
            assert [(-s, int(ids[p])) for s, p in search.top(rows[q], q, columns, squares, np.arange(400), ids, 5, bar, step)][: len(reached)] == reached


@pytest.mark.parametrize("block", [1 << 19, 40 * 16])
def test_vectors(spark, block):
    df = odd_vectors(spark, random.Random(7)).where("vec_id IS NULL OR vec_id NOT IN (SELECT 1 WHERE false)")
    all_rows = df.collect()
    rows = [(k, i, v / np.abs(v).max()) for k, i, v in usable(all_rows) if np.abs(v).max() > 0]
    links = defaultdict(set)
    for k, _, v in rows:
        for m, _, w in rows:
            if k != m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.95:
                links[k].add(m)
    expected = []
    for k, r in enumerate(all_rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [all_rows[m]["vec_id"] for m in seen if all_rows[m]["vec_id"] is not None]
        least = min(ids, default=None)
        expected.append((r["vec_id"], len(links[k]), least, r["vec_id"] == least))
    out = sorted(map(tuple, vectors.near_duplicates(df, block=block).collect()), key=repr)
    assert out == sorted(expected, key=repr)


def test_block_pairs(spark):
    """Against all pairs of boxes, over several levels of intervals, with few rows for any key of the joins."""
    rng = np.random.default_rng(3)
    at = np.sort(rng.normal(0, 1, (3000, 3)), axis=0) + rng.normal(0, 0.05, (3000, 3))
    rows = spark.createDataFrame([(4, i // 10, x.tolist()) for i, x in enumerate(at)], "size int, block long, at array<double>")
    low, high = at.reshape(300, 10, 3).min(axis=1), at.reshape(300, 10, 3).max(axis=1)
    gap = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
    wanted = {(a, b) for a, b in np.argwhere((gap**2).sum(axis=2) <= 0.01).tolist() if a <= b}
    got = [(r["a"], r["b"]) for r in vectors.block_pairs(rows, 0.1, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) < 300 * 301 / 4
    assert [(r["a"], r["b"]) for r in vectors.block_pairs(rows.where("block = 7"), 0.1).collect()] == [(7, 7)]


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(df).count() == 0
    alone = spark.createDataFrame([(5, None), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.near_duplicates(alone).collect())) == [(3, 0, 3, True), (5, 0, 5, True)]


def test_mixed_rows_take_one_way_at_every_size(spark, odd_docs):
    """Whole rows meet their slots in a shuffle, never by a broadcast: the shuffles of a small table grow in proportion."""
    plan = mixing.mixed_documents(odd_docs)._jdf.queryExecution().executedPlan().toString()
    last = plan.split("SortMergeJoin")[0]
    assert "SortMergeJoin [uid" in plan and "BroadcastHashJoin" not in last
