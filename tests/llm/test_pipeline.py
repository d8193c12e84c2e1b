import random
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillion.llm import queries, simhash
from quillion.llm.shared import stash

from test_sets import brute_targets

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    answer = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(answer.fetchall(), key=repr)


def test_stages(spark):
    first = docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, DATA), name)
        sizes.append(docs.count())
        if name != "sequences":
            assert docs.columns == first.columns
        if name == "near_duplicates":
            marked = simhash.near_duplicates(docs, shingle=5)
            assert marked.select("component_id").distinct().count() == docs.count()
        if name == "personal_data":
            assert docs.where(r"text rlike '[A-Za-z0-9]@[a-z0-9]+\\.[a-z]'").count() == 0
    assert sizes[0] >= sizes[1] == sizes[2] and sizes[-1] > 0


def kept_by_plain_means(docs):
    """The documents that the first two stages keep: those with a letter, one of each group of five-word similarity 0.8 or more."""
    letters = [d for d in docs if d["text"] and any(c.isalpha() for c in d["text"])]

    def grams(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    own = [grams(d["text"]) for d in letters]
    root = list(range(len(letters)))
    for i, a in enumerate(own):
        for j in range(i):
            if root[i] != root[j] and len(a & own[j]) >= 0.8 * len(a | own[j]):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    return [min((d for d, r in zip(letters, root) if r == k), key=lambda d: d["doc_id"]) for k in set(root)]


def test_run_against_plain_means(spark):
    """Groups and sources of a made corpus: who is kept, how many words each source gives, and every token packed once."""
    rng = random.Random(21)
    vocabulary = [a + b for a in "ba de ki lo mu na pe".split() for b in "ran tel vos mik".split()]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 150))]
        for copy in range(rng.choice((1, 1, 2, 4))):
            words = list(base)
            if copy:
                words[rng.randrange(len(words))] = "changed"
            rows.append((n, " ".join(words) + (f" mail u{n}@x.org" if n % 9 == 0 else ""), "en", rng.choice("abc"), 0))
            n += 1
    rows += [(n, None, "en", "a", None), (n + 1, "12 34", None, None, 0), (n + 2, rows[3][1], "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages, now = dict(corpus_pipeline.STAGES), docs
    kept = kept_by_plain_means([r.asDict() for r in docs.collect()])
    for name in ("language", "near_duplicates"):
        now = stash(stages[name](spark, now, DATA), name)
    assert sorted(r["doc_id"] for r in now.collect()) == sorted(d["doc_id"] for d in kept)
    clean = stash(stages["personal_data"](spark, now, DATA), "clean")
    assert {r["doc_id"] for r in clean.collect()} == {d["doc_id"] for d in kept} and clean.where("text LIKE '%@%'").count() == 0
    mixed = stash(stages["mixture"](spark, clean, DATA), "mixed")
    sizes, taken = Counter(), Counter()
    for r in clean.collect():
        sizes[r["source"]] += len(r["text"].split())
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
    wanted = brute_targets(dict(sizes))
    assert all(0 <= wanted[s] - taken[s] < 1 for s in sizes)
    packed = stages["sequences"](spark, mixed, DATA).collect()
    library = Tokenizer.from_file(queries.vocabulary())
    tokens = Counter()
    for r in mixed.collect():
        tokens[r["doc_id"]] += len(library.encode(r["text"], add_special_tokens=False).ids) + 1
    assert tokens == sum((Counter({r["doc_id"]: r["length"]}) for r in packed), Counter())


def test_run_of_nothing(spark, empty_docs):
    now = empty_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stash(stage(spark, now, DATA), name)
        assert now.columns == empty_docs.columns and now.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, DATA).count() == 0


def test_run_again(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, DATA).drop("sequence_id", "offset").collect())) for _ in range(2))
    assert a == b
