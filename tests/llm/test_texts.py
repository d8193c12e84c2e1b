"""Licences, token counts, URLs, language."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillion.llm import bpe, langid, licenses, tokens, urls

from helpers import prose

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# licences


def brute_dice(text, similarity):
    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return Counter(zip(w, w[1:]))

    own, best = grams(text), None
    for name, known in licenses.templates():
        g = grams(known)
        total = sum(own.values()) + sum(g.values())
        d = 2 * sum((own & g).values()) / total if total else 0
        if own and d >= similarity - 1e-12:
            best = min(best or (0, 0, "~"), (-d, -sum(g.values()), name))
    return best


def test_licence_units():
    text = "a\nb\n\nc\n \nd"
    assert [text[s:e] for s, e in licenses.units(text)] == ["a", "b", "a\nb", "c", "d", text]


def test_licence_against_brute_force():
    rng = random.Random(5)
    scanner = licenses.Scanner(licenses.templates())
    known = [t for _, t in licenses.templates()]
    for _ in range(400):
        words = rng.choice(known).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["the", "License", "zzz", "x y"])
        text = " ".join(words + ["extra"] * rng.randint(0, 3))
        got, wanted = scanner.match(text), brute_dice(text, licenses.SIMILARITY)
        assert (got and (-got[0], -got[1], got[2])) == wanted


def test_licence_scan(spark, odd_docs, empty_docs):
    out = {r["doc_id"]: r for r in licenses.scan(odd_docs).collect()}
    assert out[10]["license"] == "MIT" and out[10]["dice"] == 1 and out[10]["matches"] == "MIT:0:31"
    assert out[0]["license"] is None and out[0]["n_matches"] == 0 and licenses.scan(odd_docs).count() == odd_docs.count()
    assert licenses.scan(empty_docs).count() == 0


def test_licence_inside_a_document(spark):
    """A licence text before code or between other paragraphs, and a notice inside a longer line, with where they stand."""
    mit = licenses.TEXTS["MIT"].replace(". ", ".\n\n")
    code = "\n".join(f"int value{i} = compute(value{i + 1}, {i});" for i in range(60))
    line = "See the README for details. This package is Licensed under the MIT License. Copyright held by all of its many authors since then"
    rows = [(0, mit + "\n\n" + code), (1, f"İ {code}\n\n{mit}\n\n{mit}\n{code}"), (2, line), (3, code)]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i]["license"] for i in range(4)] == ["MIT", "MIT", "MIT", None]
    spans = {i: [tuple(map(int, x.split(":")[1:])) for x in out[i]["matches"].split(",")] for i in range(3)}
    assert out[0]["dice"] > 0.97 and spans[0] == [(0, len(mit) - 1)]
    first = len(code) + 4
    assert len(spans[1]) == 2 and spans[1][0] == (first, first + len(mit) - 1)
    assert line[slice(*spans[2][0])] == "Licensed under the MIT License"


@pytest.mark.parametrize("line", ["# SPDX-License-Identifier: {}", "/* spdx-license-identifier: {} */", "SPDX-License-Identifier: {}"])
def test_licence_identifiers(line):
    scanner = licenses.Scanner(licenses.templates())
    for licence in licenses.NAMES:
        assert scanner.match(line.format(licence))[2] == licence


@pytest.mark.parametrize("licence", sorted(licenses.FILES))
def test_full_licence_texts(licence):
    text = open(f"/usr/share/common-licenses/{licenses.FILES[licence]}", encoding="utf-8").read()
    assert licenses.Scanner(licenses.templates()).match(text)[2] == licence


# tokens


def test_merging_is_the_libraries():
    rng = random.Random(2)
    state = bpe.load(VOCABULARY)
    words, count, library = bpe.Words(state), bpe.counter(state), Tokenizer.from_file(VOCABULARY)
    texts = [prose(rng, 50), "x" * 5000, "aaaa" * 700 + "b", "É't 'S we'Ll ²½Ⅷ 12३ ǅ ﬁ I\u0307 İ", "a<|endoftext|>b<|startoftext|><|endoftext|>", "<|endoftext", "\x1c\x85\xa0\u3000a\u200bb", "ΑΣ ΑΣΑ", "日本語 テスト", "e\u0301 é", "_a_b__1"]
    texts += ["".join(rng.choice("abzéß'’ \t\n0½ΣİÅ<|>_-日") for _ in range(60)) for _ in range(300)]
    for text in texts:
        parts = words.segments(text)
        n = len(parts) // 2 + sum(count(w) for x in parts[::2] for w in words.split(x))
        assert n == len(library.encode(text, add_special_tokens=False).ids), text


def test_split_is_the_librarys_for_every_character():
    state = bpe.load(VOCABULARY)
    words, count, library = bpe.Words(state), bpe.counter(state), Tokenizer.from_file(VOCABULARY)
    for text in [form.format(chr(i)) for i in range(256) for form in ("a{}b", "{0}{0}1 {0}", "'{0}s {0}'ll", "!{}?")]:
        assert sum(map(count, words.split(text))) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_counts(spark, odd_docs, odd_texts, empty_docs):
    library = Tokenizer.from_file(VOCABULARY)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    out = tokens.count_tokens(odd_docs, VOCABULARY, ["doc_id"]).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] != 5:
            text = odd_texts[r["doc_id"]]
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), size(text), size(text) > 2048)
    assert tokens.count_tokens(empty_docs, VOCABULARY, ["doc_id"]).count() == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    memory = bpe.remembered({}, "k", len)
    assert [memory[w] for w in ("a", "bb", "ccc", "dddd", "a", "bb")] == [1, 2, 3, 4, 1, 2] and len(memory) <= 3


# URLs


def brute_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and (slash + path).startswith(p)]
    return host, slash + path, *(max(fits)[1:] if fits else (None, "allow"))


def test_urls(spark):
    given = [None, "", "no url", "http://", "HTTP://EXAMPLE.ORG/es/x", "http://a.b.example.org/en/1", "http://example.org/en/12?x#y", "http://example.org/en/2", "http://org/", "http://org", "http://xorg/",
             "http://a.com/fr/1", "http://a.com/de/", "http://a.com/d", "x://y://z.org/a", "http://É.org/es/", "http://..org/", "http://a.org?q=/es/", "http://a.org#/x", "http://example.org/es/", "http://" + "a." * 5000 + "org/" + "p" * 100_000]
    rows = [(i, u, None) for i, u in enumerate(given)] + [(4, given[4], None), (None, given[4], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "path": F.lit(1), "rule": F.lit(2), "key": F.lit(3)})
    out = urls.judge(pages, urls.rules_frame(spark, urls.RULES)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(((i, *brute_verdict(u)) for i, u, _ in rows), key=repr)
    assert urls.judge(pages.limit(0), urls.rules_frame(spark, urls.RULES)).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, urls.rules_frame(spark, []), default="block").collect()} == {"block"}


# language


@pytest.fixture(scope="module")
def speakers(spark):
    rng = random.Random(9)
    kinds = {"en": "the and ing tion er st ou re", "de": "der die ung sch keit ein ü ß", "es": "el ción ado que ñ os ar í"}
    rows = [(i, prose(rng, rng.randint(5, 80), kinds[lang]), lang) for i, lang in enumerate(list(kinds) * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_language(spark, speakers):
    docs, rows = speakers
    held = [r["h"] for r in docs.select("doc_id", (langid.remainder() == 2).alias("h")).orderBy("doc_id").collect()]
    import zlib

    assert held == [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows] and any(held)
    model = langid.fit(docs)
    out = langid.identify(docs, model, ["doc_id", "lang"]).collect()
    assert all(r["lang"] == r["lang_pred"] and 0.3 < r["score"] <= 1 for r in out)


def counted(texts):
    """A model's counts of (lang, text), by the operator's own counting."""
    import pandas as pd
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": [x for x, _ in texts], "text": [t for _, t in texts]})
    parts = [b.to_pandas() for b in langid._counts(iter([batch]))]
    return pd.concat(parts).groupby(["lang", "gram"], as_index=False)["n"].sum()


def plain_lengths(learned, text):
    """Prediction by partial matching as it is defined: counts by context, probabilities by recursion."""
    import math

    fold = lambda t: [0, 0, 0, *(b + 32 if 65 <= b <= 90 else b for b in t.encode())]
    out = {}
    for lang in sorted({x for x, _ in learned}):
        tables = [defaultdict(Counter) for _ in range(4)]
        for s in (fold(t) for x, t in learned if x == lang):
            for i in range(3, len(s)):
                for k in range(4):
                    tables[k][tuple(s[i - k : i])][s[i]] += 1

        def p(k, context, x):
            if k < 0:
                return 1 / 256
            seen = tables[k][tuple(context[3 - k :])]
            if not seen:
                return p(k - 1, context, x)
            total = sum(seen.values()) + len(seen)
            if x in seen:
                return seen[x] / total
            return len(seen) / total * p(k - 1, context, x) / (1 - sum(p(k - 1, context, y) for y in seen))

        s = fold(text)
        out[lang] = sum(-math.log2(p(3, s[i - 3 : i], s[i])) for i in range(3, len(s)))
    return out


def test_code_lengths():
    """Against prediction by partial matching without tables or folding of sums, scripts of many bytes included."""
    learned = [("de", "Der Übergang über die Brücke, der Fuß"), ("en", "The thing that the other thing thought"), ("ja", "日本語のテスト、日本の本"), ("ru", "Это тест. Этот тест прост"), ("en", "\0 and \0\0b")]
    model = langid.Model(counted(learned))
    assert model.languages == ["de", "en", "ja", "ru"]
    texts = [t for _, t in learned] + ["", "a", "Ü", "the über", "日本", "тест日本the", "\0", "zzz\x7f\0\0", "Thing over the Fuß 本テ " * 5]
    got = model.lengths([t.encode() for t in texts]) / langid.UNIT
    for row, text in zip(got, texts):
        plain = plain_lengths(learned, text)
        assert row == pytest.approx([plain[x] for x in model.languages], abs=1e-3), text
    langs, scores = model.predict([t.encode() for t in texts] + [None])
    assert langs[:5] == [x for x, _ in learned] and langs[5] == langs[-1] == "und" and scores[-1] == 0


def test_rare_scripts_are_told_apart():
    """More byte values than a small alphabet holds: every language of a script of its own, and two of one script."""
    rng = random.Random(4)
    letters = [c for c in map(chr, range(0x400, 0x2000)) if c.isalpha()]
    kinds = {f"s{k}": " ".join(letters[40 * k : 40 * k + 40]) for k in range(40)}
    kinds |= {"t0": "абв где", "t1": "абг вде"}
    learned = [(x, prose(rng, 60, k)) for x, k in kinds.items()]
    model = langid.Model(counted(learned))
    held = [(x, prose(rng, 20, k)) for x, k in kinds.items()]
    assert model.predict([t.encode() for _, t in held])[0] == [x for x, _ in held]


def test_repeated_ids_lose_no_language(spark):
    rows = [(i % 5, f"der die und das Wort{i % 400} ist", "de") for i in range(3000)] + [(100 + i, f"the word{i} and this is it", "en") for i in range(300)]
    rows += [(9, "le mot et la chose", "fr")] * 4000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=16)
    kept = {r["lang"] for r in docs.where(langid.remainder() != 2).select("lang").distinct().collect()}
    assert model.languages == sorted(kept) and {"de", "en"} <= kept


def test_held_out_accuracy(spark, speakers):
    """Only documents that are not learned from, of a model that learned from few."""
    docs, _ = speakers
    model = langid.fit(docs, per_language=8)
    out = langid.identify(docs.where(langid.remainder() == 2), model, ["lang"]).collect()
    assert len(out) > 20 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)


def test_model_is_bounded(spark, speakers, monkeypatch):
    monkeypatch.setattr(langid, "SEQUENCES", 50)
    model = langid.fit(speakers[0])
    assert len(model.seen3) <= 150 and len(model.languages) == 3
    assert langid.identify(speakers[0], model, ["lang"]).where("lang = lang_pred").count() > 170


def test_language_chunks(spark, speakers, monkeypatch):
    docs, rows = speakers
    model = langid.fit(docs)
    texts = [r[1].encode() for r in rows[:30]] + [b"x" * 5000]
    whole = model.lengths(texts)
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert (model.lengths(texts) == whole).all()


def test_language_odd(spark, odd_docs, empty_docs, clashing, speakers):
    model = langid.fit(speakers[0])
    out = langid.identify(odd_docs, model, ["doc_id"]).collect()
    assert len(out) == odd_docs.count()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert {by[i] for i in (0, 1, 2, 3)} == {("und", 0.0)} and by[4][0] != "und" and by[6][0] != "und"
    nothing = langid.fit(empty_docs)
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.identify(odd_docs, nothing, ["doc_id"]).collect()} == {"und"}
    kept = langid.accepted(clashing)
    assert kept.columns == clashing.columns and kept.schema["uid"] == clashing.schema["uid"] and kept.count() == odd_docs.count() - 4
    assert langid.accepted(empty_docs).count() == 0
