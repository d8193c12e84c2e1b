import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillion.llm import pii
from quillion.llm.shared import noting


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    found = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for k, (pattern, good) in enumerate(
        [
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
        ]
    ):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return sorted(found)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("0123456789  --..+@()abcé𝄞%\ue000\n") for _ in range(rng.choice((5, 40, 300)))) for _ in range(800)]
    return made + [
        None, "", "1" * 50_000, "a" * 50_000 + "@b.c", "1.1.1.1." * 2000, "a@b.c+d@e.f x a@b.c.d+e@f.g@h.i", "4111 1111-1111 1111 +1 (988) 555-2485", "256.1.1.1 001.2.3.255 1.2.3.4.5",
        "4111111111111112 4111111111111111", "+1 23 +1234567890123456 +12345678", "12-" * 20_000,
    ]


def test_base_spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        spans = brute(text or "")
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert out[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text
        assert [out[i][f"n_{kind}"] for kind in ("email", "ip", "card", "phone")] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert [x for x in out[i]["spans"].split(",") if x and x.split(":")[0] not in ("general", "term")] == [x for x in listed.split(",") if x]


def report(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}


def test_terms(spark):
    """A word that comes only with one address gives it away, wherever it stands; one that comes everywhere does not."""
    far = "the common words here " * 20
    docs = [f"Zebulon {far}zebulon. write to z0@x.org soon and more common words"] * 3
    docs += ["the common words here near us write soon and more common words to all"] * 40
    docs += ["Zebulona is another word, no address here"]
    out = report(spark, docs)
    second = 8 + len(far)
    mail = second + 18
    assert out[0] == f"term:0:7,term:{second}:{second + 7},email:{mail}:{mail + 8}" and out[0] == out[1] == out[2]
    assert {out[i] for i in out if i >= 3} == {""}


def test_words_are_whole_and_folded_after_they_are_cut(spark):
    """No part of a word is a term, İ is a letter, numbers before a letter are not, and words inside addresses are none."""
    docs = ["the İstanbul q1bcd 9xyz9 a0@b.org the"] * 4 + ["the İstanbul"] * 4 + ["bcd xyz9 the"] * 12 + ["the other words"] * 30
    out = report(spark, docs)
    assert out[0] == "term:13:18,email:25:33"  # İstanbul has four documents without the address, xyz9 twelve
    docs = ["the İstanbul, mail zara.zara@b.org"] * 3 + ["the common"] * 50 + ["zara the"] * 9
    assert report(spark, docs)[0] == "term:4:12,term:14:18,email:19:34"  # zara is a word of others, and not cut out of the address


def shares(docs):
    """{(document, term): greatest share}, by plain counts."""
    def entities(t):
        return {(k, re.sub("[^0-9]", "", t[s:e]) if k > 1 else t[s:e].lower()) for s, k, e in brute(t)}

    def terms(t):
        rest = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", " ", t)
        return {w.lower() for w in re.findall(r"[^\W\d_]\w*", rest) if len(w) >= 3}

    e, t, n = [entities(d) for d in docs], [terms(d) for d in docs], len(docs)
    out = {}
    for i in range(n):
        for entity in e[i]:
            n_e = sum(entity in x for x in e)
            for term in t[i]:
                both, n_t = sum(entity in x and term in y for x, y in zip(e, t)), sum(term in y for y in t)
                if both >= pii.SUPPORT and n_e < n:
                    share = math.log(n * both / (n_t * n_e)) / math.log(n / n_e)
                    out[i, term] = max(out.get((i, term), -9), share)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosures_against_plain_counts(spark, seed):
    rng = random.Random(seed)
    words = [f"word{chr(97 + i)}" for i in range(26)]
    docs = []
    for _ in range(120):
        line = [rng.choice(words[: rng.choice((3, 26))]) for _ in range(5)]
        for _ in range(rng.choice((0, 0, 1, 2))):
            k = rng.randrange(12)
            line.insert(rng.randrange(5), rng.choice([f"m{k}@x.org", f"10.0.0.{k}", f"Own{k}x m{k}@x.org"]))
        docs.append(" ".join(line))
    docs += docs[:3] * 4  # copies
    rows = pii.prepared(spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string"), F.col("doc_id"))
    ids = {r["uid"]: r["doc_id"] for r in rows.collect()}
    spans = pii.base_spans(rows)
    wanted = shares(docs)
    for low, high in ((0.9, 0.98), (0.3, 0.5)):
        got = {(ids[r["uid"]], r["term"]): r["kind"] for r in pii.disclosures(rows, spans, low, high).collect()}
        assert got == {k: 5 if s >= high else 4 for k, s in wanted.items() if s >= low}
        assert got


def test_generalised_words_keep_their_kind(spark):
    spans = spark.createDataFrame([(0, 0, 4, "[NAME]", 4), (0, 5, 9, "", 5), (0, 8, 12, "[IP]", 1), (0, 2047, 2050, "[X]", 4)], "uid long, start int, stop int, mark string, kind int")
    text = "Anna bert c d" + "-" * 3000
    rows = spark.createDataFrame([(0, text, True)], "uid long, text string, loud boolean")
    assert pii._rebuilt(rows, spans).first()["made"] == "[NAME] d" + "-" * (2047 - 13) + "[X]" + "-" * (3013 - 2050)


def test_many_matches_in_one_text(spark):
    """A text of 100,000 addresses, twice: linear work, each entry a span, none of them all-pairs."""
    text = " ".join(f"word{i} m{i}@x{i}.org" for i in range(100_000))
    docs = spark.createDataFrame([(0, text), (1, text), (2, "nothing here")], "doc_id long, text string")
    began = time.monotonic()
    out = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert out[0]["n_email"] == out[1]["n_email"] == 100_000 and out[2]["spans"] == ""
    made = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert made[0].count("[EMAIL]") == 100_000 and "@" not in made[0] and made[2] == "nothing here"
    assert time.monotonic() - began < 120


def test_report_odd(spark, odd_docs, empty_docs, clashing):
    out = pii.report(clashing).collect()
    assert len(out) == odd_docs.count() and sorted(map(tuple, out), key=repr) == sorted(map(tuple, pii.report(odd_docs).collect()), key=repr)
    assert pii.report(empty_docs).count() == 0


def test_sanitise(spark, odd_docs, empty_docs, clashing):
    docs = spark.createDataFrame([(1, "mail a.b@c.de or +1 (988) 555-2485, card 4111 1111 1111 1111, ip 10.0.0.1.", 1), (2, "clean text", 1), (3, None, None)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert out[1]["text"] == "mail [EMAIL] or [PHONE], card [CARD], ip [IP]." and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "clean text" and out[3]["text"] is None
    for given in (odd_docs, clashing, empty_docs):
        cleaned = pii.sanitise(given)
        assert cleaned.columns == given.columns and cleaned.count() == given.count()
        assert not [r for r in cleaned.collect() if "@" in (r["text"] or "")]


def test_only_texts_that_may_have_spans_are_written(spark):
    """Of the texts none is written twice, and those without personal data not at all; their terms count all the same."""
    docs = [f"plain words number {'abcdefgh'[i % 8]}" for i in range(40)] + ["Ada a1@x.org words", "Ada a1@x.org", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    paths = []
    with noting(paths):
        made = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    texts = [p for p in paths if "quillion-texts-" in p]
    assert [spark.read.parquet(p).count() for p in texts] == [2]
    assert [made[i] for i in range(40)] == docs[:40] and made[42] is None
    assert made[40] == " [EMAIL] words" and made[41] == " [EMAIL]"
