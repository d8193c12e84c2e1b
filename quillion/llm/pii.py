"""Personal data: fixed patterns, and terms that give a protected entity away by what the corpus tells.

Base spans come from four patterns. Each value found is a protected entity. A term is a word (a letter, then letters and
numbers) of a document outside its e-mail addresses. Over all N documents, whole texts,

    PMI(t, e) = log(N * n(t, e) / (n(t) * n(e))),    IC(e) = log(N / n(e)),

where n(t, e) counts the documents that have both, n(t) those that have t and n(e) those that have e. PMI / IC is the share
of the entity's information that the term discloses. In every document that has e, all occurrences of a term that discloses
``GENERALISE`` of it or more, in ``SUPPORT`` documents at least, are generalised to the kind of word that they are; from ``REMOVE`` on they are
removed. Documents without base spans have nothing to protect and are left alone.

A share of g or more needs n(t) <= n(e) * (N / n(e)) ** (1 - g), so only entities of several documents and terms under that
bound are paired, in the documents that have both. Entities found in just the same documents are one class there, and so are terms: the copies of a
long list are one pair, not its entries times its words.

All of it is DataFrame functions. Matches become rows (a document's parts with their lengths), positions running sums, counts are combined
before the shuffle, and texts are rebuilt from chunks of ``CHUNK`` characters: the work is linear in a text (but for sorting), whatever it holds.

Positions are code points, ends exclusive. Matches are leftmost and do not overlap within a kind; the
patterns below match what the plain ones do, with possessive repeats, so that no long run of digits or letters is
scanned twice and no match recurses. Words are folded to lower case, İ to i.

Defined results: a null text is an empty one, without spans, and stays null; repeated rows and repeated ids are documents of their own and count
each; very long texts are whole like any others; a term that a base span overlaps is no span; columns may have any names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stash

#: In the order of the kinds; fixed values.
KINDS = ("email", "ip", "card", "phone", "general", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
TERM = r"\p{L}[\p{L}\p{N}]*+"
#: What stands between terms, and the numbers that the next one's run begins with.
BETWEEN = r"[^\p{L}\p{N}]+\p{N}*"
PLACEHOLDERS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", None, "")

#: The least length of a term.
SHORTEST = 3
SUPPORT = 2
GENERALISE = 0.9
REMOVE = 0.98
#: Characters of a text that are rebuilt at a time.
CHUNK = 1024

#: Stand around matches; those in a text are read as the next character, which no pattern has either.
MARK, INNER, OTHER = "\ue000", "\ue002", "\ue001"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    digits = F.reverse(_digits(s))
    value = lambda i: F.substring(digits, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i) - F.when(value(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: Column, s: Column) -> Column:
    ip, card, phone = map(KINDS.index, ("ip", "card", "phone"))
    return F.when(kind == ip, s.rlike(OCTETS)).when(kind == card, _luhn(s)).when(kind == phone, F.length(_digits(s)).between(9, 15)).otherwise(True)


def _needs(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit(NEEDS[kind])) if kind == "email" else text.rlike(NEEDS[kind])


def _cut(text: Column, pattern: str, mark: str) -> Column:
    """The text in parts, the pattern's matches at the odd places."""
    return F.split(F.regexp_replace(text, pattern, f"{mark}$0{mark}"), mark, -1)


def _clean(text: Column) -> Column:
    return F.translate(text, MARK + INNER, OTHER + OTHER)


def _whole() -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _loud(text: Column) -> Column:
    """Whether a text that is not null may have base spans."""
    loud = F.lit(False)
    for kind in PATTERNS:
        loud = loud | _needs(text, kind)
    return loud


def prepared(docs: DataFrame, *kept: Column) -> DataFrame:
    """uid, the columns kept, text (not null) and loud (it may have base spans), written to the shared folder."""
    return stash(docs.select(F.monotonically_increasing_id().alias("uid"), *kept, _whole().alias("text")).withColumn("loud", _loud(F.col("text"))), "texts")


def base_spans(rows: DataFrame) -> DataFrame:
    """uid, kind, start, stop and entity: a digest of the kind and the value, a row for each base span; written to the shared folder."""
    text = F.col("text")
    tried = [F.when(_needs(text, kind), F.struct(F.lit(k).alias("kind"), _cut(_clean(text), pattern, MARK).alias("parts"))) for k, (kind, pattern) in enumerate(PATTERNS.items())]
    parts = rows.where("loud").select("uid", F.explode(F.array_compact(F.array(*tried))).alias("p")).where(F.size("p.parts") > 1)
    parts = parts.select("uid", "p.kind", F.posexplode("p.parts").alias("pos", "part"))
    parts = parts.select("uid", "kind", "pos", F.length("part").alias("size"), F.when(F.col("pos") % 2 == 1, F.col("part")).alias("value"))
    order = Window.partitionBy("uid", "kind").orderBy("pos")
    spans = parts.withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).where("pos % 2 = 1")
    spans = spans.where(_valid(F.col("kind"), F.col("value")))
    # letters in lower case; digits alone but in an address
    value = F.when(F.col("kind") >= KINDS.index("card"), _digits(F.col("value"))).otherwise(F.lower("value"))
    return stash(spans.select("uid", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop", F.xxhash64("kind", value).alias("entity")), "spans")


def _folded(text: Column) -> Column:
    """The text in lower case, character by character: İ alone would become two, of which one is no letter."""
    return F.lower(F.when(F.contains(text, F.lit("İ")), F.translate(text, "İ", "i")).otherwise(text))


def _terms(rows: DataFrame, *kept: str) -> DataFrame:
    """The columns kept and term: a text's different terms, those in its e-mail addresses left out."""
    text = F.col("text")
    blank = F.when(_needs(text, "email"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    words = F.array_distinct(F.split(F.concat(F.lit(" "), _folded(blank)), BETWEEN))
    return rows.select(*kept, F.explode(words).alias("term")).where(F.length("term") >= SHORTEST)


def _classes(df: DataFrame, name: str, count: str) -> DataFrame:
    """name, count (of uids), class: the same for all that have the same uids and the same number."""
    sets = df.groupBy(name).agg(F.any_value(count).alias(count), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("y"))
    return sets.select(name, count, F.xxhash64("x", "y", count).alias(f"{name}_class"))


def disclosures(rows: DataFrame, spans: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, texts: DataFrame | None = None) -> DataFrame:
    """uid, term, kind: the terms of a document that disclose too much of one of its entities; written to the shared folder.

    texts: the column text of all documents, where rows has only those that may have base spans."""
    texts = rows if texts is None else texts
    n = texts.count()
    held = spans.select("uid", "entity").distinct()
    numbers = held.groupBy("entity").agg(F.count("*").alias("n_entity")).where((F.col("n_entity") >= support) & (F.col("n_entity") < n))
    held = stash(held.join(small(numbers), "entity"), "entities")
    bound = lambda c: c * F.pow(F.lit(float(max(n, 1))) / c, 1 - generalise) * (1 + 1e-9)
    most = held.agg(F.coalesce(bound(F.max("n_entity").cast("double")), F.lit(0.0))).first()[0]
    touched = held.select("uid").distinct()
    words = _terms(texts).groupBy("term").agg(F.count("*").alias("n_term"))  # every document counts
    rare = small(words.where((F.col("n_term") >= support) & (F.col("n_term") <= most)))
    has = stash(_terms(rows.where("loud").join(small(touched), "uid", "left_semi"), "uid").join(rare, "term"), "terms")

    entities, terms = _classes(held, "entity", "n_entity"), _classes(has, "term", "n_term")
    entity_of = held.select("uid", "entity").join(entities, "entity").select("uid", "entity_class", "n_entity").distinct()
    terms = stash(terms, "classes")
    term_of = has.select("uid", "term").join(terms, "term").select("uid", "term_class", "n_term").distinct()
    entity_of, term_of = stash(entity_of, "entity-classes"), stash(term_of, "term-classes")
    met = entity_of.join(term_of, "uid").where(F.col("n_term") <= bound(F.col("n_entity").cast("double")))
    pairs = met.groupBy("entity_class", "term_class", "n_entity", "n_term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    both, term, entity = (F.col(c).cast("double") for c in ("n_both", "n_term", "n_entity"))
    share = F.log(n * both / (term * entity)) / F.log(n / entity)
    kind = F.when(F.col("share") >= remove, KINDS.index("term")).otherwise(KINDS.index("general"))
    shown = small(pairs.withColumn("share", share).where(F.col("share") >= generalise).select("entity_class", "term_class", kind.alias("kind")))
    found = met.join(shown, ["entity_class", "term_class"]).groupBy("uid", "term_class").agg(F.max("kind").alias("kind"))
    named = found.join(has.select("uid", "term").join(terms.select("term", "term_class"), "term"), ["uid", "term_class"])
    return stash(named.select("uid", "term", "kind"), "disclosures")


def term_spans(rows: DataFrame, spans: DataFrame, shown: DataFrame) -> DataFrame:
    """uid, kind, start, stop, mark: every occurrence of a document's disclosing terms that no base span overlaps."""
    text = _clean(F.col("text"))

    def pieces(form) -> Column:
        """The text in parts, terms and addresses at the odd places, what is outside addresses in the form."""
        outside = lambda x: _cut(form(x), TERM, INNER)
        split = F.flatten(F.transform(_cut(text, PATTERNS["email"], MARK), lambda x, i: F.when(i % 2 == 1, F.array(x)).otherwise(outside(x))))
        return F.when(_needs(F.col("text"), "email"), split).otherwise(outside(text))

    touched = rows.where("loud").join(small(shown.select("uid").distinct()), "uid", "left_semi")
    both = F.arrays_zip(pieces(lambda x: x).alias("part"), pieces(_folded).alias("term"))
    parts = touched.select("uid", F.posexplode(both).alias("pos", "p")).select("uid", "pos", "p.part", "p.term")
    word = F.when((F.col("pos") % 2 == 1) & ~F.contains("part", F.lit("@")), F.col("part"))
    parts = parts.select("uid", "pos", F.length("part").alias("size"), word.alias("word"), "term")
    order = Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    words = parts.withColumn("stop", F.sum("size").over(order).cast("int")).where(F.length("word") >= SHORTEST)
    mark = F.when(F.col("word").rlike(r"\p{N}"), "[CODE]").when(F.col("word").rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    words = words.select("uid", "term", (F.col("stop") - F.col("size")).alias("start"), "stop", mark.alias("mark"))
    added = words.join(shown, ["uid", "term"]).select("uid", "kind", "start", "stop", "mark")
    both = added.unionByName(spans.join(small(shown.select("uid").distinct()), "uid", "left_semi").select("uid", "kind", "start", "stop", F.lit(None).cast("string").alias("mark")))
    base = F.col("kind") < len(PATTERNS)
    before = Window.partitionBy("uid").orderBy("start", "stop", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("uid").orderBy(F.col("start").desc(), F.col("stop").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("left", F.max(F.when(base, F.col("stop"))).over(before)).withColumn("right", F.min(F.when(base, F.col("start"))).over(after))
    free = (F.coalesce("left", F.lit(0)) <= F.col("start")) & (F.col("right").isNull() | (F.col("right") >= F.col("stop")))
    return both.where(~base & free).drop("left", "right")


def all_spans(rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """uid, kind, start, stop, mark: base spans and those of terms; texts as in disclosures()."""
    spans = base_spans(rows)
    added = term_spans(rows, spans, disclosures(rows, spans, texts=texts))
    marks = F.array(*map(F.lit, PLACEHOLDERS))
    both = spans.select("uid", "kind", "start", "stop", F.lit(None).cast("string").alias("mark")).unionByName(added)
    return both.withColumn("mark", F.coalesce(F.element_at(marks, F.col("kind") + 1), "mark"))


def listed(spans: Column) -> Column:
    """kind:start:stop, joined by commas, of an array of (start, kind, stop)."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans, their digest and all spans."""
    rows = prepared(docs.select("doc_id", "text"), F.col("doc_id"))
    span = F.struct("start", "kind", "stop")
    base = len(PATTERNS)
    numbers = [F.count_if(F.col("kind") == k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    found = all_spans(rows).groupBy("uid").agg(*numbers, F.array_sort(F.collect_list(span)).alias("spans"))
    found = found.withColumn("base", listed(F.filter("spans", lambda s: s["kind"] < base))).withColumn("spans", listed(F.col("spans")))

    def out(df: DataFrame, present: bool) -> DataFrame:
        counts = [(F.coalesce(f"n_{kind}", F.lit(0)) if present else F.lit(0)).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
        spans = [F.coalesce(c, F.lit("")) if present else F.lit("") for c in ("base", "spans")]
        return df.select("doc_id", *counts, F.sha2(spans[0], 256).alias("base_sha256"), spans[1].alias("spans"))

    ids = rows.select("uid", "doc_id", "loud")
    return out(ids.where("loud").join(found, "uid", "left"), True).unionByName(out(ids.where("NOT loud"), False))


def _rebuilt(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """uid and text of the rows that have spans, with each span's mark in its place; what spans overlap goes as one, with the first one's."""
    order = Window.partitionBy("uid").orderBy("start", "kind", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cuts = spans.withColumn("new", (F.coalesce(before, F.lit(-1)) <= F.col("start")).cast("int"))
    cuts = cuts.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = cuts.groupBy("uid", "nth").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(F.when(F.col("new") == 1, F.col("mark"))).alias("mark"))
    last = F.floor((F.col("stop") - 1) / CHUNK).cast("int")
    cuts = cuts.withColumn("no", F.explode(F.sequence(F.floor(F.col("start") / CHUNK).cast("int"), last)))
    low, high = F.greatest(F.col("start") - F.col("no") * CHUNK, F.lit(0)), F.least(F.col("stop") - F.col("no") * CHUNK, F.lit(CHUNK))
    mark = F.when(F.col("start") >= F.col("no") * CHUNK, F.col("mark")).otherwise("")
    cuts = cuts.groupBy("uid", "no").agg(F.array_sort(F.collect_list(F.struct(low.alias("low"), high.alias("high"), mark.alias("mark")))).alias("cuts"))
    touched = rows.where("loud").join(small(spans.select("uid").distinct()), "uid", "left_semi")
    chunks = touched.select("uid", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("no", "chunk"))

    def step(a: Column, c: Column) -> Column:
        kept = F.substring(F.col("chunk"), a["at"] + 1, c["low"] - a["at"])
        return F.struct(c["high"].alias("at"), F.concat(a["out"], kept, c["mark"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    made = F.aggregate("cuts", start, step, lambda a: F.concat(a["out"], F.substring(F.col("chunk"), a["at"] + 1, F.lit(CHUNK))))
    chunks = chunks.join(cuts, ["uid", "no"], "left").select("uid", "no", F.when(F.col("cuts").isNull(), F.col("chunk")).otherwise(made).alias("chunk"))
    whole = chunks.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("no", "chunk"))).alias("chunks"))
    return whole.select("uid", F.array_join(F.transform("chunks", lambda c: c["chunk"]), "").alias("made"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with the text sanitised, and n_chars its length if docs has it; a null text stays null.

    Only documents that may have base spans are written in between; docs is read four times and must give the same rows each time."""
    rows = prepared(docs.where(_loud(_whole())), F.struct("*").alias("row"))
    made = _rebuilt(rows, stash(all_spans(rows, docs.select(_whole().alias("text"))), "all-spans"))
    loud = rows.select("uid", "row").join(made, "uid", "left").select("row", F.coalesce("made", F.col("row.text").cast("string")).alias("text"))
    quiet = docs.where(~_loud(_whole())).select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    rows = loud.unionByName(quiet)
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return rows.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
