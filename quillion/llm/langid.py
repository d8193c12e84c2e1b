"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes (orders 3 to 0, then uniform) is fitted and frozen.
In a context seen n times with d different successors, a successor seen c times has probability c / (n + d) and
d / (n + d) is the escape probability, spread over the others as the next shorter context has them (method C
with exclusion, so that the probabilities of a context add up to 1). A text's code length under a language is
the sum over its bytes; the shortest one wins.

All 256 byte values are symbols; A-Z count as a-z, and three zero bytes stand before a text. Code lengths are
held as integers of 1/65536 bit, so sums do not depend on how rows are split into batches. Only sequences that were
seen have entries, those of four bytes in a hash table, the others found by binary search.

Fitting reads whole texts of at most ``per_language`` different documents of each language (different by doc_id or text, those of least hash, among the
part of the hash range that is sure to hold them), counted on the executors. Of a language's sequences of four bytes
the ``SEQUENCES`` most frequent are kept, or so many that a table of all languages' sequences by all languages has ``CELLS``
cells at most: that bounds what the driver gets, what is broadcast and what a worker holds, whatever the texts and the number of
languages. Scoring covers every byte of every text.

Defined results: ``und`` with score 0 for a null or empty text, one without a letter, or if nothing could be learned;
ties go to the first language in code-point order; a null doc_id is neither learned from nor held out; repeated rows count
once in what is learned and are each predicted; a very long text is scored in parts, with the same sum; columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, small, small_batches

#: Documents of each language that are learned from, at most.
PER_LANGUAGE = 256
#: Tasks that count the sample, at most.
FIT_TASKS = 8
#: Four-byte sequences of a language that are kept, and cells of the largest table, at most.
SEQUENCES = 1 << 16
CELLS = 1 << 24
UNIT = 1 << 16
UNDETERMINED = "und"
#: Bytes scored at a time, and rows returned at a time.
CHUNK = 1 << 18
ROWS = 256

_ascii_letter = re.compile(rb"[A-Za-z]").search


def remainder(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def has_letter(text: bytes) -> bool:
    return bool(_ascii_letter(text)) or any(map(str.isalpha, text.decode("utf-8", "ignore")))


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    return fold


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each after three zero bytes, and where each of those begins."""
    starts = np.cumsum([0] + [len(x) + 3 for x in texts])
    return np.frombuffer(b"".join(b"\0\0\0" + x for x in texts), dtype=np.uint8), starts


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram (four folded bytes), n."""
    fold = _fold()
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = _binary(batch.column(1))
        for lang in sorted(set(langs)):
            got: dict = {"gram": [], "n": []}
            for text in (texts[i] for i in np.flatnonzero(langs == lang)):
                for at in range(0, max(1, len(text)), CHUNK):
                    part = b"\0\0\0" + text[:CHUNK] if at == 0 else text[at - 3 : at + CHUNK]
                    x = fold[np.frombuffer(part, dtype=np.uint8)].astype(np.int64)
                    if len(x) > 3:
                        gram, n = np.unique(x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:], return_counts=True)
                        got["gram"].append(gram)
                        got["n"].append(n)
            if got["gram"]:
                merged = pd.DataFrame({k: np.concatenate(v) for k, v in got.items()}).groupby("gram")["n"].sum()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(merged)), pa.array(merged.index.to_numpy()), pa.array(merged.to_numpy())], ["lang", "gram", "n"])


#: Spreads sequences over a hash table.
_ODD = np.uint32(0x9E3779B1)


def _hashed(keys: np.ndarray) -> np.ndarray:
    """An open-addressed table of the places of different keys, -1 where it is empty; a quarter full at most."""
    bits = max(8, (4 * len(keys)).bit_length())
    table, left = np.full(1 << bits, -1, dtype=np.int32), np.arange(len(keys), dtype=np.int32)
    slot = keys * _ODD >> np.uint32(32 - bits)
    while len(left):
        free = np.flatnonzero(table[slot[left]] < 0)
        at, first = np.unique(slot[left[free]], return_index=True)
        table[at] = left[free[first]]
        left = np.delete(left, free[first])
        slot[left] = (slot[left] + np.uint32(1)) & np.uint32(len(table) - 1)  # the next one, where it is taken
    return table


def _look_up(table: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _find, by the hash table of the keys."""
    slot = wanted * _ODD >> np.uint32(32 - (len(table).bit_length() - 1))
    at = table[slot]
    there = (keys[at] == wanted) & (at >= 0)
    left = np.flatnonzero(~there & (at >= 0))
    while len(left):  # another key's slot: on to the next one
        slot[left] = (slot[left] + np.uint32(1)) & np.uint32(len(table) - 1)
        at[left] = found = table[slot[left]]
        there[left] = (found >= 0) & (keys[found] == wanted[left])
        left = left[~there[left] & (found >= 0)]
    return at, there


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places of wanted in the sorted table, whether they are there; any place if not)."""
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return at, table[at] == wanted


def _bits(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(p) * UNIT).astype(np.int32)


class Model:
    """Frozen code lengths, a column a language.

    ``after1`` has every byte after every byte. ``after2`` and ``after3`` have the sequences of three and four bytes that some
    language has (``seen2``, ``seen3``, sorted), ``escape2`` and ``escape3`` their contexts (``context2``, ``context3``). A
    sequence that none has costs its context's escape, or nothing if the context is new too, and what it costs in the next shorter one.
    """

    def __init__(self, counts: pd.DataFrame):
        """counts: lang, gram (four bytes, the first one highest), n; each sequence of a language once."""
        self.languages = sorted(counts["lang"].unique())
        every = counts["gram"].to_numpy().astype(np.int64)
        self.seen3 = np.unique(every).astype(np.uint32)
        self.seen2 = np.unique(every & 0xFFFFFF).astype(np.uint32)
        self.context3, self.context2 = np.unique(self.seen3 >> 8), np.unique(self.seen2 >> 8)
        self.places3 = _hashed(self.seen3)
        made: dict[str, list] = {k: [] for k in ("after1", "after2", "escape2", "after3", "escape3")}
        for lang in self.languages:
            own = counts[counts["lang"] == lang]
            for name, column in self._fit(own["gram"].to_numpy().astype(np.int64), own["n"].to_numpy().astype(np.float64)).items():
                made[name].append(column)
        for name, columns in made.items():
            setattr(self, name, np.stack(columns, axis=1) if columns else np.zeros((0, 0), dtype=np.int32))

    def _fit(self, gram: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        below = np.full((1, 256), 1 / 256)
        for order in range(2):
            c = np.bincount(gram & (256 ** (order + 1) - 1), weights=n, minlength=256 ** (order + 1)).reshape(-1, 256)
            lower = np.tile(below, (len(c) // len(below), 1))
            total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
            rest = np.where(c > 0, 0, lower).sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(c > 0, c / (total + np.where(rest > 0, kinds, 0)), kinds / (total + kinds) * lower / rest)
            below = np.where(total > 0, p, lower)
        out, below = {"after1": _bits(below).ravel()}, below.ravel()[self.seen2 & 0xFFFF]
        for order, seen, contexts in ((2, self.seen2, self.context2), (3, self.seen3, self.context3)):
            if order == 3:
                below = below[np.searchsorted(self.seen2, seen & 0xFFFFFF)]
            c = np.bincount(np.searchsorted(seen, gram & (256 ** (order + 1) - 1)), weights=n, minlength=len(seen))
            context = np.searchsorted(contexts, seen >> 8)
            by_context = lambda x: np.bincount(context, weights=x, minlength=len(contexts))  # noqa: B023, E731
            total, kinds = by_context(c), by_context(c > 0)
            rest = np.maximum(1 - by_context(np.where(c > 0, below, 0)), 1e-12)
            known = total > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                share = kinds / (total + kinds)
                escaped = np.where(known[context], share[context] / rest[context] * below, below)
                p = np.where(c > 0, c / (total + kinds)[context], escaped)
            escape = np.zeros(len(contexts))
            escape[known] = np.log2(rest[known]) - np.log2(share[known])
            out[f"after{order}"], out[f"escape{order}"] = _bits(p), np.rint(escape * UNIT).astype(np.int32)
            below = p
        return out

    def state(self) -> dict:
        """The arrays alone, as a broadcast carries them."""
        return dict(self.__dict__)

    @classmethod
    def of(cls, state: dict) -> Model:
        model = cls.__new__(cls)
        model.__dict__ = state
        return model

    def chunk(self) -> int:
        """Bytes scored at a time: fewer, the more languages there are."""
        return max(8, CHUNK // max(1, len(self.languages) // 4))

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in units, a row for each text and a column for each language."""
        out, chunk = np.zeros((len(texts), len(self.languages)), dtype=np.int64), self.chunk()
        group, held = [], 0
        first = 0
        for i, text in enumerate(texts):  # texts together up to a chunk; a longer one goes alone, in parts
            if held and held + len(text) > chunk:
                out[first:i] = self._group(group, chunk)
                first, group, held = i, [], 0
            group.append(text)
            held += len(text)
        if group:
            out[first:] = self._group(group, chunk)
        return out

    def _group(self, texts: list[bytes], chunk: int) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > 2 * chunk:
            text, out = texts[0], 0
            for at in range(0, len(text), chunk):
                part = b"\0\0\0" + text[:chunk] if at == 0 else text[at - 3 : at + chunk]
                out = out + self._costs(np.frombuffer(part, dtype=np.uint8)).sum(axis=0, dtype=np.int64)
            return out[None, :]
        raw, starts = _padded(texts)
        costs = self._costs(raw)
        total = np.zeros((len(costs) + 1, costs.shape[1]), dtype=np.int64)
        np.cumsum(costs, axis=0, dtype=np.int64, out=total[1:])
        return total[starts[1:] - 3] - total[starts[:-1]]  # cost i is that of byte i + 3

    def _costs(self, raw: np.ndarray) -> np.ndarray:
        """Of each byte but the first three."""
        x = _fold()[raw].astype(np.uint32)
        if len(x) < 4 or not len(self.seen3):
            return np.zeros((max(0, len(x) - 3), len(self.languages)), dtype=np.int32)
        pair = x[:-1] << 8 | x[1:]
        gram = pair[:-2] << 16 | pair[2:]
        at, there = _look_up(self.places3, self.seen3, gram)
        costs = self.after3[at]
        new = np.flatnonzero(~there)
        if len(new):
            gram = gram[new]
            at, there = _find(self.context3, gram >> 8)
            cost = self.escape3[at] * there[:, None]
            at, there = _find(self.seen2, gram & 0xFFFFFF)
            short = self.after2[at]
            newer = np.flatnonzero(~there)
            if len(newer):
                at, there = _find(self.context2, gram[newer] >> 8 & 0xFFFF)
                short[newer] = self.escape2[at] * there[:, None] + self.after1[gram[newer] & 0xFFFF]
            costs[new] = cost + short
        return costs

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        fit = [i for i, x in enumerate(texts) if x and self.languages and has_letter(x)]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if fit:
            bits = self.lengths([texts[i] for i in fit]) / UNIT
            best = bits.argmin(axis=1)
            worse = bits - bits.min(axis=1, keepdims=True)
            sure = 1 / np.exp2(-np.minimum(worse, 1000)).sum(axis=1)
            for i, b, s in zip(fit, best, sure):
                langs[i], scores[i] = self.languages[b], float(s)
        return langs, scores


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from documents with a text, a language and a crc32 of the doc_id that is not 2 modulo 4."""
    key = F.xxhash64("doc_id", "text")
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(remainder() != 2).select("lang", "text", key.alias("key"))
    different = labelled.select("lang", "key").distinct()
    many = small(different.groupBy("lang").agg(F.count("*").alias("n")))
    # about four times as many as are wanted have a hash in this part of the range; the least of them are taken
    part = (F.lit(4.0 * per_language) / F.col("n") - 0.5) * F.lit(2.0**64)
    drawn = different.join(many, "lang").where(F.col("key").cast("double") <= part)
    chosen = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("k") <= per_language)
    sample = labelled.join(small(chosen.select("lang", "key")), ["lang", "key"])
    sample = sample.groupBy("lang", "key").agg(F.min("text").alias("text"))  # a repeated row counts once
    # the sample is bounded, so a few tasks can count it and each sequence comes up in a few tasks only
    counts = sample.select("lang", "text").coalesce(FIT_TASKS).mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    most = min(SEQUENCES, CELLS // max(1, many.count()) ** 2)
    frequent = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return Model(counts.withColumn("k", frequent).where(F.col("k") <= most).drop("k").toPandas())


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score, from the text alone."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model.state())
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    n, at = len(keep), keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(held.value)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            langs, scores = model.predict(_binary(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.fieldNames())
        give_back()

    return docs.select(*keep, *([] if text in keep else [F.col(text).cast("string")])).mapInArrow(run, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """docs without those whose language is undetermined."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever docs calls its columns
    predicted = identify(docs.toDF(*names), fit(docs.select("doc_id", "text", "lang")), names, names[docs.columns.index("text")])
    return predicted.where(F.col("lang_pred") != UNDETERMINED).select(*names).toDF(*docs.columns)
