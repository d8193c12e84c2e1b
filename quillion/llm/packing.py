"""Packing documents into sequences as a cutting-stock problem, solved by column generation.

A document's ids are cut into whole sequences and a rest. The rests' lengths, in units of a few ids, make a
histogram of fixed size. A linear program over patterns (how many rests of each length share a sequence) is
solved on the driver: a knapsack dynamic program prices new patterns with the dual values until none pays, or
the bound shows the rest of the gap to be under ``GAP``. Patterns are used as often as the solution says,
rounded down; what is left over is filled largest first. Pieces are ranked within their length on the
executors, and a piece's rank says which copy of which pattern, and which place in it, it takes.

Rests stay whole where patterns fill sequences without cutting them. Where lengths do not go together (many rests of a
little over half a sequence, say) and more than ``SLACK`` of the sequences could be saved, those with the largest gaps are given up: their
rests are cut into parts of the sizes of the other sequences' gaps, and the program is solved again with the parts. Cuts fall on
multiples of ``GRID`` ids, up to which checksums are kept; that of a part is worked out from the two at its ends.

What the driver sees is bounded by the histogram (``capacity / unit`` lengths), never by the documents. A length
that a third of the pieces share is ranked in many buckets (see ``shared.ranked``).

Defined results: a null or empty text is the closing id alone; repeated rows and ids are packed each; a very long text is as many pieces as it
needs; a null doc_id stays null; columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import give_back, ranked, small_batches, stash

CAPACITY = 2048
#: Ids a unit of the histogram.
UNIT = 8
#: The gap to the linear program's bound at which generation stops.
GAP = 2e-4
#: The share of the sequences that is not worth a cut, and ids between the places where a rest can be cut.
SLACK = 0.003
GRID = 32
#: The id that closes each document.
CLOSING = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of doc_id and text: each full sequence, then the rest, with the checksum of their ids.

    marks: of a rest, the checksum of what is before each multiple of GRID inside it (32 bits each).
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(bpe.load(vocabulary))
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = held.value
        words, library = bpe.Words(state), bpe.Words(state).library()
        stand_in = {b: c for c, b in bpe.byte_symbols().items()}

        def ids(word: str) -> bytes:
            tokens = library.model.tokenize("".join([stand_in[b] for b in word.encode("utf-8", "surrogateescape")]))
            return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

        get = bpe.remembered(state, "_ids", ids).__getitem__
        special = {k: struct.pack("<I", v) for k, v in state["special"].items()}
        end = struct.pack("<I", CLOSING)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = words.segments(text.as_py())
                data = b"".join([special[x] if i % 2 else b"".join(map(get, words.split(x))) for i, x in enumerate(parts)]) + end
                n = len(data) // 4
                view = memoryview(data)
                for at in range(0, n, capacity):
                    to = min(n, at + capacity)
                    piece = view[4 * at : 4 * to]
                    for column, value in zip(out, (doc_id, at, to - at, zlib.crc32(piece), n, _marks(piece) if to - at < capacity else None)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:-1]), pa.array(out[-1], pa.binary())], names=[*names, "marks"])
        give_back()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"{PIECES}, marks binary")


def _marks(piece: memoryview) -> bytes:
    sums, so_far = [], 0
    for at in range(4 * GRID, len(piece), 4 * GRID):
        so_far = zlib.crc32(piece[at - 4 * GRID : at], so_far)
        sums.append(so_far)
    return struct.pack(f"<{len(sums)}I", *sums)


def _product(a: int, b: int) -> int:
    """Of two polynomials modulo that of CRC-32; the highest bit is the constant term."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def _rest_checksum(whole: int, before: int, length: int) -> int:
    """The checksum of the last ``length`` bytes, from those of all and of what is before them.

    Bytes that follow multiply what is before by x ** 8 each, and their own checksum is added.
    """
    power, factor = 1 << 31, 1 << 23  # x ** 0 and x ** 8
    while length:
        if length & 1:
            power = _product(power, factor)
        factor = _product(factor, factor)
        length >>= 1
    return whole ^ _product(power, before)


def _knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern (how often each length 1..len(value) is taken) and its value, lengths adding up to the capacity at most."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    m = len(value)
    for c in range(1, capacity + 1):
        k = min(m, c)
        sums = value[:k] + best[c - k : c][::-1]
        i = int(sums.argmax())
        if sums[i] > best[c - 1]:
            best[c], took[c] = sums[i], i + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(m, dtype=np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= int(took[c])
        else:
            c -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, how often each): a solution of the linear program that meets the demand of lengths 1..len(demand)."""
    used = np.flatnonzero(demand > 0)
    if not len(used):
        return np.zeros((0, len(demand)), dtype=np.int64), np.zeros(0)
    lengths, m = used + 1, len(used)
    need = demand[used].astype(np.float64)
    columns = [np.where(np.arange(m) == i, capacity // n, 0) for i, n in enumerate(lengths)]
    inverse = np.diag([1 / (capacity // n) for n in lengths])
    amount = inverse @ need
    scale, full = 1e-9 * need.sum(), np.zeros(capacity)
    for _ in range(rounds):
        full[:] = -1
        full[lengths - 1] = inverse.sum(axis=0)
        value, pattern = _knapsack(full, capacity)
        if value <= 1 + gap:  # by Farley's bound, patterns can save a share of ``gap`` at most
            break
        column = pattern[lengths - 1].astype(np.float64)
        direction = inverse @ column
        positive = direction > 1e-9
        if not positive.any():
            break
        ratio = np.where(positive, amount / np.where(positive, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = max(0.0, ratio[out])
        amount = amount - step * direction
        amount[out] = step
        amount[np.abs(amount) < scale] = 0
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        columns[out] = column
    patterns = np.zeros((m, len(demand)), dtype=np.int64)
    patterns[:, used] = np.array(columns).round().astype(np.int64)
    return patterns, np.maximum(amount, 0)


def choose_cuts(demand: np.ndarray, capacity: int, grid: int) -> list[tuple[int, tuple[int, ...], int]]:
    """[(length, parts to cut off, how many rests)]: parts, multiples of the grid, that fill the gaps of the sequences that stay."""
    patterns, copies = whole_patterns(demand, capacity)
    used = patterns @ np.arange(1, len(demand) + 1)
    sequences = int(copies.sum())
    if sequences + -int(used @ copies) // capacity <= SLACK * sequences:
        return []
    room = (capacity - used) // grid * grid
    free, given = int(room @ copies), 0
    gaps: Counter[int] = Counter()
    donors: Counter[int] = Counter()
    for k in np.argsort(-room, kind="stable"):
        # so many copies are given up that their contents go into what the others leave
        n = int(min(copies[k], max(0, free - given) // int(used[k] + room[k]))) if room[k] else 0
        free, given = free - n * int(room[k]), given + n * int(used[k])
        gaps[int(room[k])] += int(copies[k]) - n
        for i in np.flatnonzero(patterns[k]):
            donors[int(i) + 1] += n * int(patterns[k][i])
    out = []
    for length in sorted(donors, reverse=True):
        groups: list[tuple[int, int, tuple[int, ...]]] = [(donors[length], length, ())]
        while groups:
            n, left, parts = groups.pop()
            size = max((g for g in gaps if 0 < g < left and gaps[g] > 0), default=0)
            if not n:
                continue
            if not size or (whole := min((g for g in gaps if g >= left and gaps[g] > 0), default=0)) and whole - left < grid:
                fits = min((g for g in gaps if g >= left and gaps[g] > 0), default=0)
                gaps[fits] -= min(n, gaps[fits])
                if parts:
                    out.append((length, parts, n))
                continue
            each = (left - 1) // size
            served = min(n, gaps[size] // each)
            if not served:
                each, served = gaps[size], 1
            gaps[size] -= served * each
            groups += [(n - served, left, parts), (served, left - each * size, parts + (size,) * each)]
    return out


def whole_patterns(demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, copies) that use each length 1..len(demand) exactly as often as demanded."""
    patterns, amount = solve(demand, capacity, gap)
    copies = np.floor(amount + 1e-6).astype(np.int64)
    left = demand.astype(np.int64).copy()
    for k in range(len(patterns)):  # never more than there are, whatever the arithmetic rounded
        has = patterns[k] > 0
        copies[k] = min(copies[k], int((left[has] // patterns[k][has]).min()) if has.any() else 0)
        left -= copies[k] * patterns[k]
    more = []
    while left.any():
        room, pattern = capacity, np.zeros(len(demand), dtype=np.int64)
        while room:
            fits = np.flatnonzero(left[:room])
            if not len(fits):
                break
            n = int(fits[-1]) + 1
            take = min(int(left[n - 1]), room // n)
            pattern[n - 1] += take
            left[n - 1] -= take
            room -= take * n
        more.append(pattern)
    patterns = np.concatenate([patterns, np.array(more, dtype=np.int64).reshape(-1, len(demand))])
    copies = np.concatenate([copies, np.ones(len(more), dtype=np.int64)])
    return patterns[copies > 0], copies[copies > 0]


def plan(demand: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Sorted by length and rank: from which rank on pieces of a length go to a pattern, where its copies' sequences
    begin, how many pieces of the length each takes and the first one's place."""
    patterns, copies = whole_patterns(demand, capacity)
    base = np.concatenate([[0], np.cumsum(copies)])
    rows, taken = [], np.zeros(len(demand), dtype=np.int64)
    for k, pattern in enumerate(patterns):
        place = 0
        for i in np.flatnonzero(pattern)[::-1]:  # long pieces first
            rows.append((i + 1, taken[i], base[k], pattern[i], place))
            taken[i] += pattern[i] * copies[k]
            place += pattern[i]
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "base", "each", "place"), table.T)) | {"sequences": int(base[-1])}


def _histogram(pieces: DataFrame, units: int) -> np.ndarray:
    demand = np.zeros(units, dtype=np.int64)
    for row in pieces.groupBy("units").count().collect():  # a row a length
        demand[row["units"] - 1] = row["count"]
    return demand


def cut_rests(pieces: DataFrame, cuts: list[tuple[int, tuple[int, ...], int]], unit: int) -> DataFrame:
    """The pieces, with the first so many of each length in parts."""
    table = {length: [c for c in cuts if c[0] == length] for length, _, _ in cuts}
    ends = {length: np.cumsum([c[2] for c in own]) for length, own in table.items()}
    names = PIECES.replace(" long", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for r in batch.to_pylist():
                rows = [tuple(r[n] for n in names)]
                if r["units"] in ends and r["marks"] is not None and r["rank"] < ends[r["units"]][-1]:
                    parts = table[r["units"]][int(np.searchsorted(ends[r["units"]], r["rank"], side="right"))][1]
                    rows, at, before = [], 0, 0
                    for to in [*(unit * int(x) for x in np.cumsum(parts)), r["length"]]:
                        upto = struct.unpack_from("<I", r["marks"], 4 * (to // GRID - 1))[0] if to < r["length"] else r["ids_crc32"]
                        rows.append((r["doc_id"], r["start"] + at, to - at, _rest_checksum(upto, before, 4 * (to - at)), r["doc_tokens"]))
                        at, before = to, upto
                for row in rows:
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    order = [F.col(c) for c in ("doc_id", "start", "length", "ids_crc32")]
    return ranked(pieces, ["units"], order).select(*names, "marks", "units", "rank").mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """The pieces with sequence_id and offset."""
    if capacity % unit or GRID % unit:
        raise ValueError("the capacity and the grid must be multiples of the unit")
    measured = lambda df: df.withColumn("units", F.ceil(F.col("length") / unit).cast("int"))
    size = capacity // unit
    pieces = stash(measured(pieces), "pieces")
    demand = _histogram(pieces.where("marks IS NOT NULL"), size)
    if cuts := choose_cuts(demand, size, GRID // unit):
        pieces = stash(measured(cut_rests(pieces, cuts, unit)), "parts")
    pieces = pieces.drop("marks")
    where = plan(_histogram(pieces, size), size)
    starts = where["length"] << 40 | where["rank"]
    names = [*PIECES.replace(" long", "").split(", "), "sequence_id", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = dict(zip(batch.schema.names, batch.columns))
            rank = at["rank"].to_numpy(zero_copy_only=False)
            k = np.searchsorted(starts, at["units"].to_numpy(zero_copy_only=False).astype(np.int64) << 40 | rank, side="right") - 1
            nth = rank - where["rank"][k]
            sequence, place = where["base"][k] + nth // where["each"][k], where["place"][k] + nth % where["each"][k]
            yield pa.RecordBatch.from_arrays([*(at[n] for n in names[:-2]), pa.array(sequence), pa.array(place)], names=names)

    order = [F.col(c) for c in ("doc_id", "start", "length", "ids_crc32")]
    placed = ranked(pieces, ["units"], order).mapInArrow(run, f"{PIECES}, sequence_id long, place long")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names[:-1], F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
