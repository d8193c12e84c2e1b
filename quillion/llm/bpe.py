"""Byte-pair merging with a heap over a linked list, and the split into words that goes before it.

A word starts as one symbol for each of its bytes, the last one marked as a word's end. The heap holds the
adjacent pairs that have a merge rank; the lowest rank is popped, leftmost first, its two symbols become one in
the linked list, and the two new neighbours join the heap. An entry whose pair is gone is dropped as it comes up.
A word costs O(n log n) whatever its length. The count is the symbols at the start less the merges made.
"""

from __future__ import annotations

import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

#: Letters and numbers up to U+00FF, by the rule of their Unicode category.
_LETTERS = "".join(chr(i) for i in range(256) if unicodedata.category(chr(i))[0] == "L")
_NUMBERS = "".join(chr(i) for i in range(256) if unicodedata.category(chr(i))[0] == "N")
#: White space up to U+00FF by its Unicode property, which Python's own class exceeds by U+001C to U+001F.
_SPACE = "\\t-\\r \\x85\\xa0"
#: The vocabulary's word pattern, for texts up to U+00FF.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+"
#: Positions in a word take so many bits of a heap entry.
_BITS = 40
#: Words remembered by a worker, at most; beyond that it starts anew.
REMEMBERED = 250_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load(path: str) -> dict:
    """What executors need of a vocabulary file: plain values, of the vocabulary's fixed size."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    stand_in = {b: c for c, b in byte_symbols().items()}
    ranks, made = {}, []
    for rank, (a, b) in enumerate(spec["model"]["merges"]):
        ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
        made.append(vocab[a + b])
    return {
        "inner": [vocab[stand_in[b]] for b in range(256)],
        "final": [vocab[stand_in[b] + suffix] for b in range(256)],
        "ranks": ranks,
        "made": made,
        "special": {x["content"]: x["id"] for x in spec["added_tokens"]},
        "text": text,
    }


def merged(symbols: list[int], ranks: dict[int, int], made: list[int]) -> tuple[list[int], int]:
    """The symbols after all merges, and how many merges were made."""
    n = len(symbols)
    if n == 1:
        return symbols, 0
    heap = []
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        rank = ranks.get(left << 20 | right)
        if rank is not None:
            heap.append(rank << _BITS | i - 1)
        left = right
    if not heap:
        return symbols, 0
    heapify(heap)
    after, before, count = list(range(1, n + 1)), list(range(-1, n)), 0
    mask, get = (1 << _BITS) - 1, ranks.get
    while heap:
        entry = heappop(heap)
        i = entry & mask
        j = after[i]
        if j >= n or symbols[i] < 0 or get(symbols[i] << 20 | symbols[j]) != entry >> _BITS:
            continue
        symbols[i] = symbol = made[entry >> _BITS]
        symbols[j] = -1
        after[i] = k = after[j]
        count += 1
        if k < n:
            before[k] = i
            rank = get(symbol << 20 | symbols[k])
            if rank is not None:
                heappush(heap, rank << _BITS | i)
        h = before[i]
        if h >= 0:
            rank = get(symbols[h] << 20 | symbol)
            if rank is not None:
                heappush(heap, rank << _BITS | h)
    return symbols, count


class Words:
    """Splits texts into words as the vocabulary's library does. Anything it cannot split itself with certainty
    (a character above U+00FF) goes to the library's own splitter."""

    def __init__(self, state: dict):
        self.state = state
        self.find = re.compile(PATTERN).findall
        self.wide = re.compile("[^\x00-\xff]").search
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(state["special"], key=len, reverse=True))) + ")")

    def library(self):
        if "_library" not in self.state:
            from tokenizers import Tokenizer

            self.state["_library"] = Tokenizer.from_str(self.state["text"])
        return self.state["_library"]

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if self.wide(text):
            own, back = self.library(), byte_symbols()
            parts = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))
            return [bytes(back[c] for c in x).decode("utf-8", "surrogateescape") for x, _ in parts]
        return self.find(text.lower())

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stand at the odd places."""
        return self.special.split(text) if "<|" in text else [text]


def remembered(state: dict, kind: str, make) -> dict:
    """A worker's memory of words, kept with the broadcast vocabulary over tasks."""

    class Memory(dict):
        def __missing__(self, word: str):
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value = make(word)
            return value

    if kind not in state:
        state[kind] = Memory()
    return state[kind]


def counter(state: dict):
    """A function from a word to its number of tokens, by merging alone."""
    inner, final, ranks, made = state["inner"], state["final"], state["ranks"], state["made"]

    def count(word: str) -> int:
        data = word.encode("utf-8", "surrogateescape")
        symbols = [inner[b] for b in data]
        symbols[-1] = final[data[-1]]
        return len(data) - merged(symbols, ranks, made)[1]

    return count
