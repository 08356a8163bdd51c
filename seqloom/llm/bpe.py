"""Byte-level BPE on ragged numpy arrays.

A text falls into chunks (white space with the word after it), a chunk into the pre-tokens of the public
pattern. Pre-tokens are merged together: in each step every unfinished sequence applies its own
lowest-rank pair at all its places. Both steps see each distinct chunk or pre-token of a batch once.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

from seqloom.llm.common import WHITE

NONE = np.iinfo(np.int64).max
#: Sequences above this many symbols are merged one by one with a heap: a step costs all of a
#: sequence's length, and long ones take many steps. Both ways give the same symbols.
LONG = 512

#: Cuts where the public pattern always cuts: white space belongs to a chunk only as one blank before it.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: The public pattern with white space spelled out, since libraries differ over the control characters.
PRETOKEN = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
SIMPLE_MARKS = frozenset(".,;:!?")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in .json vocabularies: itself where it prints, else the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Pairs of symbols that merge, by rank: `single` maps a byte to its symbol, `keys` (sorted) holds
    left * size + right, `ranks` and `made` the rank and the new symbol of each. `final` maps a word's last
    byte, where the vocabulary marks word ends."""

    def __init__(self, size: int, single: np.ndarray, rules: dict[tuple[int, int], tuple[int, int]], final: np.ndarray | None = None):
        self.size, self.single, self.rules = size, single, rules
        self.final = single if final is None else final
        keys = np.array([a * size + b for a, b in rules], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in rules.values()], dtype=np.int64)[order]
        self.made = np.array([m for _, m in rules.values()], dtype=np.int64)[order]

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words on end, and how many each word has."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols, ends = self.single[flat], np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.final[flat[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        long_words = np.flatnonzero(sizes > LONG)
        apart = {int(i): self._by_heap(words[i]) for i in long_words}
        done_symbols, done_owner = [np.array(s, dtype=np.int64) for s in apart.values()], [np.full(len(s), i) for i, s in apart.items()]
        if apart:
            short = sizes[owner] <= LONG
            symbols, owner = symbols[short], owner[short]
        rank, made = self._looked_up(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            finished = least == NONE
            if finished.any():
                done_symbols.append(symbols[finished])
                done_owner.append(owner[finished])
            place = np.flatnonzero((rank == least) & ~finished)
            if len(place) > 1 and (np.diff(place) == 1).any():
                # A run of overlapping places (one symbol repeated): every other one, from the left.
                begins = np.r_[True, np.diff(place) != 1]
                run = place[begins][np.cumsum(begins) - 1]
                place = place[(place - run) % 2 == 0]
            symbols[place] = made[place]
            kept = ~finished
            kept[place + 1] = False
            # Only pairs with a new symbol in them have a new rank.
            fresh = np.zeros(len(symbols), dtype=bool)
            fresh[place] = True
            symbols, owner, rank, made, fresh = symbols[kept], owner[kept], rank[kept], made[kept], fresh[kept]
            fresh[:-1] |= fresh[1:]
            again = np.flatnonzero(fresh)
            if len(again):
                rank[again], made[again] = self._looked_up(symbols, owner, again)
        every, owners = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_owner, owner]).astype(np.int64)
        order = np.argsort(owners, kind="stable")
        return every[order], np.bincount(owners, minlength=len(words))

    def _looked_up(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and new symbol of the pair that begins at each of the places; NONE where no rule holds."""
        right = np.minimum(at + 1, len(symbols) - 1)
        pair = symbols[at] * self.size + symbols[right]
        found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        fits = (self.keys[found] == pair) & (owner[at] == owner[right]) & (right > at)
        return np.where(fits, self.ranks[found], NONE), self.made[found]

    def _by_heap(self, word: bytes) -> list[int]:
        symbol: list[int] = [*(int(self.single[b]) for b in word[:-1]), int(self.final[word[-1]])]
        following, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        heap = [(self.rules[p][0], i, p) for i, p in enumerate(zip(symbol, symbol[1:])) if p in self.rules]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = following[i]
            if symbol[i] < 0 or j >= len(symbol) or (symbol[i], symbol[j]) != pair:
                continue
            symbol[i], symbol[j] = self.rules[pair][1], -1
            following[i] = following[j]
            if following[i] < len(symbol):
                before[following[i]] = i
            for left, right in ((before[i], i), (i, following[i])):
                if left >= 0 and right < len(symbol) and (p := (symbol[left], symbol[right])) in self.rules:
                    heapq.heappush(heap, (self.rules[p][0], left, p))
        return [s for s in symbol if s >= 0]


@lru_cache(2)
def json_merges(path: str) -> Merges:
    """Merge rules as a .json vocabulary lists them."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, letters = model["vocab"], byte_letters()
    end = model.get("end_of_word_suffix") or ""
    single, final = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for letter, byte in letters.items():
        single[byte], final[byte] = vocab[letter], vocab[letter + end]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Merges(max(vocab.values()) + 1, single, {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}, final)


def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(2)
def rank_merges(path: str) -> Merges:
    """Merge rules of a file of ranks: any two tokens whose bytes together are a token, at that token's rank."""
    ranks = rank_table(path)
    single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    rules = {(ranks[t[:k]], ranks[t[k:]]): (r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
    return Merges(max(ranks.values()) + 1, single, rules)


def pretokens(chunk: str) -> list[str]:
    """Pre-tokens of one chunk; plain words, alone or with a mark after them, need no pattern."""
    word = chunk[1:] if chunk[0] == " " else chunk
    if word.isalpha():
        return [chunk]
    if word[-1:] in SIMPLE_MARKS and word[:-1].isalpha():
        return [chunk[:-1], word[-1]]
    return PRETOKEN.findall(chunk)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")
