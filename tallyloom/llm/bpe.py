"""Byte-pair merging over a heap and a linked list, and the byte-level vocabulary it runs on."""

from __future__ import annotations

import functools
import json
from heapq import heapify, heappop, heappush

import numpy as np
import regex

# The public byte-level splitting pattern, with white space spelt as the Unicode property.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SLOTS = 20  # bits of a place in the table of pairs


def slot(pair: np.ndarray) -> np.ndarray:
    return (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merge ranks by left and right symbol, each shifted so that a place fits below it, and what a rank merges to."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        none: dict[int, int] = {}
        self.ranks = [none] * size
        self.merges = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            if self.ranks[left] is none:
                self.ranks[left] = {}
            self.ranks[left][right] = rank << 32
            self.merges.append(vocab["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(letters)}
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def parts(self, text: str):
        """The text cut at the strings of special tokens: (part, id or None)."""
        if not self.special_split or not any(s in text for s in self.special):
            yield text, None
            return
        for part in self.special_split.split(text):
            if part:
                yield part, self.special.get(part)

    def merged(self, word: bytes) -> tuple[int, list[int]]:
        """Number of merges in a word, and its symbols with -1 where one went into its left neighbour.

        The heap holds rank and place of adjacent pairs, the lists hold each symbol's neighbours. An entry whose pair
        has changed since is skipped. Equal ranks are taken from the left.
        """
        ranks, merges = self.ranks, self.merges
        symbols = list(map(self.byte_ids.__getitem__, word))
        n, done = len(symbols), 0
        pair_at = [ranks[a].get(b) for a, b in zip(symbols, symbols[1:])]
        heap = [r | i for i, r in enumerate(pair_at) if r is not None]
        if not heap:
            return 0, symbols
        pair_at.append(None)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            if pair_at[i] != entry ^ i:
                continue
            j = after[i]
            symbols[i] = s = merges[entry >> 32]
            symbols[j] = -1
            pair_at[j] = None
            after[i] = k = after[j]
            done += 1
            if k < n:
                before[k] = i
                pair_at[i] = r = ranks[s].get(symbols[k])
                if r is not None:
                    heappush(heap, r | i)
            else:
                pair_at[i] = None
            h = before[i]
            if h >= 0:
                pair_at[h] = r = ranks[symbols[h]].get(s)
                if r is not None:
                    heappush(heap, r | h)
        return done, symbols

    def count(self, word: str) -> int:
        """Tokens of one pre-token: initial symbols minus merges; no identifiers are made."""
        word = word.encode("utf-8")
        return len(word) - self.merged(word)[0]

    def ids(self, word: str) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        return tuple(i for i in self.merged(word.encode("utf-8"))[1] if i >= 0)

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, ...]:
        """An open hash table of all pairs: slots that hold a pair's rank or -1, and by rank the pair's number (left * 2^32 +
        right) and what it merges to."""
        number = np.full(len(self.merges) + 1, -1, np.int64)
        slots = np.full(1 << SLOTS, -1, np.int32)
        for left, own in enumerate(self.ranks):
            for right, r in own.items():
                number[r >> 32] = left << 32 | right
        for rank, at in enumerate(slot(number[:-1]).tolist()):
            while slots[at] >= 0:
                at = at + 1 & len(slots) - 1
            slots[at] = rank
        return slots, number, np.array(self.merges or [0], np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; one more than the last rank for pairs that never merge."""
        slots, number, _ = self.pairs
        key = (left << 32 | right).ravel()
        at = slot(key)
        rank = slots[at]
        again = np.flatnonzero((number[rank] != key) & (rank >= 0))
        while len(again):
            at[again] = at[again] + 1 & len(slots) - 1
            rank[again] = slots[at[again]]
            again = again[(number[rank[again]] != key[again]) & (rank[again] >= 0)]
        return np.where(rank < 0, len(self.merges), rank).reshape(left.shape)

    def ids_of_block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pre-tokens of similar length, a row each, and how many there are in a row.

        All words are merged side by side: a round takes the lowest rank of each, the leftmost of equals, closes the gap
        and looks up the two pairs that changed. A word that has no pair left is done with.
        """
        merges = self.pairs[2]
        never = len(self.merges)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max()) + 1  # a place behind the end that no pair holds
        column = np.arange(width)
        symbols = np.full((len(words), width), -1, np.int64)
        inside = column < lengths[:, None]
        symbols[inside] = np.array(self.byte_ids)[np.frombuffer(b"".join(words), np.uint8)]

        ranks = np.full((len(words), width), never, np.int32)
        ranks[:, :-1] = np.where(inside[:, 1:], self.ranks_of(symbols[:, :-1], symbols[:, 1:]), never)
        out, n = np.full((len(words), width), -1, np.int64), lengths.copy()
        own = np.arange(len(words))
        while len(own):
            at = ranks.argmin(axis=1)
            row = np.arange(len(own))
            lowest = ranks[row, at]
            go = lowest < never
            if not go.all():
                out[own[~go], : symbols.shape[1]] = symbols[~go]
                own, symbols, ranks, at, lowest = own[go], symbols[go], ranks[go], at[go], lowest[go]
                row = np.arange(len(own))
            if not len(own):
                break
            symbols[row, at] = merges[lowest]
            shift = np.minimum(column + (column > at[:, None]), width - 1)
            symbols, ranks = np.take_along_axis(symbols, shift, 1), np.take_along_axis(ranks, shift, 1)
            merged = symbols[row, at]
            right = symbols[row, np.minimum(at + 1, width - 1)]
            ranks[row, at] = np.where(right >= 0, self.ranks_of(merged, right), never)
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.ranks_of(symbols[inner, at[inner] - 1], merged[inner])
            n[own] -= 1
        return out, n


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words(text: str):
    """Pre-tokens of a text."""
    return SPLIT.findall(text) if len(text) < 4_000_000 else (m.group() for m in SPLIT.finditer(text))


def plain_lines(text: str) -> list[list[str]] | None:
    """The text's lines as lists of space-separated chunks, if single blanks and line ends are all its white space.

    No pre-token then crosses from one chunk to the next: a blank goes with the chunk after it and a line end stands
    alone. Otherwise None.
    """
    if not text or text.split() != text.replace("\n", " ").split(" "):
        return None
    return [line.split(" ") for line in text.split("\n")]
