"""Suffix-array dedup: repeated 100-byte strings from Burrows-Wheeler transforms of shards, merged by interleaving.

Each shard of stretches is sorted on its own. The merge never compares suffixes: it starts with the shards one after the
other and, round by round, deals the rows out by what stands before them, which turns an order by j symbols into an order by
j + STEP (interleave refinement; here of any number of shards at once and some symbols a round). Rows that part in a round
have a common prefix that ends there, so the rounds give the common prefixes too, and rows still together after the last
round are a repeated interval.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import NULL_ID, table
from tallyloom.llm.repeats import Kind, covered, marked

LENGTH, GRAM, SHARDS = 100, 32, 4
STEP = 4  # symbols a round; 100 is a multiple

_SYMBOLS = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8"), np.uint8)


def gram_ids(texts: list[bytes], step: int) -> list[np.ndarray] | None:
    """For each text the number, in order, of the `step` bytes at each place; places past the end hold 0, the least byte.

    Each text is followed by `step` places past its end. None if there are more numbers than two bytes hold.
    """
    pad = b"\xff" * step
    symbols = np.frombuffer(pad.join(texts) + pad, np.uint8) + np.uint8(1)  # a byte is one more; 255 is in no UTF-8 text
    packed = symbols.astype(np.uint32)
    for i in range(1, step):
        packed = packed << 8 | np.append(symbols[i:], np.zeros(i, np.uint8))
    values, ids = np.unique(packed, return_inverse=True)
    if len(values) > 65_535:
        return None
    sizes = np.array([len(t) + step for t in texts], np.int64)
    return np.split(ids.astype(np.uint16), np.cumsum(sizes)[:-1])


def shard_transform(grams: list[np.ndarray], step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a shard by at most depth symbols, and its transform: the gram before each suffix, 0 for none.

    Places past an end come first, by text and place.
    """
    sizes = np.array(list(map(len, grams)), np.int64)
    ids = np.concatenate(grams)
    n = len(ids)
    starts = np.cumsum(sizes) - sizes
    ends = (np.cumsum(sizes)[:, None] - np.arange(step, 0, -1)).ravel()
    rank = ids.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    reach = step
    while True:
        key = rank * (n + 70_000) + np.append(rank[reach:], np.zeros(min(reach, n), np.int64))[:n]
        order = np.argsort(key, kind="stable")
        if reach * 2 >= depth:
            break
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(ordered, prepend=ordered[0]) != 0)
        if rank[order[-1]] == n - 1:
            break
        reach *= 2
    before = np.concatenate([np.zeros(step, np.uint16), ids])[:n]
    before[(starts[:, None] + np.arange(step)).ravel()] = 0
    return order, before[order]


def merge_transforms(shards: list[tuple[np.ndarray, int]], step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each row in the merged order, and its common prefix with the row before in whole steps (at most depth),
    from the shards' transforms and numbers of places past an end."""
    before = np.concatenate([t for t, _ in shards])
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(t) for t, _ in shards])
    ends = np.repeat(np.arange(len(shards), dtype=np.uint8), [n for _, n in shards])
    n, first = len(source), len(ends)
    prefix = np.full(n, depth, np.int32)
    parted = np.zeros(n, bool)
    parted[0] = True
    prefix[0] = 0
    block = np.zeros(n, np.int32)
    gram = np.empty(n, np.uint16)
    for done in range(0, depth, step):
        gram[np.argsort(source, kind="stable")] = before
        inner = np.flatnonzero(gram)
        move = inner[np.argsort(gram[inner], kind="stable")]
        after = np.concatenate([ends, source[move]])
        split = np.ones(n, bool)
        moved_gram, moved_block = gram[move], block[move]
        split[first + 1 :] = (moved_gram[1:] != moved_gram[:-1]) | (moved_block[1:] != moved_block[:-1])
        prefix[split & ~parted] = done
        settled = np.array_equal(after, source) and np.array_equal(split, parted)
        source, parted = after, split
        if settled or parted.all():
            break
        np.cumsum(parted, out=block)
    return source, prefix


def shared_windows(texts: list[bytes], firsts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of the windows that also start at an earlier (id, tag, start)."""
    step = STEP
    while (grams := gram_ids(texts, step)) is None:
        step //= 2
    count = min(SHARDS, len(texts))
    owners = [np.arange(s, len(texts), count) for s in range(count)]
    orders, transforms = zip(*(shard_transform([grams[i] for i in own], step, window) for own in owners))
    source, prefix = merge_transforms([(t, step * len(own)) for t, own in zip(transforms, owners)], step, window)
    # the rows of each shard keep their order, so the merged suffix array is dealt out from the shards'
    text_of, offset_of = [], []
    for own, order in zip(owners, orders):
        sizes = np.array([len(grams[i]) for i in own], np.int64)
        which = np.repeat(np.arange(len(own)), sizes)
        text_of.append(own[which[order]])
        offset_of.append(order - (np.cumsum(sizes) - sizes)[which[order]])
    rows = np.argsort(source, kind="stable")
    text, offset = np.empty(len(source), np.int64), np.empty(len(source), np.int64)
    text[rows], offset[rows] = np.concatenate(text_of), np.concatenate(offset_of)
    interval = np.cumsum(prefix < window)
    whole = offset + window <= np.array(list(map(len, texts)), np.int64)[text]  # the rest are equal up to an end
    live = np.flatnonzero((np.bincount(interval, minlength=interval[-1] + 1)[interval] > 1) & whole)
    text, offset, interval = text[live], offset[live], interval[live]
    place = firsts[text]
    order = np.lexsort((place[:, 2] + offset, place[:, 1], place[:, 0], interval))
    again = np.diff(interval[order], prepend=-1) == 0
    return text[order][again], offset[order][again]


BYTES = Kind(LENGTH, GRAM, 17, lambda text: _SYMBOLS[as_bytes(text)], as_bytes, shared_windows, True)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Null and empty texts have nothing to remove. Of rows that share a doc_id those with equal texts count as one document
    with one result, and those with different texts follow each other in a fixed order; null ids come before all others.
    Very long texts are taken in parts that overlap by a window. Other columns are left behind whatever their names. An empty
    table gives an empty table.
    """

    def batches(it):
        for b in it:
            rows = []
            for i, t, removed in zip(b.column("id").to_pylist(), b.column("text"), b.column("removed")):
                raw = as_bytes(t.as_py())
                gone = covered(removed, len(raw))
                spans = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
                rows.append((None if i == NULL_ID else i, len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = marked(docs.select("doc_id", "text"), BYTES)
    return found.select("id", "text", "removed").mapInArrow(batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut from its texts (and n_chars counted anew where there is such a column).

    A cut inside a character drops what is left of it. Null texts come back empty.
    """
    names = docs.columns

    def batches(it):
        for b in it:
            texts = []
            for t, removed in zip(b.column("text"), b.column("removed")):
                raw = as_bytes(t.as_py())
                texts.append(raw[~covered(removed, len(raw))].tobytes().decode("utf-8", "ignore"))
            rest = dict(zip([f.name for f in b.schema.field("rest").type], b.column("rest").flatten()))
            rest["text"] = pa.array(texts, pa.string())
            if "n_chars" in rest:
                rest["n_chars"] = pa.array(list(map(len, texts))).cast(rest["n_chars"].type)
            yield pa.record_batch([rest[c] for c in names], names=names)

    return marked(docs, BYTES).select("text", "removed", "rest").mapInArrow(batches, docs.schema)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
