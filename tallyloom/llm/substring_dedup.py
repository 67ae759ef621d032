"""Substring dedup: repeated windows of 50 words from prefix-partitioned suffix trees.

The suffixes that start a window are split by their first words, by more words where a group would not fit in memory,
and each group's subtree is built by itself: its sorted suffixes, the common prefixes of neighbours, and from these the
internal nodes. A node at least 50 words deep is a repeat, and the leaves below are the places it starts at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import NULL_ID, Memo, table
from tallyloom.llm.repeats import Kind, covered, marked

LENGTH, GRAM = 50, 10
GROUP = 20_000  # suffixes of a subtree

_hashes = Memo(xxhash.xxh3_64_intdigest, 300_000)


def word_list(text: str) -> list[bytes]:
    """Words between the bytes 0x20 and 0x09 to 0x0D, as UTF-8."""
    return text.encode("utf-8").split()


def word_hashes(text: str) -> np.ndarray:
    words = word_list(text)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def prefix_groups(words: np.ndarray, starts: np.ndarray, depth: int, most: int = GROUP):
    """(suffix starts, length of their common prefix or less) of groups that fit, in order of their prefixes."""
    todo = [(starts, 0)]
    while todo:
        own, length = todo.pop()
        if len(own) <= most or length == depth:
            yield own, length
            continue
        own = own[np.argsort(words[own + length], kind="stable")]
        edges = np.append(np.flatnonzero(np.diff(words[own + length], prepend=-1)), len(own))
        bundle = 0
        for a, b in zip(edges, edges[1:]):
            if b - a > most:
                if bundle < a:
                    todo.append((own[bundle:a], length))
                todo.append((own[a:b], length + 1))
                bundle = b
            elif b - bundle > most:
                todo.append((own[bundle:a], length))
                bundle = a
        if bundle < len(own):
            todo.append((own[bundle:], length))


def subtree(words: np.ndarray, starts: np.ndarray, length: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A group's leaves in order and the common prefix of each with the one before, at most depth words."""
    rows = words[starts[:, None] + np.arange(length, depth)] if length < depth else np.zeros((len(starts), 1), np.int32)
    flat = np.ascontiguousarray(rows.astype(">u4"))
    order = np.argsort(flat.view(np.dtype((np.void, flat.shape[1] * 4))).ravel(), kind="stable")
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), length + differ.argmax(axis=1), depth)
    return starts[order], np.concatenate([[0], common])


def deep_nodes(common: np.ndarray, depth: int) -> np.ndarray:
    """The number of the deep internal node above each leaf; leaves with a number of their own are under none."""
    return np.cumsum(common < depth)


def shared_windows(texts: list[bytes], firsts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of the windows whose words also start in a document with a smaller id."""
    arrays = [np.frombuffer(t, np.uint64) for t in texts]
    sizes = np.array(list(map(len, arrays)), np.int64)
    begin = np.cumsum(sizes) - sizes
    words = np.unique(np.concatenate(arrays), return_inverse=True)[1].astype(np.int64)
    windows = sizes - window + 1
    text_of = np.repeat(np.arange(len(texts)), windows)
    offset_of = np.arange(len(text_of)) - np.repeat(np.cumsum(windows) - windows, windows)
    found = []
    for starts, length in prefix_groups(words, begin[text_of] + offset_of, window):
        leaves, common = subtree(words, starts, length, window)
        node = deep_nodes(common, window)
        text = np.searchsorted(begin, leaves, "right") - 1
        ids = firsts[text, 0]
        least = np.minimum.reduceat(ids, np.flatnonzero(np.diff(node, prepend=-1)))
        again = ids > least[node - node[0]]
        found.append((text[again], leaves[again] - begin[text[again]]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.array([], np.int64), np.array([], np.int64))


WORDS = Kind(LENGTH, GRAM, 10, word_hashes, word_hashes, shared_windows, False)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs.

    Null and empty texts have no words. Rows that share a doc_id are no smaller than each other, so none of them removes
    words from the others; null ids come before all others. Very long texts are taken in parts that overlap by a window.
    Other columns are left behind whatever their names. An empty table gives an empty table.
    """

    def batches(it):
        for b in it:
            rows = []
            for i, t, removed in zip(b.column("id").to_pylist(), b.column("text"), b.column("removed")):
                words = word_list(t.as_py())
                n_removed = 0
                if removed.is_valid:
                    gone = covered(removed, len(words))
                    n_removed = int(gone.sum())
                kept = words if not n_removed else [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((None if i == NULL_ID else i, len(words), n_removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = marked(docs.select("doc_id", "text"), WORDS)
    return found.select("id", "text", "removed").mapInArrow(batches, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
