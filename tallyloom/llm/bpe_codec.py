"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words."""

from __future__ import annotations

import atexit
import functools
import hashlib
import os
import shutil
import tempfile
import uuid
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe
from tallyloom.llm.common import Memo, id_and_text, small_batches, table, written

LONGEST = 64  # characters of a word or chunk that is kept
ENDS = frozenset(".,;:!?")  # one of these behind letters is a pre-token of its own
SHORT = 32  # bytes of an unseen word that is merged side by side with others; a longer one goes through the heap


# --- the transducer -------------------------------------------------------------------------------------------------


def compile_transducer(lexicon: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of the words' bytes whose arc outputs add up to a word's ordinal.

    Words go in sorted order; when a word leaves a path, the states behind are final and equal ones (same acceptance,
    same arcs) are shared, so suffixes are stored once. The ordinal points into the table of token ids. Arrays only:
    arcs sorted by (state, byte), so a memory-mapped file is searched as it lies.
    """
    entries = sorted((w.encode("utf-8"), ids) for w, ids in lexicon.items())
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (accepting, ((byte, target), ...), words below)
    path: list[list] = [[False, []]]  # states that can still change: accepting, arcs

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            accepting, arcs = path.pop()
            key = (accepting, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append((*key, accepting + sum(states[t][2] for _, t in arcs)))
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    last = b""
    for word, _ in entries:
        shared = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        close(shared)
        for byte in word[shared:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    accepting, arcs = path[0]
    root = len(states)
    states.append((accepting, tuple(arcs), len(entries)))

    keys, targets, outputs = [], [], []
    for s, (accepting, arcs, _) in enumerate(states):
        skipped = int(accepting)
        for byte, t in arcs:
            keys.append(s << 8 | byte)
            targets.append(t)
            outputs.append(skipped)
            skipped += states[t][2]
    ids = [i for _, ids in entries for i in ids]
    return {
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int32),
        "outputs": np.array(outputs, np.int32),
        "accepting": np.array([s[0] for s in states], np.uint8),
        "root": np.array([root], np.int32),
        "offsets": np.cumsum([0, *(len(ids) for _, ids in entries)]).astype(np.int64),
        "ids": np.array(ids, np.int32),
    }


#: names, types and order of the arrays in a transducer file; a header of their lengths goes first
FIELDS = (("keys", "<i8"), ("offsets", "<i8"), ("targets", "<i4"), ("outputs", "<i4"), ("root", "<i4"), ("ids", "<i4"), ("accepting", "u1"))


def save_transducer(arrays: dict[str, np.ndarray], path: str) -> None:
    with open(path, "wb") as f:
        f.write(np.array([len(arrays[n]) for n, _ in FIELDS], "<i8").tobytes())
        for name, kind in FIELDS:
            f.write(arrays[name].astype(kind).tobytes())


class Transducer:
    """A memory-mapped transducer file; looks up many words at a time, one byte of each per step."""

    def __init__(self, path: str):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))  # still the mapped pages
        lengths = raw[: 8 * len(FIELDS)].view("<i8")
        at = 8 * len(FIELDS)
        for (name, kind), n in zip(FIELDS, lengths):
            end = at + int(n) * np.dtype(kind).itemsize
            setattr(self, name, raw[at:end].view(kind))
            at = end

    def lookup(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """The ids of each word, None for words outside the lexicon."""
        return [None if ids is None else tuple(np.frombuffer(ids, "<u4").tolist()) for ids in self.found(words)]

    def found(self, words: list[bytes]) -> list[bytes | None]:
        """As lookup, the ids in four bytes each."""
        if not words or not len(self.keys):
            return [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        text = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), int(self.root[0]), np.int64)
        ordinal = np.zeros(len(words), np.int64)
        live = np.flatnonzero(lengths)
        for step in range(int(lengths.max())):
            key = state[live] << 8 | text[starts[live] + step]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            hit = self.keys[arc] == key
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            ordinal[live] += self.outputs[arc]
            state[live] = self.targets[arc]
            live = live[lengths[live] > step + 1]
            if not len(live):
                break
        known = (state >= 0) & (self.accepting[np.maximum(state, 0)] > 0)
        out: list[bytes | None] = [None] * len(words)
        at = np.flatnonzero(known)
        ids = memoryview(self.ids).cast("B")
        for i, a, b in zip(at.tolist(), (self.offsets[ordinal[at]] * 4).tolist(), (self.offsets[ordinal[at] + 1] * 4).tolist()):
            out[i] = bytes(ids[a:b])
        return out


# --- word counts over the corpus ------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, size: int) -> list[str]:
    """The most frequent words of all texts, at most size, most frequent first; ties in code-point order.

    Words are what white space stands between, each with a blank in front; those too long to be kept are not counted.
    Levels of frequency (a sixteenth of a doubling each) are taken whole while they fit, so what all partitions together
    send to the driver is at most size words and one count a level.
    """
    words = id_and_text(docs).select(F.explode(F.split("text", r"\s+")).alias("word")).where(f"length(word) between 1 and {LONGEST}")
    counted = written(words.groupBy("word").agg(F.count("*").alias("n")).withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "words")
    lowest, room = 0, size
    for r in counted.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # at most 1,024 rows
        room -= r.words
        if room < 0:
            lowest = r.level + 1
            break
    kept = counted.where(F.col("level") >= lowest).select("word", "n").collect()
    return [" " + r.word for r in sorted(kept, key=lambda r: (-r.n, r.word))]


# --- the codec ------------------------------------------------------------------------------------------------------


def laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings in one array, with where each starts and its size."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def joined(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings of ids one after the other, and where each ends."""
    buffer, starts, sizes = table
    own = sizes[ids]
    ends = np.cumsum(own)
    at = np.repeat(starts[ids] - ends + own, own)
    at += np.arange(len(at))
    return buffer[at], ends


class Codec:
    """Encodes and decodes whole texts with a vocabulary and a transducer of frequent words.

    Ids are kept as four bytes each. A text whose only white space is single blanks and line ends is put together from its
    chunks: a blank goes with the chunk after it, a line end stands alone before its chunk. Other texts go by pre-tokens.
    """

    def __init__(self, tokenizer: str, transducer: str):
        self.vocabulary = bpe.vocabulary(tokenizer)
        self.transducer = Transducer(transducer)
        self.tokens = laid_out(self.vocabulary.token_bytes)
        self.decimals = laid_out([b"%d," % i for i in range(len(self.vocabulary.token_bytes))])
        self.words = Memo(self.merged, 200_000)
        self.first = Memo(lambda c: self.pieces(c) if c.split() == [c] else None, 50_000)
        self.later: dict[str, bytes | None] = {}
        self.newline = self.merged("\n")

    def merged(self, word: str) -> bytes:
        return np.array(self.vocabulary.ids(word), "<u4").tobytes()

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, bpe.words(text)))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens: the short ones are merged side by side, longer ones by the heap."""
        out = [b""] * len(words)
        order = sorted(range(len(words)), key=list(map(len, words)).__getitem__)
        short = [i for i in order if len(words[i]) <= SHORT]
        for i in order[len(short) :]:
            out[i] = self.merged(words[i].decode("utf-8"))
        for k in range(0, len(short), 4096):
            block = short[k : k + 4096]
            ids, n = self.vocabulary.ids_of_block([words[i] for i in block])
            flat = ids[np.arange(ids.shape[1]) < n[:, None]].astype("<u4").tobytes()
            ends = (np.cumsum(n) * 4).tolist()
            for i, a, b in zip(block, [0, *ends], ends):
                out[i] = flat[a:b]
        return out

    def learn(self, chunks: set[str]) -> list[str]:
        """Give each chunk that may come after a blank its ids, or None if it holds white space but a line end in front.

        New words are looked up in the transducer at once. Those it doesn't hold are merged. Returns the chunks that are
        too long to be kept beyond this batch.
        """
        later, words = self.later, self.words
        if len(later) + len(chunks) > 300_000:
            later.clear()
        new = chunks - later.keys()
        letters, others, plain = [], {}, []
        for c in new:
            if c.isalpha():  # one pre-token
                letters.append(c)
            elif c[:1] != "\n":
                plain.append(c)
            elif c[1:].split() == [c[1:]]:
                others[c] = bpe.words(c[1:])
            else:
                later[c] = None
        asked = letters + plain
        known = self.transducer.found([b" " + c.encode("utf-8") for c in asked])
        later.update(zip(asked, known))
        unseen = [c for c, ids in zip(letters, known) if ids is None]
        later.update(zip(unseen, self.merge_all([b" " + c.encode("utf-8") for c in unseen])))
        for c, ids in zip(plain, known[len(letters) :]):
            if ids is None:
                if c[-1:] in ENDS and c[:-1].isalpha():
                    others[c] = [" " + c[:-1], c[-1]]
                elif c.split() == [c]:
                    others[c] = bpe.words(" " + c)
        wanted = [w for w in set(chain.from_iterable(others.values())) if w not in words]
        if len(words) + len(wanted) > words.most:
            words.clear()
            wanted = list(set(chain.from_iterable(others.values())))
        words.update(zip(wanted, self.merge_all([w.encode("utf-8") for w in wanted])))
        for c, parts in others.items():
            ids = b"".join(map(words.__getitem__, parts))
            later[c] = self.newline + ids if c[0] == "\n" else ids
        for w in wanted:
            if len(w) > LONGEST:
                del words[w]
        return [c for c in new if len(c) > LONGEST]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [[(part, special, part.replace("\n", " \n").split(" ")) for part, special in self.vocabulary.parts(t) if part] for t in texts]
        long = self.learn(set(chain.from_iterable(chunks for parts in cut for _, _, chunks in parts)))
        first, later, words, out = self.first, self.later.__getitem__, self.words.__getitem__, []
        for parts in cut:
            runs: list[bytes] = []
            for part, special, chunks in parts:
                if special is not None:
                    runs.append(special.to_bytes(4, "little"))
                    continue
                head, own = first[chunks[0]], list(map(later, chunks[1:]))
                if head is None or None in own:
                    runs += map(words, bpe.words(part))
                else:
                    runs.append(head)
                    runs += own
            out.append(np.frombuffer(b"".join(runs), "<u4"))
        for c in long:
            del self.later[c]
        return out

    def spelt(self, ids: list[np.ndarray]) -> list[bytes]:
        """Each text's ids as decimals with commas between."""
        found, ends = joined(self.decimals, np.concatenate(ids))
        return [found[a : max(a, b - 1)].tobytes() for a, b in spans(ids, ends)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of ids."""
        found, ends = joined(self.tokens, np.concatenate(ids))
        return [found[a:b].tobytes().decode("utf-8", "replace") for a, b in spans(ids, ends)]


def spans(ids: list[np.ndarray], ends: np.ndarray) -> list[tuple[int, int]]:
    """Where each text's part of joined strings lies."""
    at = [0, *np.append(0, ends)[np.cumsum(list(map(len, ids)))].tolist()]
    return list(zip(at, at[1:]))


@functools.lru_cache(maxsize=1)
def codec(tokenizer: str, file: str) -> Codec:
    return Codec(tokenizer, SparkFiles.get(file))


def ship_lexicon(docs: DataFrame, tokenizer: str, lexicon_size: int) -> str:
    """Compile the lexicon on the driver (its size is bounded by lexicon_size) and give each executor a copy to map."""
    vocabulary = bpe.vocabulary(tokenizer)
    ids = lambda word: tuple(i for w in bpe.words(word) for i in vocabulary.ids(w))
    arrays = compile_transducer({w: ids(w) for w in frequent_words(docs, lexicon_size)})
    file = f"lexicon-{uuid.uuid4().hex}.mat"
    folder = tempfile.mkdtemp(prefix="spark-tallyloom-")  # the driver's own; executors map the copies that Spark gives them
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, file)
    save_transducer(arrays, path)
    docs.sparkSession.sparkContext.addFile(path)
    return file


def encode_decode(docs: DataFrame, tokenizer: str, lexicon_size: int = 50_000, keep_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids again.

    doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids array<int> and decoded string. Null and
    empty texts have no ids and decode to the empty string; very long texts are encoded whole; repeated rows each give a row;
    other columns are left behind whatever their names; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    file = ship_lexicon(docs, tokenizer, lexicon_size)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def batches(it):
        c = codec(tokenizer, file)
        for b in it:
            if not b.num_rows:
                continue
            ids = c.encode(b.column("text").to_pylist())
            decoded = c.decode(ids)
            columns = [
                b.column("doc_id"),
                pa.array(list(map(len, ids)), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in c.spelt(ids)], pa.string()),
                pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded], pa.string()),
            ]
            columns += [pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())] if keep_ids else []
            yield pa.record_batch(columns, names=[x.split()[0] for x in schema.split(", ")])

    return id_and_text(docs).mapInArrow(batches, schema)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
