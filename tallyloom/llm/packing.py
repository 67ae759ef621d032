"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Only lengths matter to a packing, and there are at most `capacity` of them. So Spark counts the pieces of each length,
the driver packs that histogram (at most `capacity` numbers, however large the corpus), and Spark deals the pieces out to
the places of the plan by their rank within their length.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.bpe import byte_letters
from tallyloom.llm.common import NULL_ID, Memo, id_and_text, small_batches, table, written

END_ID = 0
ENDS = frozenset(".,;:!?")  # one of these behind letters is a part of its own
LONGEST = 64  # characters of a chunk that is kept beyond its batch

# The vocabulary's public splitting pattern, and what keeps a chunk from being split here.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
SPECIAL = regex.compile(r"<\||[^\x21-\x7e\xa1-\xac\xae-\xff]")


class Encoder:
    """Token ids of whole texts by the tokenizers library, each distinct chunk between white space encoded once.

    A chunk of ASCII and Latin-1 letters and signs is in normal form, so it is lower-cased and split here and its parts
    go to the library's merging alone; any other chunk, and any that might hold a special token, goes through all of it.
    Ids of chunks and parts are kept, as four bytes each, for as many as `most` of them that are not too long.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.chunks: dict[str, bytes] = {}
        self.signs = Memo(self.merged, 10_000)
        self.most = most

    def merged(self, p: str) -> bytes:
        spelt = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(spelt)]).tobytes()

    def part(self, p: str) -> bytes:
        """Ids of one lower-case part, as the splitting pattern cuts them. Letters alone are as if they were a chunk."""
        if not p.isalpha():
            return self.signs[p]
        ids = self.chunks.get(p)
        if ids is None:
            ids = self.merged(p)
            if len(p) <= LONGEST:
                self.chunks[p] = ids
        return ids

    def learn(self, chunks: set[str]) -> None:
        own, part, rest = self.chunks, self.part, []
        new = chunks - own.keys()
        if len(own) + len(new) > self.most:
            own.clear()
            new = chunks
        for c in new:
            if c.isascii() and c.isalpha():
                own[c] = part(c.lower())
            elif SPECIAL.search(c):
                rest.append(c)
            elif c[-1] in ENDS and c[:-1].isalpha():
                own[c] = part(c[:-1].lower()) + self.signs[c[-1]]
            else:
                own[c] = b"".join(map(part, PARTS.findall(c.lower())))
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for c, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                own[c] = array("I", e.ids).tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """No token of this vocabulary crosses white space. The four separators that Python alone takes for white space
        send a text to the library whole."""
        cut = [t.split() for t in texts]
        chunks = set(chain.from_iterable(cut))
        self.learn(chunks)
        found = self.chunks.__getitem__
        out = []
        for t, own in zip(texts, cut):
            if SEPARATORS.search(t):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4"))
            else:
                out.append(np.frombuffer(b"".join(map(found, own)), np.uint32).astype("<u4", copy=False))
        for c in chunks:
            if len(c) > LONGEST:
                self.chunks.pop(c, None)
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end id, cut only where longer than capacity."""
    small_batches(docs.sparkSession)

    def batches(it):
        e = encoder(tokenizer)
        for b in it:
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), e.ids(b.column("text").to_pylist())):
                ids = np.append(ids, np.array([END_ID], "<u4"))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((doc, k, at, len(own), zlib.crc32(own.tobytes())))
            if rows:
                doc, k, at, n, crc = zip(*rows)
                yield pa.record_batch(
                    [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return id_and_text(docs).mapInArrow(batches, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (documents of each length, number of such bins).

    A bin is filled greedily with the longest document that fits. Then its shortest document gives way to two unpacked
    documents whose sum fits the gap more tightly, if there are such. As many equal bins are made at a time as the
    counts allow, so each step uses up a length; there are at most sum(capacity / length) steps.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.flatnonzero(left)
    bins = []
    while len(lengths):
        own: dict[int, int] = {}
        gap = capacity
        while True:
            at = int(np.searchsorted(lengths, gap, "right")) - 1
            while at >= 0 and own.get(int(lengths[at]), 0) >= left[lengths[at]]:
                at -= 1
            if at < 0:
                break
            length = int(lengths[at])
            fits = min(gap // length, int(left[length]) - own.get(length, 0))
            own[length] = own.get(length, 0) + fits
            gap -= fits * length
        if gap:
            shortest = min(own)
            room = gap + shortest
            free = left[lengths] - _uses(own, lengths)
            usable = lengths[(free > 0) & (lengths < room)]
            if len(usable):
                spare = dict(zip(lengths.tolist(), free.tolist()))
                at = np.searchsorted(usable, room - usable, "right") - 1
                partner = np.where(at >= 0, usable[np.maximum(at, 0)], 0)
                for i in np.flatnonzero(partner == usable):  # the same length twice needs two of it
                    if spare[int(usable[i])] < 2:
                        partner[i] = usable[at[i] - 1] if at[i] > 0 else 0
                total = np.where(partner > 0, usable + partner, 0)
                best = int(total.argmax())
                if total[best] > shortest:
                    own[shortest] -= 1
                    own = {k: v for k, v in own.items() if v}
                    for x in (int(usable[best]), int(partner[best])):
                        own[x] = own.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in own.items())
        for x, n in own.items():
            left[x] -= n * times
        bins.append((own, times))
        lengths = lengths[left[lengths] > 0]
    return bins


def _uses(own: dict[int, int], lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths), np.int64)
    for x, n in own.items():
        out[np.searchsorted(lengths, x)] = n
    return out


def places(bins: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks, copies in a bin, first sequence and first offset of each run of equal bins."""
    runs: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for own, times in bins:
        offset = 0
        for length in sorted(own, reverse=True):
            n = own[length]
            runs.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def ranked(cut: DataFrame) -> DataFrame:
    """Add rank, the place of a piece among those of its length, from 0.

    A length can have a third of all pieces, so ranks are taken in (length, part) cells with the parts' counts added up.
    """
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    cells = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("own", F.row_number().over(own) - 1).join(cells, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own")).drop("base", "own", "part")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    A null or empty text is one piece that holds only the end id. Repeated rows are packed each on its own; a null
    doc_id stays null. Very long texts are cut at every `capacity` ids and nowhere else. Other columns are left behind
    whatever their names. An empty table gives an empty table. Ties go by doc_id and piece.
    """
    spark = docs.sparkSession
    ids = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    cut = written(pieces(ids, tokenizer, capacity), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = spark.sparkContext.broadcast(places(best_two_fit(counts, capacity), capacity))  # bounded by capacity too

    def deal(it):
        for b in it:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, copies, at, start = plan.value[int(x)]
                run = np.searchsorted(first, rank[own], "right") - 1
                k = rank[own] - first[run]
                sequence[own] = at[run] + k // copies[run]
                offset[own] = start[run] + k % copies[run] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    out = ranked(cut).mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
