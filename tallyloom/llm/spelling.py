"""Spelling variants: words one edit apart, found by range searches in k-d trees over their letter counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text, small_batches, table, written
from tallyloom.llm.graph import hot_keys, looked_up

LETTERS = 32  # counts of a word's code points by their remainder: one edit changes a sum of at most two
LEAF = 128  # points of a tree's leaf
MOST = 100  # what a count is cut to, so that sums stay small; cut counts are no farther apart
CELL = 32_768  # words of a length that make a tree; more are split by planes from a sample
DEEP = 50  # levels of planes at most; a tree has four times as many, and then a large leaf
BLOCK = 8192  # queries that pass through a tree together
SAMPLE = 20_000  # words, about, that the planes come from; they only tell how even cells are
HELD = 200_000  # different words that a task counts before it hands them on
LONG = 64  # words beyond this length are compared one by one

_RUN = re.compile("[a-zÀ-ÿ]+")


def lowered(text: str) -> str:
    """With A to Z in lower case, and all else as it is."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def runs(doc_id: int | None, text: str, divisor: int) -> Counter:
    """How often a text has each run of letters; a run's code point goes where its hash says so."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(lowered(text))).items():
        h = zlib.crc32(run.encode(), start)
        if h % divisor == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, divisor: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n of all words of at least `shortest` code points and `least` occurrences. Tasks add up what they meet, in
    bounded tables, before the shuffle."""
    small_batches(docs.sparkSession)

    def batches(it):
        held: Counter = Counter()
        size = 0

        def out():
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in it:
            for i, t in zip(b.column("doc_id"), b.column("text")):
                for word, n in runs(i.as_py(), t.as_py(), divisor).items():
                    if len(word) >= shortest:
                        held[word] += n
                        size += len(word)
                if len(held) > HELD or size > 1000 * HELD:
                    yield out()
                    held.clear()
                    size = 0
        yield out()

    counts = id_and_text(docs).mapInArrow(batches, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_counts(words: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % LETTERS
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * LETTERS + codes, minlength=len(words) * LETTERS).reshape(-1, LETTERS)
    return np.minimum(counts, MOST).astype(np.int8)


def packed(counts: np.ndarray) -> np.ndarray:
    """Counts cut to two, a bit for each letter that is there and one for each that is there twice: as many bits differ as
    the cut counts do, which are no farther apart than the counts."""
    return np.packbits(np.concatenate([counts >= 1, counts >= 2], axis=1), axis=1).view(np.uint64).ravel()


class Tree:
    """A k-d tree of letter counts: halves by the median of one letter, each with the box of its points in that letter."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.codes, self.nodes = points, packed(points), []
        if len(points):
            self.low, self.high = points.min(axis=0), points.max(axis=0)
            self._build(np.arange(len(points)), self.low.copy(), self.high.copy(), leaf)

    def _build(self, own: np.ndarray, low: np.ndarray, high: np.ndarray, leaf: int, depth: int = 0) -> int:
        """A node is its points, or a letter, the bounds that its box has there, and for each half a node and its bounds."""
        at = len(self.nodes)
        self.nodes.append(own)
        p = self.points[own]
        first, last = p.min(axis=0), p.max(axis=0)
        if len(own) > leaf and depth < 4 * DEEP and (last > first).any():
            # of the letters that vary most, the one whose median halves best
            order = np.argsort(first.astype(int) - last, kind="stable")[:6]
            cuts = [(abs(2 * int((p[:, d] <= m).sum()) - len(own)), int(d), m) for d in order if last[d] > first[d] for m in (min(int(np.median(p[:, d])), int(last[d]) - 1),)]
            _, d, m = min(cuts)
            left, halves = p[:, d] <= m, []
            for half in (left, ~left):
                x, y = p[half, d].min(), p[half, d].max()
                box = low.copy(), high.copy()
                box[0][d], box[1][d] = x, y
                halves.append((self._build(own[half], *box, leaf, depth + 1), int(x), int(y)))
            self.nodes[at] = (d, int(low[d]), int(high[d]), halves)
        return at

    def within(self, queries: np.ndarray, radius: int):
        """Yields (query numbers, point numbers) of all pairs that may be `radius` apart or less in L1. A step down changes
        a query's distance to the box in one letter; beyond the radius the subtree is left out."""
        if not self.nodes or not len(queries):
            return
        codes, by_letter = packed(queries), np.ascontiguousarray(queries.T.astype(np.int16))
        far = (np.maximum(self.low - queries, 0) + np.maximum(queries - self.high, 0)).sum(axis=1, dtype=np.int16)
        asked = np.flatnonzero(far <= radius)
        stack = [(0, asked, far[asked])]
        while stack:
            node, asked, far = stack.pop()
            if not len(asked):
                continue
            node = self.nodes[node]
            if isinstance(node, tuple):
                d, low, high, halves = node
                x = by_letter[d][asked]
                rest = far - np.maximum(low - x, 0) - np.maximum(x - high, 0)
                for child, low, high in halves:
                    now = rest + np.maximum(low - x, 0) + np.maximum(x - high, 0)
                    near = now <= radius
                    stack.append((child, asked[near], now[near]))
                continue
            for at in range(0, len(node), 4 * LEAF):  # a leaf may hold many points that are all the same
                some = node[at : at + 4 * LEAF]
                i, j = np.nonzero(np.bitwise_count(codes[asked][:, None] ^ self.codes[some][None]) <= radius)
                yield asked[i], some[j]


def one_edit(a: str, b: str) -> bool:
    """Whether b, as long as a or one longer, is a with one code point replaced or inserted."""
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Words:
    """Words of one length, with their letters as a matrix unless they are very long."""

    def __init__(self, words: list[str]):
        self.words, self.length = words, len(words[0])
        self.letters = None
        if self.length <= LONG:
            letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            self.letters = letters.astype(np.uint8 if letters.max() < 256 else np.uint32).reshape(len(words), -1)

    def one_edit(self, longer: "Words", i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (self[i], longer[j]) are one edit apart, by the order of their letters."""
        if longer.letters is None:
            return np.fromiter((one_edit(self.words[x], longer.words[y]) for x, y in zip(i, j)), bool, len(i))
        a, b, m = self.letters[i], longer.letters[j], self.length
        if m == longer.length:
            return (a != b).sum(axis=1) == 1
        before = np.logical_and.accumulate(a == b[:, :m], axis=1).sum(axis=1)
        after = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        return before + after >= m


class Planes:
    """How the words of each length are split into cells: a binary tree of planes a length, from a sample."""

    def __init__(self, sample: list[str], share: float, cell: int = CELL):
        by_length: dict[int, list[str]] = {}
        for w in sorted(sample):
            by_length.setdefault(len(w), []).append(w)
        self.trees = {n: self._split(letter_counts(w), max(1.0, cell * share)) for n, w in by_length.items() if len(w) > cell * share}

    def _split(self, p: np.ndarray, most: float, depth: int = 0):
        if len(p) <= max(most, 2) or depth == DEEP:
            return None
        spread = [(abs(2 * int((p[:, d] <= m).sum()) - len(p)), d, m) for d in range(LETTERS) for m in np.unique(p[:, d])[:-1].tolist()]
        if not spread:
            return None
        _, d, m = min(spread)
        left = p[:, d] <= m
        return d, m, self._split(p[left], most, depth + 1), self._split(p[~left], most, depth + 1)

    def cells(self, counts: np.ndarray, length: int, radius: int):
        """Yields (row numbers, cell) for all cells of a length that points within the radius of each row may lie in."""
        stack = [(self.trees.get(length), 1, np.arange(len(counts)))]
        while stack:
            node, cell, rows = stack.pop()
            if not len(rows):
                continue
            if node is None:
                yield rows, cell
                continue
            d, m, low, high = node
            x = counts[rows, d].astype(int)
            stack += [(low, 2 * cell, rows[x - m <= radius]), (high, 2 * cell + 1, rows[m + 1 - x <= radius])]


PLACED = "length int, cell long, asks boolean, word string, n long"


def _placed(words: DataFrame, planes: Planes) -> DataFrame:
    """Each word once as a point in its cell (asks: false), and as a query in each cell of its own length and of words one
    longer that may hold a word one edit away."""

    def batches(it):
        for b in it:
            words_ = b.column("word").to_pylist()
            lengths = np.fromiter(map(len, words_), np.int32, len(words_))
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                counts = letter_counts([words_[i] for i in own])
                for asks, size, radius in ((False, length, 0), (True, length, 2), (True, length + 1, 1)):
                    for rows, cell in planes.cells(counts, size, radius):
                        at, n = pa.array(own[rows]), len(rows)
                        same = lambda v, k: pa.array(np.full(n, v), k)  # noqa: B023, E731
                        yield pa.record_batch([same(size, pa.int32()), same(cell, pa.int64()), same(asks, pa.bool_()), b.column("word").take(at), b.column("n").take(at)], names=["length", "cell", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(batches, PLACED)


def _runs(it):
    """Slices of batches whose rows have the same (length, cell, part, asks), with these."""
    for b in it:
        keys = np.stack([b.column(c).cast(pa.int64()).to_numpy() for c in ("length", "cell", "part", "asks")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                yield keys[x].tolist(), b.slice(x, y - x)


def _matches(it):
    """Batches sorted by cell, part and asks, so that a cell's points come before its queries: a tree is built of the points,
    and the queries pass through it in blocks."""
    key, words, n, tree = None, [], [], None
    for (length, cell, part, asks), rows in _runs(it):
        if (length, cell, part) != key:
            key, words, n, tree = (length, cell, part), [], [], None
        if not asks:
            words += rows.column("word").to_pylist()
            n.append(rows.column("n").to_numpy())
            continue
        if not words:
            continue
        if tree is None:
            tree, points, counts = Tree(letter_counts(words)), Words(words), np.concatenate(n)
        asked, times = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        for size in (length, length - 1):
            own = np.flatnonzero(np.fromiter(map(len, asked), np.int64, len(asked)) == size)
            for at in range(0, len(own), BLOCK):
                some = own[at : at + BLOCK]
                block, radius = Words([asked[i] for i in some]), 2 if size == length else 1
                found = [(i[ok], j[ok]) for i, j in tree.within(letter_counts(block.words), radius) if len(i) for ok in (block.one_edit(points, i, j),)]
                if not found:
                    continue
                i, j = (np.concatenate(x) for x in zip(*found))
                a, b = pa.array(block.words).take(pa.array(i)), pa.array(words).take(pa.array(j))
                yield pa.record_batch([a, b, pa.array(counts[j])], names=["word", "near", "near_n"])
                if size < length:  # only shorter words ask
                    yield pa.record_batch([b, a, pa.array(times[some][i])], names=["word", "near", "near_n"])


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, near, near_n of all ordered pairs of different words that are one inserted, deleted or replaced code point
    apart; words: (word, n), each word once.

    One replaced code point changes two letter counts by one, an inserted one changes one, so words one edit away lie within
    L1 distances of 2 among those of the same length and of 1 among those one longer. Each length has a k-d tree, split over
    tasks into cells by planes that come from about `sample` words; a word is a point in one cell and a query in all that its
    range meets. Cells that turn out larger than four times `cell` are split by hash, so that a tree stays small; queries
    pass by in blocks. Boxes prune, the order of letters decides.
    """
    known = written(words.select("word", "n"), "words")
    total = known.count()
    every = max(1, -(-total // sample))
    some = known.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0)
    planes = Planes([r.word for r in some.select("word").collect()], 1 / every, cell)  # about `sample` words
    placed = written(_placed(known, planes), "placed")
    parts = placed.where("not asks").groupBy("length", "cell").agg(F.ceil(F.count("*") / (4 * cell)).cast("int").alias("_parts"))
    both = placed.join(parts, ["length", "cell"])  # cells without a point have no answers
    dealt = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")))
    rows = both.withColumn("part", F.explode(dealt)).select("length", "cell", "part", "asks", "word", "n")
    keys = ["length", "cell", "part"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(_matches, "word string, near string, near_n long")


def forms(words: DataFrame, pairs: DataFrame, times: int = 5) -> DataFrame:
    """word, n, form, n_near, form_n: the near word of largest n, the first of ties in code-point order, if it has at least
    `times` the occurrences."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    known = words.join(best, "word", "left")
    formed = -F.col("b.m") >= times * F.col("n")
    return known.select("word", "n", F.when(formed, F.col("b.near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("b.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """found (word, form, ...) with root: where its forms lead, the word itself without one. Steps double each round, and a
    form has at least five times the occurrences, so there are no circles and few rounds."""
    now = written(found.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(looked_up(now, step, hot_keys(now, "root")).select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").limit(1).count() == 0:
            return found.join(now, "word")


def spelling_variants(docs: DataFrame, divisor: int = 199, shortest: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words that documents have often enough.

    A null text has no words, a null doc_id hashes as an empty one; texts are read whole; repeated rows count each time; an
    empty table, or one without such words, gives an empty table; other columns are left behind.
    """
    words = written(word_counts(docs, divisor, shortest, least), "counts")
    found = written(forms(words, near_words(words), times), "forms")
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_sql(divisor: int = 199, shortest: int = 6, least: int = 5, times: int = 5) -> str:
    """The same in SQL: the checksum byte by byte, and words one edit apart by what is left when a code point is taken out."""
    step = "list_reduce(list_prepend(cast(n as ubigint), range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as ubigint)) else c >> 1 end)"
    code = "list_transform(string_split(doc || ':' || run, ''), lambda c: case when unicode(c) < 128 then [cast(unicode(c) as ubigint)] else [cast(195 as ubigint), cast(unicode(c) - 64 as ubigint)] end)"
    crc = f"xor(list_reduce(list_prepend(cast(4294967295 as ubigint), flatten({code})), lambda c, b: xor(c >> 8, entries[cast(xor(c, b) & 255 as int) + 1])), cast(4294967295 as ubigint))"
    return f"""
with recursive crc as (select list({step} order by n) as entries from range(256) r(n)),
runs as (select coalesce(cast(doc_id as varchar), '') as doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) group by 1, 2),
hashed as (select run, n, {crc} as h from runs, crc),
words as materialized (select case when h % {divisor} = 0 then left(run, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, cast(sum(n) as bigint) as n from hashed group by 1 having length(word) >= {shortest} and sum(hashed.n) >= {least}),
holes as materialized (select word, n, i, left(word, cast(i as int)) || substr(word, cast(i as int) + 2) as rest from words, unnest(range(length(word))) u(i)),
near as (select a.word, b.word as near, b.n from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select h.word, w.word, w.n from holes h join words w on w.word = h.rest
  union select w.word, h.word, h.n from holes h join words w on w.word = h.rest),
best as (select word, count(*) as n_near, min({{'m': -n, 'near': near}}) as b from near group by 1),
formed as materialized (select w.word, w.n, case when -b.b.m >= {times} * w.n then b.b.near end as form, coalesce(b.n_near, 0) as n_near, case when -b.b.m >= {times} * w.n then -b.b.m end as form_n from words w left join best b using (word)),
paths(word, stop) as (select word, word from formed union all select p.word, f.form from paths p join formed f on f.word = p.stop where f.form is not null)
select f.word, f.form, p.stop as root, f.n, f.n_near, f.form_n from formed f join paths p using (word) join formed l on l.word = p.stop and l.form is null"""
