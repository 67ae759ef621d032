"""MinHash near-dedup: BagMinHash signatures of word shingles, bands, and verified multiset overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import Memo, id_and_text, small_batches, table, written
from tallyloom.llm.graph import connected_components, hot_keys, looked_up
from tallyloom.llm.repeats import mixed

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5  # at a similarity of 0.8 one pair in 20,000 shares no band
SIZE = BANDS * ROWS
BLOCK = 512  # documents of a bucket whose texts are compared at a time
WIDE = 4096  # documents of a bucket whose sketches are compared at a time
AGREE = 70  # of SIZE components that must agree in 8 bits; at a similarity of 0.8 one pair in 3 * 10^9 has fewer
_GOLD = np.uint64(0x9E3779B97F4A7C15)

_hashes = Memo(xxhash.xxh3_64_intdigest, 300_000)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Hashes of the runs of five words with their counts, and the text with its words joined by one blank.

    Words are what lies between the bytes 0x20 and 0x09 to 0x0D. One to four words are one shingle.
    """
    words = text.encode("utf-8").split()
    if not words:
        return np.array([], np.uint64), np.array([], np.int64), b""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mixed(out * _GOLD + h[i : i + len(out)])
    values, counts = np.unique(out, return_counts=True)
    return values, counts, b" ".join(words)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets: sum of least counts over sum of greatest."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def waiting(number: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The time to a Poisson process' next point, from a random number."""
    return -np.log(((number >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate


def bag_signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """BagMinHash: for each multiset the earliest point of every component, as 32 bits of its time.

    Weights are whole counts. Over an element's weight axis run Poisson processes, at first one for each of the intervals
    (0, 1], (1, 2], (2, 4], (4, 8] ... with a rate in proportion to its length. A process of more than one unit splits in two
    at its first point: the point goes to one half, and the other half's first point comes later. A half that lies beyond
    the set's weight of the element is left at once, so a heavy element costs the logarithm of its weight. A point of a
    unit's process counts for the component that it draws. Numbers come from the element and the interval alone, so the
    processes are the same in every set and components agree with the probability of the weighted Jaccard similarity.
    Points come in order of time, and a process ends once it is behind all components of its set.
    """
    best = np.full((len(sets), size), np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    if not len(owner):
        return np.zeros((len(sets), size), np.uint32)
    element, count = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
    levels = [(owner, element, count, np.zeros(len(owner), np.int64))]
    level = 1
    while (deep := count > 1 << level - 1).any():
        levels.append((owner[deep], element[deep], count[deep], np.full(int(deep.sum()), level)))
        level += 1
    owner, element, count, level = (np.concatenate(x) for x in zip(*levels))
    length = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    low = np.where(level > 0, length, 0)
    seed = mixed(element + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    point = mixed(seed + _GOLD)
    time = waiting(point, size * length)
    while len(owner):
        leaf = length == 1
        component = ((mixed(point[leaf] ^ _GOLD) >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best.ravel(), owner[leaf] * size + component, time[leaf])
        after = mixed(point[leaf] + seed[leaf])
        nodes = [(owner[leaf], count[leaf], low[leaf], length[leaf], seed[leaf], after, time[leaf] + waiting(after, size))]
        if not leaf.all():
            o, c, at, n, own, number, t = (x[~leaf] for x in (owner, count, low, length, seed, point, time))
            half, taken = n // 2, mixed(number ^ own) & np.uint64(1)
            for side in (0, 1):
                child = mixed(own + np.uint64((2 * side + 1) * int(_GOLD) & (1 << 64) - 1))
                fresh = mixed(child + number)
                first = taken == side
                start = at + side * half
                kept = start < c
                born = np.where(first, number, fresh), np.where(first, t, t + waiting(fresh, size * half))
                nodes.append(tuple(x[kept] for x in (o, c, start, half, child, *born)))
        owner, count, low, length, seed, point, time = (np.concatenate(x) for x in zip(*nodes))
        go = time < best.max(axis=1)[owner]
        if not go.all():
            owner, count, low, length, seed, point, time = (x[go] for x in (owner, count, low, length, seed, point, time))
    return (mixed(best.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signatures), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = mixed(keys * _GOLD + signatures[:, i : BANDS * ROWS : ROWS].astype(np.uint64))
    return keys.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a, b (128 bits that tell different word sequences apart), bands (empty for texts without words), and bits, the
    last 8 bits of each component."""
    small_batches(docs.sparkSession)

    def batches(it):
        for b in it:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [shingles(t.as_py()) for t in part.column("text")]
                signatures = bag_signatures([x[:2] for x in found])
                bands = band_keys(signatures)
                sums = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x[2]) for x in found), ">i8").reshape(-1, 2)
                keys = pa.array([k if len(x[0]) else [] for x, k in zip(found, bands.tolist())], pa.list_(pa.int64()))
                bits = pa.array([x.tobytes() for x in signatures.astype(np.uint8)], pa.binary())
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(sums[:, 0].astype("i8")), pa.array(sums[:, 1].astype("i8")), keys, bits],
                    names=["doc_id", "a", "b", "bands", "bits"],
                )

    return docs.mapInArrow(batches, "doc_id long, a long, b long, bands array<long>, bits binary")


def verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose texts' multisets of shingles overlap enough."""

    def batches(it):
        kept: dict[int, tuple] = {}

        def of(i, text):
            if i not in kept:
                if len(kept) >= 256:
                    kept.clear()
                kept[i] = shingles(text.as_py())[:2]
            return kept[i]

        for b in it:
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            ok = [overlap(of(i, s), of(j, t)) >= similar for i, j, s, t in zip(a, c, b.column("text_a"), b.column("text_b"))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(batches, "a long, b long").distinct()


def block_links(ids: np.ndarray, component: np.ndarray, texts: list[str], similar: float) -> tuple[list[int], list[int]]:
    """Links between documents of different components, as few as join those that belong together.

    Exact overlaps of one document with all others are added up at once over the block's shingles. Documents of the
    block's largest component are only met by others.
    """
    sets = [shingles(t)[:2] for t in texts]
    sizes = np.array([len(x[0]) for x in sets], np.int64)
    totals = np.array([x[1].sum() for x in sets], np.int64)
    place = np.unique(np.concatenate([x[0] for x in sets]), return_inverse=True)[1]
    count = np.concatenate([x[1] for x in sets])
    start = np.cumsum(sizes) - sizes
    own = np.zeros(int(place.max()) + 1, np.int64)
    values, label, n = np.unique(component, return_inverse=True, return_counts=True)
    group = list(range(len(values)))

    def root(g):
        while group[g] != g:
            group[g] = group[group[g]]
            g = group[g]
        return g

    a, b = [], []
    for x in np.flatnonzero(label != n.argmax()):
        mine = slice(start[x], start[x] + sizes[x])
        own[place[mine]] = count[mine]
        both = np.add.reduceat(np.minimum(count, own[place]), start)
        own[place[mine]] = 0
        for y in np.flatnonzero((both >= similar * (totals + totals[x] - both)) & (label != label[x])):
            g, h = root(int(label[x])), root(int(label[y]))
            if g != h:
                group[g] = h
                a.append(int(min(ids[x], ids[y])))
                b.append(int(max(ids[x], ids[y])))
    return a, b


def near_in_sketch(component: np.ndarray, bits: np.ndarray, block: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents that agree in AGREE components with one of another component, and the two blocks that they meet in. Where
    there are two parts, only documents of different parts are compared."""
    who, low, high = [], [], []
    values, label, n = np.unique(component, return_inverse=True, return_counts=True)
    part = part if part.min() < part.max() else np.arange(len(part))
    for x in np.flatnonzero(label != n.argmax()):
        near = np.flatnonzero(((bits == bits[x]).sum(axis=1) >= AGREE) & (label != label[x]) & (part != part[x]))
        for y in near:
            who += [x, y]
        pair = np.repeat(np.stack([np.minimum(block[x], block[near]), np.maximum(block[x], block[near])]), 2, axis=1)
        low.append(pair[0])
        high.append(pair[1])
    if not who:
        return (np.array([], np.int64),) * 3
    found = np.unique(np.stack([np.array(who, np.int64), np.concatenate(low), np.concatenate(high)]), axis=1)
    return found[0], found[1], found[2]


def bucket_links(rows: DataFrame, sketched: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Verified links (a, b) between different components in the same bucket.

    A bucket is cut into blocks, and each two blocks are compared in a task of their own, so no bucket is too large for
    one. Sketches of 125 bytes are compared first, in wide blocks. Only documents with a likely partner there go on, to
    the narrow blocks that hold both, where their texts are compared exactly; only links leave a task.
    """
    count = lambda size: F.ceil(F.col("n") / size).cast("int")
    spread = F.xxhash64("doc_id", "key")
    base = rows.select("key", "doc_id", "component", "n", F.pmod(spread, count(BLOCK)).cast("int").alias("block"), F.pmod(F.shiftright(spread, 20), count(WIDE)).cast("int").alias("own"))
    wide = base.join(sketched.select("doc_id", "bits").dropDuplicates(["doc_id"]), "doc_id")
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), count(WIDE) - 1)))
    wide = wide.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "component", "block", "own", "bits")

    def sieve(t: pa.Table) -> pa.Table:
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(-1, SIZE)
        who, low, high = near_in_sketch(t.column("component").to_numpy(), bits, t.column("block").to_numpy(), t.column("own").to_numpy())
        ids, component = t.column("doc_id").to_numpy()[who], t.column("component").to_numpy()[who]
        return pa.table({"key": np.full(len(who), t.column("key")[0].as_py(), np.int64), "i": low.astype(np.int32), "j": high.astype(np.int32), "doc_id": ids, "component": component})

    likely = wide.groupBy("key", "i", "j").applyInArrow(sieve, "key long, i int, j int, doc_id long, component long")
    cells = written(likely.distinct(), "likely").join(texts, "doc_id")

    def compare(t: pa.Table) -> pa.Table:
        a, b = block_links(t.column("doc_id").to_numpy(), t.column("component").to_numpy(), t.column("text").to_pylist(), similar)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id for each row of docs: the smallest doc_id of its class.

    Classes are the components of the links between texts whose multisets of five-word shingles have a weighted Jaccard
    similarity of `similar` or more. Texts with the same words are one from the start, so copies cost nothing further.
    In a bucket of a band each text is first verified against the one text there that shares most buckets, which joins
    a group of near copies by as many pairs as it has members; texts of a bucket that are then still in different
    components are compared among each other, block by block. So every linked pair that shares a band counts.

    A bucket or a text that very many documents share is met where these lie (graph.looked_up).

    Null and empty texts have no words and are one class; very long texts are compared whole. Rows that share a doc_id are
    one document. A row without a doc_id is in no class: its class_id is null. Other columns are left behind whatever their
    names. An empty table gives an empty table.
    """
    base = id_and_text(docs)
    sketched = written(sketches(base.where("doc_id is not null")), "sketches")
    heads = sketched.groupBy("a", "b").agg(F.min("doc_id").alias("head"))
    member = written(looked_up(sketched.select("doc_id", "a", "b"), heads, hot_keys(sketched, "a", "b")).select("doc_id", "head").distinct(), "members")
    same_id = member.where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    bands = sketched.join(member.where("doc_id = head").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("key")).distinct()
    sizes = written(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    hot = written(hot_keys(bands, "key"), "hot")
    buckets = written(looked_up(bands, sizes, hot).select("key", "doc_id", "n"), "buckets")
    weight = buckets.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    centre = buckets.join(weight, "doc_id").groupBy("key").agg(F.max(F.struct("weight", "doc_id"))["doc_id"].alias("centre"))
    spokes = looked_up(buckets, centre, hot).where("doc_id <> centre").select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"))
    tried = written(spokes.distinct(), "pairs")
    candidates = written(buckets.select("doc_id").distinct(), "candidates")  # of known size, so a small one spares the texts a shuffle
    texts = written(base.join(candidates, "doc_id", "left_semi"), "texts")
    links = written(verified(tried, texts, similar), "links")
    component = connected_components(links)
    placed = buckets.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    open_keys = placed.where("n > 2").groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    unsettled = written(looked_up(placed, open_keys, hot), "unsettled")
    more = written(bucket_links(unsettled, sketched, texts, similar), "links")
    classes = connected_components(links.union(more).union(same_id))
    out = base.select("doc_id").join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows whose class has a smaller doc_id. Of rows that share a doc_id the one whose columns have the
    least hash stays, the same in every run; rows without an id all stay."""
    classes = near_duplicates(docs)
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]  # maps have no hash
    held = docs.select(F.col("doc_id").cast("long").alias("kept_id"), F.struct("*").alias("row"), F.xxhash64(*hashed).alias("order"))
    first = held.join(kept, "kept_id").groupBy("kept_id").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return first.union(docs.where("doc_id is null"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
