"""Exact removal of repeated passages: what byte and word operators share.

A window is W symbols in a row of one document. Every window has an anchor, its smallest k-gram (the last of equals), so
equal windows have equal anchors, and windows side by side mostly share one. Spark shuffles an anchor's windows as one
row; anchors seen once are done with. Of the others, stretches whose whole content was met before are removed as they
stand, and the distinct stretches of an anchor go with their content to a resolver that finds the windows they share.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import NULL_ID, small_batches, written

MASK = (1 << 24) - 1
CHUNK = 1 << 18  # windows handled at a time; more than that in a document go in parts
HOT = 2_000  # distinct stretches of an anchor beyond which its windows are split by a longer common part
GRID = 4  # windows of one such split
BUFFER = 1 << 20  # bytes of stretches resolved at a time
LARGE = 4  # buffers of distinct stretches that a key may have to be resolved in one task


@dataclass(frozen=True)
class Kind:
    """What a symbol is, how long a window is, and which of two equal windows is the later one."""

    window: int
    gram: int
    grid: int  # windows that are looked at together when stretches are trimmed
    symbols: Callable[[str], np.ndarray]  # 64-bit numbers
    content: Callable[[str], np.ndarray]  # what the resolver compares, one item per symbol
    resolve: Callable  # (stretches, firsts, windows) -> (stretch, offset) arrays of windows that were there before
    same_document: bool  # whether an earlier start in the same document counts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


_BASE = 0x9E3779B97F4A7C15
_POWERS = _powers(_BASE, CHUNK + 256)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 256)


def grams(s: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k symbols in a row, joined from halves."""
    base, out, length, power = 0xD1342543DE82EF95, None, 0, s
    size = 1
    while True:
        if k & size:
            if out is None:
                out, length = power, size
            else:
                n = len(s) - length - size + 1
                out = out[:n] * np.uint64(pow(base, size, 1 << 64)) + power[length : length + n]
                length += size
        if length == k:
            return mixed(out)
        n = len(power) - size
        power = power[:n] * np.uint64(pow(base, size, 1 << 64)) + power[size : size + n]
        size *= 2


def smallest(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if w > size else v


def anchors(s: np.ndarray, window: int, gram: int):
    """Yields (anchor hash, stretch hash, anchor, first window, last window) arrays of a document's stretches."""
    w = window - gram + 1
    for at in range(0, max(0, len(s) - window + 1), CHUNK):
        part = s[at : at + CHUNK + window - 1]
        h = grams(part, gram)
        place = np.uint64(MASK) - np.arange(len(h), dtype=np.uint64)
        least = smallest((h & ~np.uint64(MASK)) | place, w)
        anchor = (np.uint64(MASK) - (least & np.uint64(MASK))).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(anchor)) - 1
        # of the grams' mixed hashes, so that no likeness of texts carries over to the sums
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h ^ np.uint64(_BASE)) * _POWERS[: len(h)])])
        stretch = (sums[last + w] - sums[first]) * _INVERSE[first]
        stretch = mixed(stretch ^ (last - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        yield h[anchor[first]], stretch, anchor[first] + at, first + at, last + at


# A document is a doc_id and a text: rows that agree in both are one document. Texts of one doc_id are told apart by 79 bits,
# the 64 of `tag` and 15 of another hash, `check`, that stand above the places in one long.
# A stretch's place in one long: check, 34 bits of the anchor's place, and 7 bits each of the way back to the first window
# and on to the last.
def packed(check: int, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (check << 48) | (anchor << 14) | ((anchor - first) << 7) | (last - first)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, ...]:
    anchor = (place >> 14) & ((1 << 34) - 1)
    first = anchor - ((place >> 7) & 127)
    return place >> 48, anchor, first, first + (place & 127)


def tagged(docs: DataFrame) -> DataFrame:
    """id, text, tag, check and the row's other columns as one struct, so no name clashes."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    check = F.crc32(text.cast("binary")).bitwiseAND(F.lit(0x7FFF)).cast("int")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("tag"), check.alias("check"), F.struct(*rest).alias("rest"))


def stretches(rows: DataFrame, kind: Kind) -> DataFrame:
    """h, stretch, id, tag, place, live: the stretches of all documents, to be dealt by h.

    Of equal stretches in a batch only the first goes on to its anchor (where only other documents count, those of the first document):
    the others were there before whatever the rest of the corpus holds. So a passage that very many documents share, or
    one repeats, sends one row a batch to its anchor's task; the rest get an h of their own that deals them out evenly.
    A document that a batch holds twice counts once.
    """

    def batches(it):
        for b in it:
            got, seen = [], set()
            for document in zip(b.column("id").to_pylist(), b.column("tag").to_pylist(), b.column("check").to_pylist(), b.column("text")):
                i, tag, check, text = document
                if document[:3] in seen:
                    continue
                seen.add(document[:3])
                s = kind.symbols(text.as_py())
                h = s
                for h, stretch, anchor, first, last in anchors(s, kind.window, kind.gram):
                    got.append((h, stretch, np.full(len(h), i), np.full(len(h), tag), packed(check, anchor, first, last)))
                if len(got) >= 1000 or len(h) > 50_000:
                    yield _batch(got)
                    got, seen = [], set()
            if got:
                yield _batch(got)

    def _batch(got):
        h, s, i, t, p = (np.concatenate(x) for x in zip(*got))
        both = mixed(h ^ mixed(s))
        order = np.lexsort((p, t, i, both))
        first = np.flatnonzero(np.diff(both[order], prepend=~both[order[:1]]) != 0)
        lead = np.repeat(order[first], np.diff(np.append(first, len(order))))
        live = np.empty(len(h), bool)
        live[order] = (i[order] == i[lead]) & (not kind.same_document) | (order == lead) | (h[order] != h[lead]) | (s[order] != s[lead])
        h = np.where(live, h, both + (p ^ t).astype(np.uint64) * np.uint64(_BASE) + i.astype(np.uint64))
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(i), pa.array(t), pa.array(p), pa.array(live)], names=["h", "stretch", "id", "tag", "place", "live"])

    return rows.select("id", "tag", "check", "text").mapInArrow(batches, "h long, stretch long, id long, tag long, place long, live boolean")


def sifted(dealt: DataFrame, kind: Kind) -> DataFrame:
    """h, id, tag, place, what (0 removed whole, 1 open, 2 open and hot) from stretches sorted by h, stretch, id, tag, place.

    Reads its partition as a stream; of an anchor that spans batches it keeps HOT rows at most. Equal rows come from rows
    of docs that are one document and count once.
    """

    def batches(it):
        last_h = last_s = first_id = last_place = None
        held: list[tuple] = []  # open rows of the anchor that may go on: (id, tag, place)
        kinds, hot = 0, False  # its distinct stretches so far; whether it was found hot
        for b in it:
            live = b.column("live").to_numpy(zero_copy_only=False)
            h, s, i, t, p = (b.column(c).to_numpy() for c in ("h", "stretch", "id", "tag", "place"))
            dead = ~live
            if dead.any():
                yield from _batches([(h[dead], i[dead], t[dead], p[dead], np.zeros(int(dead.sum()), np.int8))])
                h, s, i, t, p = h[live], s[live], i[live], t[live], p[live]
            if not len(h):
                continue
            same = np.zeros(len(h), bool)
            same[1:] = (p[1:] == p[:-1]) & (t[1:] == t[:-1]) & (i[1:] == i[:-1]) & (s[1:] == s[:-1]) & (h[1:] == h[:-1])
            same[0] = last_h is not None and (h[0], s[0], i[0], t[0], p[0]) == (last_h, last_s, *last_place)
            if same.any():
                h, s, i, t, p = h[~same], s[~same], i[~same], t[~same], p[~same]
            if not len(h):
                continue
            new_h = np.diff(h, prepend=h[0]) != 0
            new_h[0] = last_h is None or h[0] != last_h
            new_s = new_h.copy()
            new_s[1:] |= s[1:] != s[:-1]
            new_s[0] |= last_s is None or s[0] != last_s
            lead = np.maximum.accumulate(np.where(new_s, np.arange(len(h)), -1))
            lead_id = np.where(lead >= 0, i[np.maximum(lead, 0)], 0 if first_id is None else first_id)
            again = ~new_s & ((i > lead_id) if not kind.same_document else True)
            out = [(h[again], i[again], t[again], p[again], np.zeros(int(again.sum()), np.int8))]
            group = np.cumsum(new_h)  # 0: goes on from the batch before
            count = np.bincount(group, minlength=group[-1] + 1)
            distinct = np.bincount(group, weights=new_s, minlength=len(count)).astype(np.int64)
            is_open = ~again
            opened = np.bincount(group, weights=is_open, minlength=len(count)).astype(np.int64)
            tail = len(count) - 1
            if count[0] == 0 and last_h is not None:  # the held anchor has ended
                out += _flush(last_h, held, kinds, hot)
                held, kinds, hot = [], 0, False
            rows = np.flatnonzero(is_open)
            ended = rows[(group[rows] > 0) & (group[rows] < tail)]
            g = group[ended]
            ended = ended[distinct[g] > 1]
            out.append((h[ended], i[ended], t[ended], p[ended], np.where(opened[group[ended]] > HOT, 2, 1).astype(np.int8)))
            for g in {0, tail}:
                if not count[g]:
                    continue
                own = rows[group[rows] == g]
                kinds += int(distinct[g])
                if hot:
                    out.append((h[own], i[own], t[own], p[own], np.full(len(own), 2, np.int8)))
                else:
                    held += zip(i[own].tolist(), t[own].tolist(), p[own].tolist())
                    if len(held) > HOT:
                        hot = True
                        out += _rows(int(h[own[0]]) if len(own) else last_h, held, 2)
                        held = []
                if g != tail:
                    out += _flush(int(h[0]), held, kinds, hot)
                    held, kinds, hot = [], 0, False
            last_h, last_s, first_id = int(h[-1]), int(s[-1]), int(lead_id[-1])
            last_place = (int(i[-1]), int(t[-1]), int(p[-1]))
            yield from _batches(out)
        if last_h is not None:
            yield from _batches(_flush(last_h, held, kinds, hot))

    def _rows(h, held, what):
        i, t, p = (np.array(x, np.int64) for x in zip(*held))
        return [(np.full(len(i), h), i, t, p, np.full(len(i), what, np.int8))]

    def _flush(h, held, kinds, hot):
        return _rows(h, held, 1) if held and not hot and kinds > 1 else []

    def _batches(out):
        out = [x for x in out if len(x[0])]
        if out:
            h, i, t, p, what = (np.concatenate(x) for x in zip(*out))
            yield pa.record_batch([pa.array(h), pa.array(i), pa.array(t), pa.array(p), pa.array(what)], names=["h", "id", "tag", "place", "what"])

    return dealt.mapInArrow(batches, "h long, id long, tag long, place long, what byte")


def contents(open_rows: DataFrame, texts: DataFrame, kind: Kind) -> DataFrame:
    """key, content, id, tag, start, anchor: the open stretches with what they hold. Equal windows keep equal keys.

    A start has the document's check above it. Rows of docs that are one document may come more than once.
    """
    wanted = open_rows.groupBy("id", "tag", F.shiftright("place", 48).cast("int").alias("check")).agg(F.collect_list(F.struct("h", "place", "what")).alias("wanted"))

    def batches(it):
        before = None
        for b in it:
            got, size = [], 0
            for i, tag, check, text, wanted in zip(*(b.column(c).to_pylist() for c in ("id", "tag", "check")), b.column("text"), b.column("wanted")):
                if (i, tag, check) == before:
                    continue
                before = (i, tag, check)
                c = kind.content(text.as_py())
                w = wanted.values
                h, place, what = (w.field(f).to_numpy() for f in ("h", "place", "what"))
                _, anchor, first, last = unpacked(place)
                for key, a, f, l, hot in zip(h.tolist(), anchor.tolist(), first.tolist(), last.tolist(), (what == 2).tolist()):
                    parts = [(key, f, l)]
                    if hot:
                        parts = []
                        for j in range((a - l) // GRID, (a - f) // GRID + 1):
                            common = c[a - GRID * j : a - GRID * j - GRID + 1 + kind.window]
                            own = int.from_bytes(_short(common.tobytes() + j.to_bytes(2, "big")), "big", signed=True)
                            parts.append((key ^ own, max(f, a - GRID * j - GRID + 1), min(l, a - GRID * j)))
                    for key_of, x, y in parts:
                        content = c[x : y + kind.window].tobytes()
                        got.append((key_of, content, i, tag, check << 48 | x, a - x))
                        size += len(content)
                if size > 1 << 22:
                    yield _batch(got)
                    got, size = [], 0
            if got:
                yield _batch(got)

    def _batch(got):
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*got), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["key", "content", "id", "tag", "start", "anchor"])

    joined = texts.select("id", "tag", "check", "text").join(wanted, ["id", "tag", "check"])
    return joined.select("id", "tag", "check", "text", "wanted").mapInArrow(batches, "key long, content binary, id long, tag long, start long, anchor int")


def _short(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_64_digest(data)


def trimmed(keys: list[int], texts: list[bytes], anchor: list[int], kind: Kind, item: int) -> tuple[list[int], list[int], list[bytes]]:
    """Which stretches can share windows with another of their key, where in them these start, and that part of them.

    The windows whose anchors are about as far in have a part in common; where no other stretch has that part too, none
    of these windows is shared.
    """
    grid, window = kind.grid, kind.window
    seen: dict[tuple, int] = {}
    cells = []
    for key, text, a in zip(keys, texts, anchor):
        last = len(text) // item - window
        own = []
        for j in range((a - last) // grid, a // grid + 1):
            cell = (key, j, text[(a - grid * j) * item : (a - grid * j - grid + 1 + window) * item])
            own.append((j, cell))
            seen[cell] = seen.get(cell, 0) + 1
        cells.append((last, own))
    which, offsets, parts = [], [], []
    for n, (last, own) in enumerate(cells):
        js = [j for j, cell in own if seen[cell] > 1]
        if js:
            first, end = max(0, anchor[n] - grid * max(js) - grid + 1), min(last, anchor[n] - grid * min(js))
            which.append(n)
            offsets.append(first)
            parts.append(texts[n][first * item : (end + window) * item])
    return which, offsets, parts


def resolved(dealt: DataFrame, kind: Kind) -> DataFrame:
    """id, tag, start, stop of windows that were there before, from contents sorted by key, content, id, tag, start.

    Keys are gathered to about BUFFER bytes of distinct stretches and resolved together. Equal rows count once. A key with
    more distinct stretches than a few BUFFERs is too large for a task: its windows come out one by one instead, with key and
    content and without a stop, for `equal_windows` to compare.
    """

    def batches(it):
        keys, anchor = [], []
        texts, firsts, same = [], [], []  # distinct stretches, their first place, and places with the first's verdict
        size, key_before, text_before, place_before = 0, None, None, None
        key_begins, key_size, large = 0, 0, False  # the last key: where its stretches begin, their bytes, whether those are too many
        out, single = [], []

        def postpone(content, i, tag, start):
            for at in range(0, len(content) - kind.window * kind_item + 1, kind_item):
                window = content[at : at + kind.window * kind_item]
                single.append((int.from_bytes(_short(window), "big", signed=True), window, i, tag, start + at // kind_item))

        def postpone_last_key():
            """Take the last key's stretches out of the buffer and let their windows go one by one."""
            nonlocal size
            begins = next((n for n, x in enumerate(same) if x[0] >= key_begins), len(same))
            for n, i, tag, start in same[begins:]:
                postpone(texts[n], i, tag, start)
            size -= sum(map(len, texts[key_begins:]))
            for held in (keys, anchor, texts, firsts):
                del held[key_begins:]
            del same[begins:]

        def flush():
            nonlocal keys, anchor, texts, firsts, same, size
            which, shift, parts = trimmed(keys, texts, anchor, kind, kind_item)
            if len(parts) > 1:
                begun = np.array([firsts[n] for n in which], np.int64)
                begun[:, 2] += shift
                owner = np.array([s[0] for s in same], np.int64)
                places = np.array([s[1:] for s in same], np.int64).reshape(-1, 3)
                stretch, offset = kind.resolve(parts, begun, kind.window)
                offset = offset + np.array(shift, np.int64)[stretch]
                stretch = np.array(which, np.int64)[stretch]
                if len(stretch):
                    order = np.lexsort((offset, stretch))
                    stretch, offset = stretch[order], offset[order]
                    new = np.flatnonzero((np.diff(stretch, prepend=-1) != 0) | (np.diff(offset, prepend=-9) != 1))
                    ends = np.append(new[1:], len(stretch)) - 1
                    a, b, n = stretch[new], offset[new], offset[ends] - offset[new] + kind.window
                    by = np.argsort(owner, kind="stable")
                    lo, hi = np.searchsorted(owner[by], a), np.searchsorted(owner[by], a, "right")
                    runs = np.repeat(np.arange(len(a)), hi - lo)
                    own = by[np.concatenate([np.arange(x, y) for x, y in zip(lo, hi)])]
                    start = places[own, 2] + b[runs]
                    out.append((places[own, 0], places[own, 1], start, start + n[runs]))
            keys, anchor, texts, firsts, same, size = [], [], [], [], [], 0

        for b in it:
            for key, content, i, tag, start, a in zip(*(b.column(c).to_pylist() for c in ("key", "content", "id", "tag", "start", "anchor"))):
                if key != key_before:
                    if size > BUFFER:
                        flush()
                    text_before, key_begins, key_size, large = None, len(texts), 0, False
                if large:
                    if (content, i, tag, start) != (text_before, *place_before):
                        postpone(content, i, tag, start)
                    text_before = content
                elif content != text_before:
                    same.append((len(texts), i, tag, start))
                    texts.append(content)
                    keys.append(key)
                    anchor.append(a)
                    firsts.append((i, tag, start))
                    size += len(content)
                    key_size += len(content)
                    text_before = content
                elif (i, tag, start) == place_before:
                    pass
                elif kind.same_document or i != firsts[-1][0]:
                    n = len(content) // kind_item
                    out.append(tuple(np.array([x], np.int64) for x in (i, tag, start, start + n)))
                else:
                    same.append((len(texts) - 1, i, tag, start))
                key_before, place_before = key, (i, tag, start)
                if not large and key_size > LARGE * BUFFER:
                    large = True
                    postpone_last_key()
                if len(single) > 20_000:
                    yield _windows(single)
                    single = []
            if out:
                yield _batch(out)
                out = []
        flush()
        if out:
            yield _batch(out)
        if single:
            yield _windows(single)

    names = ["id", "tag", "start", "stop", "key", "content"]

    def _batch(out):
        i, tag, start, stop = (np.concatenate(x) for x in zip(*out))
        none = [pa.nulls(len(i), t) for t in (pa.int64(), pa.binary())]
        return pa.record_batch([pa.array(i), pa.array(tag), pa.array(start), pa.array(stop), *none], names=names)

    def _windows(single):
        key, content, i, tag, start = zip(*single)
        return pa.record_batch([pa.array(i, pa.int64()), pa.array(tag, pa.int64()), pa.array(start, pa.int64()), pa.nulls(len(i), pa.int64()), pa.array(key, pa.int64()), pa.array(content, pa.binary())], names=names)

    kind_item = kind.content("").itemsize
    return dealt.mapInArrow(batches, "id long, tag long, start long, stop long, key long, content binary")


def equal_windows(dealt: DataFrame, kind: Kind) -> DataFrame:
    """id, tag, start, stop of single windows that were there before, from rows sorted by key, content, id, tag, start. Only
    the window before and the first place of it are held."""

    def batches(it):
        last, first_id, place_before = None, None, None
        for b in it:
            keep = []
            for n, (key, content, i, tag, start) in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "content", "id", "tag", "start")))):
                if (key, content) != last:
                    last, first_id = (key, content), i
                elif (i, tag, start) != place_before and (kind.same_document or i != first_id):
                    keep.append(n)
                place_before = (i, tag, start)
            found = b.select(["id", "tag", "start"]).take(pa.array(keep, pa.int64()))
            stop = pc.add(found.column("start"), kind.window)
            yield pa.record_batch([*found.columns, stop], names=["id", "tag", "start", "stop"])

    return dealt.mapInArrow(batches, "id long, tag long, start long, stop long")


def marked(docs: DataFrame, kind: Kind) -> DataFrame:
    """id, text, tag, check, rest, removed: each row of docs with the symbol ranges to remove, which may overlap; null for none."""
    small_batches(docs.sparkSession)
    texts = tagged(docs)
    sorted_by = ["h", "stretch", "id", "tag", "place"]
    sieve = written(sifted(stretches(texts, kind).repartition("h").sortWithinPartitions(*sorted_by), kind), "sieve")
    whole = sieve.where("what = 0").select(
        "id",
        "tag",
        F.shiftright("place", 48).cast("int").alias("check"),
        (F.expr("(shiftright(place, 14) & 17179869183) - (shiftright(place, 7) & 127)")).alias("start"),
        F.expr(f"(shiftright(place, 14) & 17179869183) - (shiftright(place, 7) & 127) + (place & 127) + {kind.window}").alias("stop"),
    )
    held = contents(sieve.where("what > 0"), texts, kind)
    by_content = ["key", "content", "id", "tag", "start"]
    found = written(resolved(held.repartition("key").sortWithinPartitions(*by_content), kind), "resolved")
    alone = found.where("content is not null").select(*by_content)
    shared = found.where("stop is not null").select("id", "tag", "start", "stop").union(equal_windows(alone.repartition("key").sortWithinPartitions(*by_content), kind))
    low = F.lit((1 << 48) - 1)
    shared = shared.select("id", "tag", F.shiftright("start", 48).cast("int").alias("check"), F.col("start").bitwiseAND(low).alias("start"), F.col("stop").bitwiseAND(low).alias("stop"))
    ranges = whole.union(shared).groupBy("id", "tag", "check").agg(F.collect_list(F.struct("start", "stop")).alias("removed"))
    return texts.join(ranges, ["id", "tag", "check"], "left")


def covered(removed, n: int) -> np.ndarray:
    """Which of n symbols lie in any of the ranges."""
    edges = np.zeros(n + 1, np.int64)
    if removed.is_valid:
        v = removed.values
        np.add.at(edges, v.field("start").to_numpy(), 1)
        np.add.at(edges, v.field("stop").to_numpy(), -1)
    return np.cumsum(edges[:n]) > 0
