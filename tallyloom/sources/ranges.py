"""Delimited files of any size, split over tasks although a quoted cell may hold line ends.

Spark splits the files at line ends (its text source, which takes any store, and any encoding in which a line end is the
byte 10 alone). A split can't tell whether it begins inside a quoted cell. So each first finds out where it would end from
either side; these effects are put together in the order of a file, after which each split knows where it begins and
parses its own records once. What of a record lies in several splits is put together by record.
"""

from __future__ import annotations

import csv
import io
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.settle import settled
from tallyloom.sources import detect
from tallyloom.sources.formats import BROKEN, LITERAL, MISALIGNED, RELAXED, STRICT, UNDECODABLE, Options, parsed, unique

HEAD = 1 << 20  # bytes of a file that tell its encoding, delimiter and names
OUTSIDE, INSIDE, FAULT = 0, 1, 2  # where a split begins or ends: between records, in a quoted cell, after a fault
DELIMITERS = ",\t;"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (where its split begins), line: the bytes of each line, in order within a task."""
    meta = lambda c, name: F.col(f"_metadata.{c}").alias(name)
    return spark.read.option("lineSep", "\n").text(path).select(meta("file_path", "file"), meta("file_block_start", "at"), F.col("value").cast("binary").alias("line"))


def _chunks(it):
    """(file, at, bytes) of batches of lines: whole lines, none of two splits together."""
    for b in it:
        if not b.num_rows:
            continue
        at, files = b.column("at").to_numpy(), b.column("file").dictionary_encode()
        key = np.stack([at, files.indices.to_numpy()], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        lines = b.column("line").to_pylist()
        for x, y in zip(cuts, cuts[1:]):
            yield b.column("file")[x].as_py(), int(at[x]), b"\n".join(lines[x:y]) + b"\n"


class Records:
    """The records of some lines that may begin and end inside a quoted cell.

    Iterating gives (cells, raw, whole): whole is False for the rest of a record that began before the lines, and for the
    beginning of one that goes on after them (then `open` is True). A fault is raised as csv.Error.
    """

    def __init__(self, lines, delimiter: str, mode: str, inside: bool = False):
        self.lines, self.delimiter, self.mode, self.inside = lines, delimiter, mode, inside and mode != LITERAL
        self.taken: list[str] = []
        self.open = False
        self._pulled = self._done = 0
        self._end = False

    def _fed(self):
        if self.inside:
            self._pulled += 1
            yield '"'
        for line in self.lines:
            self._pulled += 1
            self.taken.append(line)
            yield line
        if self.mode != LITERAL:  # closes what is open, or is a record of its own
            self._pulled += 1
            self._end = True
            yield '"\n'

    def raw(self) -> str:
        out = "".join(self.taken)
        self.taken.clear()
        return out

    def __iter__(self):
        rest = self.inside
        try:
            for cells in parsed(self._fed(), self.delimiter, self.mode):
                if self._end:
                    if self._done < self._pulled - 1 and (self.taken or rest):
                        self.open = True
                        yield cells, self.raw(), False
                    return
                self._done = self._pulled
                yield cells, self.raw(), not rest
                rest = False
        except csv.Error:
            if not (self._end and self._done == self._pulled - 1):
                raise


def effect(text: str, delimiter: str, mode: str, begins: int) -> int:
    """Where lines end that begin outside or inside a quoted cell."""
    if begins == FAULT or '"' not in text or mode == LITERAL:
        return begins
    records = Records(io.StringIO(text, newline=""), delimiter, mode, begins == INSIDE)
    try:
        for _ in records:
            records.taken.clear()
    except csv.Error:
        return FAULT
    return INSIDE if records.open else OUTSIDE


def _ways(o: Options) -> list[tuple[str, str]]:
    """The delimiters and modes that a file may turn out to have."""
    return [(d, m) for d in (o.delimiter or DELIMITERS) for m in ([o.quote_mode] if o.quote_mode else [STRICT, RELAXED])]


def _effects(it, o: Options):
    """A row a split: file, at, ends (for each way, from outside and from inside), head (of the first splits)."""
    ways = _ways(o)
    for (file, at), chunks in itertools.groupby(_chunks(it), key=lambda c: c[:2]):
        ends, head = {(w, s): s for w in ways for s in (OUTSIDE, INSIDE)}, b""
        for _, _, content in chunks:
            if at + len(head) < HEAD:
                head += content[: HEAD - at - len(head)]
            text, known = content.decode("latin-1"), {}  # quotes, delimiters and line ends are the same bytes in all encodings
            for w, s in ends:
                d, m = w
                now = ends[w, s]
                if (d, m, now) not in known:
                    strict = known.get((d, STRICT, now), FAULT)
                    known[d, m, now] = strict if m == RELAXED and strict != FAULT else effect(text, d, m, now)
                ends[w, s] = known[d, m, now]
        yield pa.record_batch([pa.array([file]), pa.array([at], pa.int64()), pa.array([list(ends.values())], pa.list_(pa.int32())), pa.array([head], pa.binary())], names=["file", "at", "ends", "head"])


def decoded(content: bytes, encoding: str) -> str:
    return content.decode(encoding, "replace")  # Spark's lines come without a byte order mark


def _head(sample: bytes, o: Options, encoding: str, delimiter: str, mode: str) -> tuple[list[str] | None, bool]:
    """A file's column names, from its first records, and whether one of these holds them."""
    first: list[list[str]] = []
    try:
        for cells in parsed(io.StringIO(decoded(sample, encoding), newline=""), delimiter, mode):
            cells = [c.strip() for c in cells]
            if any(cells) or len(cells) > 1:
                first.append(cells)
            if len(first) == o.skip_rows + 5:
                break
    except csv.Error:
        pass
    first = first[o.skip_rows :]
    if not first:
        return None, False
    named = o.header if o.header is not None else detect.has_header(first)
    return (unique(first[0]) if named else [f"c{i}" for i in range(len(first[0]))]), named


PLAN = "file string, at long, begins int, encoding string, delimiter string, quote_mode string, header array<string>, named boolean"


def _composed(it, o: Options):
    """Rows of effects in the order of their files: for each split where it begins, and what its file is like."""
    ways = _ways(o)
    rows = ((b.column("file")[i].as_py(), b.column("at")[i].as_py(), b.column("ends")[i].as_py(), b.column("head")[i].as_py()) for b in it for i in range(b.num_rows))
    for file, splits in itertools.groupby(rows, key=lambda r: r[0]):
        splits = list(splits)  # a few numbers a split
        sample = b"".join(s[3] for s in splits)
        encoding = o.encoding or detect.encoding(sample[: detect.SAMPLE])
        start = decoded(sample[: 4 * detect.SAMPLE], encoding)
        delimiter = o.delimiter or detect.delimiter(start)
        for mode in [o.quote_mode] if o.quote_mode else [STRICT, RELAXED]:
            way, begins, now = ways.index((delimiter, mode)), [], OUTSIDE
            for _, _, ends, _ in splits:
                begins.append(now)
                now = now if now == FAULT else ends[2 * way + now]
            if now == OUTSIDE:  # read to its end without a fault
                break
        header, named = _head(sample, o, encoding, delimiter, mode)
        n = len(splits)
        columns = ([file] * n, [s[1] for s in splits], begins, [encoding] * n, [delimiter] * n, [mode] * n, [header] * n, [named] * n)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in PLAN.split(", ")])


RECORD, REST, BEGINNING = "record", "rest", "beginning"
PARTS = "file string, at long, n long, kind string, cells array<string>, header array<string>, raw string, reason string, detail string, encoding string, delimiter string, quote_mode string, named boolean"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=[x.split()[0] for x in PARTS.split(", ")])


def _plain(raw: str) -> str:
    return raw.removesuffix("\n").removesuffix("\r")


def judged(cells: list[str], header: list[str] | None) -> tuple[list[str] | None, str | None, str | None]:
    """A record's cells, or the reason against it, and a detail; a few characters that can't be decoded are a detail alone."""
    if len(cells) != len(header or []):
        return None, MISALIGNED, f"expected {len(header or [])} cells, got {len(cells)}"
    text = "".join(cells)
    lost = text.count("�")
    if lost and lost / len(text) >= 0.5:
        return None, UNDECODABLE, "half of the characters can't be decoded"
    return cells, None, f"{lost} characters can't be decoded" if lost else None


def _split_rows(file: str, at: int, facts: tuple, lines):
    """The rows of one split: its records, numbered, and the parts of those that it shares with others."""
    begins, encoding, delimiter, mode, header, named = facts
    common = (encoding, delimiter, mode, named)
    n = 0
    records = Records(lines, delimiter, mode, begins == INSIDE)
    first = begins == INSIDE
    try:
        for cells, raw, whole in records:
            if not whole:
                yield (file, at, n, REST if first else BEGINNING, None, header, raw, None, None, *common)
                first = False
                continue
            first = False
            cells = [c.strip() for c in cells]
            if any(cells) or len(cells) > 1:
                good, reason, detail = judged(cells, header)
                yield (file, at, n, RECORD, good, header, _plain(raw), reason, detail, *common)
                n += 1
    except csv.Error as e:
        if first:  # the fault is that of a record that began before
            yield (file, at, n, REST, None, header, records.raw(), None, None, *common)
        else:
            yield (file, at, n, RECORD, None, header, _plain(records.raw()), BROKEN, str(e), *common)


def _parse(it):
    """Batches of chunks with what is known of their splits, sorted by split: the rows of PARTS."""

    def chunks():
        names = ("file", "at", "begins", "encoding", "delimiter", "quote_mode", "header", "named", "content")
        for b in it:
            for i in range(b.num_rows):
                yield tuple(b.column(c)[i].as_py() for c in names)

    rows: list[tuple] = []
    for (file, at), own in itertools.groupby(chunks(), key=lambda c: c[:2]):
        first = next(own)
        if first[2] == FAULT:
            continue
        lines = itertools.chain.from_iterable(io.StringIO(decoded(c[8], first[3]), newline="") for c in itertools.chain([first], own))
        for row in _split_rows(file, at, first[2:8], lines):
            rows.append(row)
            if len(rows) == 5000:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _joined(it):
    """Parts sorted by record and place: each record as a row of PARTS, at the split that it began in."""
    names = [x.split()[0] for x in PARTS.split(", ")] + ["_start"]
    rows = (tuple(b.column(c)[i].as_py() for c in names) for b in it for i in range(b.num_rows))
    for (file, start), parts in itertools.groupby(rows, key=lambda r: (r[0], r[-1])):
        parts = list(parts)  # one record
        _, _, n, _, _, header, _, _, _, encoding, delimiter, mode, named, _ = parts[0]
        raw = "".join(p[6] for p in parts)
        try:
            cells = [c.strip() for c in next(parsed(io.StringIO(raw, newline=""), delimiter, mode))]
            if not any(cells) and len(cells) < 2:
                continue
            good, reason, detail = judged(cells, header)
        except csv.Error as e:
            good, reason, detail = None, BROKEN, str(e)
        yield _batch([(file, start, n, RECORD, good, header, _plain(raw), reason, detail, encoding, delimiter, mode, named)])


def scan(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """All records of the files at a path, good and bad: source_file, row_index, cells, header, raw, reason, detail,
    encoding, delimiter, quote_mode.

    Blank lines are skipped, cells trimmed, records numbered from 0 in each file. A record with another number of cells than
    the header, or half of whose characters can't be decoded, is a failure; fewer such characters are a warning (detail
    without a reason). A fault of quoting ends the file, which only the strict mode has; without a mode given, strict is
    taken if it reads all of the file, else relaxed. Encoding, delimiter and names come from a file's first megabyte.

    One pass finds the effects of the splits, one parses; what was parsed is kept (settled), so nothing that is asked of the
    result reads the files again. A split's chunks stay where they are while the plan, a row a split, is small enough for
    Spark to broadcast. A line, or a record, must fit in a task's memory; files themselves may be of any size.
    """
    lines = _lines(spark, path)
    effects = lines.mapInArrow(lambda it: _effects(it, options), "file string, at long, ends array<int>, head binary")
    plan = effects.repartition("file").sortWithinPartitions("file", "at").mapInArrow(lambda it: _composed(it, options), PLAN)

    def chunked(it):
        for n, (file, at, content) in enumerate(_chunks(it)):
            yield pa.record_batch([pa.array([file]), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([content], pa.binary())], names=["file", "at", "chunk", "content"])

    chunks = lines.mapInArrow(chunked, "file string, at long, chunk long, content binary")
    parts = settled(chunks.join(plan, ["file", "at"]).sortWithinPartitions("file", "at", "chunk").mapInArrow(_parse, PARTS))
    whole = parts.where(F.col("kind") == RECORD)
    beginning = F.col("kind") == BEGINNING
    start = F.last(F.when(beginning, F.col("at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at", beginning))
    shared = parts.where(F.col("kind") != RECORD).withColumn("_start", start)  # two rows a split at most
    joined = shared.repartition("file", "_start").sortWithinPartitions("file", "_start", "at").mapInArrow(_joined, PARTS)
    rows = whole.unionByName(joined)
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("file", "at").agg(F.count("*").alias("_n"))  # a row a split
    offsets = counts.select("file", "at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    index = F.col("_before") + F.col("n") - options.skip_rows - F.col("named").cast("int")
    fault = F.col("reason") == BROKEN
    out = rows.join(offsets, ["file", "at"]).withColumn("row_index", F.when(fault, F.greatest(index, F.lit(0))).otherwise(index)).where("row_index >= 0")
    if options.preview_rows is not None:
        out = out.where(F.col("row_index") < options.preview_rows)
    name = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))  # as it was listed
    return out.select(name.alias("source_file"), "row_index", "cells", "header", "raw", "reason", "detail", "encoding", "delimiter", "quote_mode")
