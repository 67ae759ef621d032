"""spark.read.format("tallyloom") and readStream: delimited files as a data source of Spark's own, planned by byte ranges.

register(spark) makes it known. It reads what pyarrow's file systems reach (local and mounted folders, hdfs, s3, gs); for
other stores there is ranges.scan, which also splits files that have quotes.
"""

from __future__ import annotations

import csv
import io
import operator
from dataclasses import dataclass, replace

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.operators.routing import opened
from tallyloom.sources import detect
from tallyloom.sources.formats import LITERAL, RELAXED, STRICT, Options, parsed
from tallyloom.sources.ranges import HEAD, _head, _plain, decoded, judged

#: what every row has besides its file's columns: the file, the byte that its range begins at, and its number in the range
PLACE = (("_source_file", StringType()), ("_at", LongType()), ("_n", LongType()))
FAILURES = ("raw", "reason", "detail")


@dataclass
class Part(InputPartition):
    """A range of a file, with what the file's head tells. Files that may hold quotes are one range."""

    file: str
    start: int
    end: int
    encoding: str
    delimiter: str
    header: list[str] | None
    named: bool


def _options(options) -> Options:
    flag = lambda k: None if options.get(k) is None else options[k].lower() == "true"
    number = lambda k: int(options[k]) if options.get(k) else None
    return Options(options.get("encoding"), options.get("delimiter"), options.get("quotemode"), flag("header"), number("skiprows") or 0, number("previewrows"))


def _files(path: str) -> list[tuple[str, int, int]]:
    """(file, bytes, time of change in ns) of the files at a path: one file, or those of a folder that aren't hidden."""
    system, name = opened(path) if ":" in path.split("/")[0] else FileSystem.from_uri(path)
    top = system.get_file_info(name)
    found = [top] if top.type == FileType.File else system.get_file_info(FileSelector(name, recursive=True)) if top.type == FileType.Directory else []
    start = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted((start + f.path, f.size, f.mtime_ns or 0) for f in found if f.type == FileType.File and f.base_name[0] not in "._")


def _open(file: str):
    system, name = opened(file) if ":" in file.split("/")[0] else FileSystem.from_uri(file)
    return system.open_input_file(name)


def _parts(file: str, size: int, o: Options, wide: int) -> list[Part]:
    with _open(file) as f:
        sample = f.read(HEAD)
    bare = sample.removeprefix(b"\xef\xbb\xbf")
    encoding = o.encoding or detect.encoding(sample[: detect.SAMPLE])
    delimiter = o.delimiter or detect.delimiter(decoded(bare[: 4 * detect.SAMPLE], encoding))
    header, named = _head(bare, o, encoding, delimiter, o.quote_mode or RELAXED)
    whole = Part(file, 0, size, encoding, delimiter, header, named)
    if o.quote_mode != LITERAL or o.skip_rows:  # only where no cell holds a line end does a line end a record
        return [whole]
    return [replace(whole, start=at, end=min(at + wide, size)) for at in range(0, max(size, 1), wide)]


def _lines(p: Part):
    """The lines that begin in a range, decoded."""
    with _open(p.file) as f:
        at = p.start
        if at == 0 and f.read(3) != b"\xef\xbb\xbf" or at:
            f.seek(max(at - 1, 0))
        buffer = io.BufferedReader(f, 1 << 20)
        if at:
            buffer.readline()
        while buffer.tell() < p.end and (line := buffer.readline()):
            yield from io.StringIO(decoded(line, p.encoding), newline="")


def _sound(p: Part) -> bool:
    try:
        for _ in parsed(_lines(p), p.delimiter, STRICT):
            pass
        return True
    except csv.Error:
        return False


def _records(p: Part, o: Options):
    """(number, cells or None, raw, reason, detail) of a range."""
    mode = o.quote_mode or (STRICT if _sound(p) else RELAXED)
    taken: list[str] = []

    def lines():
        for line in _lines(p):
            taken.append(line)
            yield line

    n = -o.skip_rows - (p.named and p.start == 0)
    try:
        for cells in parsed(lines(), p.delimiter, mode):
            raw = _plain("".join(taken))
            taken.clear()
            cells = [c.strip() for c in cells]
            if any(cells) or len(cells) > 1:
                if n >= 0:
                    if o.preview_rows is not None and n >= o.preview_rows:
                        return
                    good, reason, detail = judged(cells, p.header)
                    yield n, good, raw, reason, detail
                n += 1
    except csv.Error as e:
        yield max(n, 0), None, _plain("".join(taken)), "PARSE_ERROR", str(e)


_TESTS = {EqualTo: operator.eq, EqualNullSafe: operator.eq, In: lambda v, some: v in some, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains}


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.options, self.o = schema, options, _options(options)
        self.tests: list = []

    def partitions(self) -> list[Part]:
        return self.planned(_files(self.options["path"]))

    def planned(self, files) -> list[Part]:
        wide = int(self.options.get("rangebytes", 64 << 20))
        return [p for file, size, _ in files for p in _parts(file, size, self.o, wide)]

    def read(self, partition: Part):
        names = [f.name for f in self.schema.fields]
        failures = self.options.get("rows") == "failures"
        for n, cells, raw, reason, detail in _records(partition, self.o):
            if failures != (reason is not None):
                continue
            row = dict(zip(FAILURES, (raw, reason, detail))) if failures else dict(zip(partition.header, cells))
            if all(test(row.get(c, ""), v) for c, test, v in self.tests):
                row |= {"_source_file": partition.file, "_at": partition.start, "_n": n}
                yield tuple(row.get(c, "") for c in names)


class FilteringReader(Reader):
    """A reader that leaves rows out before they reach Spark. Spark 4.1 keeps the first plan of a loaded frame with its filters
    and takes it for the frame's other queries too, so load anew for each query; hence this is asked for (option pushdown)."""

    def pushFilters(self, filters: list[Filter]):
        """Takes filters on the file's own columns, whose cells are never null, before rows leave the reader; gives the rest
        back to Spark."""
        own = {f.name for f in self.schema.fields} - {n for n, _ in PLACE}
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in own and self.options.get("rows") != "failures":
                if type(f) in _TESTS:
                    self.tests.append((f.attribute[0], _TESTS[type(f)], f.value))
                    continue
                if isinstance(f, (IsNotNull, IsNull)):
                    self.tests.append((f.attribute[0], lambda v, want: (v is None) == want, isinstance(f, IsNull)))
                    continue
            yield f


class StreamReader(Reader, DataSourceStreamReader):
    """New files, in the order of their times of change: an offset is the last file's time and name."""

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        found = max(((t, f) for f, _, t in _files(self.options["path"])), default=(-1, ""))
        return {"time": found[0], "file": found[1]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        key = lambda o: (o["time"], o["file"])
        return self.planned([x for x in _files(self.options["path"]) if key(start) < (x[2], x[0]) <= key(end)])

    def commit(self, end: dict) -> None:
        pass


class Tallyloom(DataSource):
    """Options: path, header, delimiter, encoding, quoteMode (strict, relaxed, literal), skipRows, previewRows, rangeBytes (of
    literal files), rows (good or failures), pushdown (true: FilteringReader, with spark.sql.python.filterPushdown.enabled).
    A schema with some of the columns reads those alone."""

    @classmethod
    def name(cls) -> str:
        return "tallyloom"

    def schema(self) -> StructType:
        """The columns of the first file that has any; what another file lacks is blank."""
        names: list[str] = list(FAILURES) if self.options.get("rows") == "failures" else []
        for file, size, _ in [] if names else _files(self.options["path"]):
            if header := _parts(file, size, _options(self.options), max(size, 1))[0].header:
                names = header
                break
        return StructType([*(StructField(n, StringType()) for n in names), *(StructField(n, t) for n, t in PLACE)])

    def reader(self, schema: StructType) -> Reader:
        return (FilteringReader if self.options.get("pushdown", "").lower() == "true" else Reader)(schema, self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known."""
    spark.dataSource.register(Tallyloom)
