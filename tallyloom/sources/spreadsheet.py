"""XLSX sheets as string tables, from the zip and XML of the standard library, row by row."""

from __future__ import annotations

import datetime
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from array import array
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources.formats import MISALIGNED, Options, unique

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


# Numbers of the built-in formats that show dates or times, and the codes of those that show numbers.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
NUMBERS = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;(#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;(#,##0.00)", 48: "##0.0E+0"}

#: what a format code shows as it stands: quoted text, a character behind a backslash; and what takes up room alone
_LITERAL, _ROOM = r'"([^"]*)"|\\(.)', r"_.|\*.|\[[^]]*\]"
_DIGITS = re.compile(r"[0#?][0#?,]*(?:\.[0#?]*)?(?:E[+-]?0+)?")


def _styles(z: zipfile.ZipFile) -> list[str | None]:
    """For each cell style the format code of its numbers, 'date' if they are shown as dates or times, None as they are."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_MAIN}numFmt")}
    dated = DATES | {n for n, code in own.items() if re.search("[ymdhs]", re.sub(rf"{_LITERAL}|{_ROOM}", "", code), re.I)}
    formats = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId") or 0) for x in (formats if formats is not None else [])]
    return ["date" if i in dated else own.get(i) or NUMBERS.get(i) for i in ids]


def shown_date(value: str) -> str:
    """A day number as YYYY-MM-DD, with HH:MM:SS behind it if there is a time, or that alone below one day."""
    n = float(value)
    seconds = round(n % 1 * 86400)
    day = datetime.date(1899, 12, 30) + datetime.timedelta(days=int(n) + seconds // 86400)
    time = f"{seconds % 86400 // 3600:02d}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}"
    return time if 0 <= n < 1 else day.isoformat() if not seconds % 86400 else f"{day.isoformat()} {time}"


def shown_general(value: str) -> str:
    """A number without a format: ten digits at most, as many as a cell shows."""
    n = float(value)
    if n == int(n) and abs(n) < 1e11:
        return str(int(n))
    mantissa, _, power = f"{n:.10g}".partition("e")
    return f"{mantissa}E{power[0]}{power[1:].lstrip('0').zfill(2)}" if power else mantissa


def shown_number(value: str, code: str) -> str:
    """A number as a format code shows it: its section by sign, digits, groups of thousands, scaling, percent, powers of ten
    and the text around them. Codes of another kind (fractions, text) show the number as one without a format."""
    n = Decimal(value)
    sections = re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', code)
    signed = n < 0 and len(sections) > 1
    section = sections[1] if signed else sections[2] if n == 0 and len(sections) > 2 else sections[0]
    kept: list[str] = []

    def keep(m):
        kept.append(m[1] if m[1] is not None else m[2] if m[2] is not None else "")
        return "\0"

    bare = re.sub(_ROOM, "", re.sub(_LITERAL, keep, section))
    digits = _DIGITS.search(bare)
    if digits is None or "/" in bare or "@" in bare or "General" in bare:
        if digits is None and "General" not in bare and "@" not in bare:  # text alone
            return "".join(kept.pop(0) if c == "\0" else c for c in bare)
        return shown_general(value)
    pattern, n = digits[0], abs(n) if signed else n
    whole, _, power = pattern.partition("E")
    n *= 100 ** bare.count("%")
    before, _, after = whole.partition(".")
    n /= 1000 ** (len(before) - len(before.rstrip(",")))
    least, most = len(re.sub("[^0]", "", before)), len(after)
    exponent = 0
    if power:
        exponent = n.adjusted() - max(least, 1) + 1 if n else 0
        n = n.scaleb(-exponent)
    n = n.quantize(Decimal(1).scaleb(-most), ROUND_HALF_UP)
    left, _, right = f"{abs(n):f}".partition(".")
    left = left.lstrip("0").zfill(least)
    fixed = len(after.rstrip("#?"))
    right = right[:fixed] + right[fixed:].rstrip("0")
    if "," in before.rstrip(","):
        left = re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", left)
    text = ("-" if n < 0 else "") + left + ("." + right if right or "." in whole and fixed else "")
    if power:
        mark = "-" if exponent < 0 else "+" if power[0] == "+" else ""
        text += f"E{mark}{str(abs(exponent)).zfill(power.count('0'))}"
    around = bare[: digits.start()] + "\1" + bare[digits.end() :]
    return "".join(kept.pop(0) if c == "\0" else text if c == "\1" else c for c in around).strip()


def _text(element: ET.Element) -> str:
    """The text of a string item: its own and that of its runs, without how it is read aloud."""
    parts = [t.text or "" for child in element for t in ([child] if child.tag == f"{_MAIN}t" else child.findall(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else [])]
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(parts))


def _elements(z: zipfile.ZipFile, name: str, parent: str, tag: str):
    """The elements of a tag in a part of the book, each freed once it is used."""
    with z.open(name) as f:
        above = None
        for event, element in ET.iterparse(f, ("start", "end")):
            if event == "start":
                above = element if element.tag == _MAIN + parent else above
            elif element.tag == _MAIN + tag:
                yield element
                above.clear()


class Strings:
    """The shared strings of a book, one after another in one buffer."""

    def __init__(self, z: zipfile.ZipFile):
        self.ends, self.buffer = array("Q", [0]), bytearray()
        if "xl/sharedStrings.xml" in z.namelist():
            for si in _elements(z, "xl/sharedStrings.xml", "sst", "si"):
                self.buffer += _text(si).encode("utf-8", "replace")
                self.ends.append(len(self.buffer))

    def __getitem__(self, i: int) -> str:
        return self.buffer[self.ends[i] : self.ends[i + 1]].decode()


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of a book's sheets."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    return [(s.get("name"), "xl/" + targets[s.get(_REL)].lstrip("/").removeprefix("xl/")) for s in book.iter(f"{_MAIN}sheet")]


def sheet_rows(content: bytes, sheet: str | None = None, formatted: bool = True):
    """Yields each row of a sheet (the first if none is named) as a list of strings, short rows as they are. formatted:
    numbers as the sheet shows them, dates as dates; else as they are stored."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = next((p for n, p in _sheets(z) if sheet is None or n == sheet), None)
        if part is None:
            raise ValueError(f"no sheet {sheet!r}")
        styles = _styles(z) if formatted else []
        shared = Strings(z)
        for row in _elements(z, part, "sheetData", "row"):
            cells: list[str] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                value, kind = c.find(f"{_MAIN}v"), c.get("t")
                if kind == "inlineStr":
                    own = c.find(f"{_MAIN}is")
                    cells[at] = _text(own) if own is not None else ""
                elif value is not None:
                    v = value.text or ""
                    if kind == "s":
                        v = shared[int(v)]
                    elif kind == "b":
                        v = {"1": "TRUE", "0": "FALSE"}.get(v, v)
                    elif v and formatted and kind in (None, "n"):
                        style = int(c.get("s") or 0)
                        code = styles[style] if style < len(styles) else None
                        v = shown_date(v) if code == "date" else shown_number(v, code) if code else shown_general(v)
                    cells[at] = v
            yield cells


def sheet_records(content: bytes, o: Options = Options(), sheet: str | None = None, formatted: bool = True):
    """(row_index, header, cells, raw, reason, detail) of each row with anything in it. A row that goes on behind the header
    is a failure, with all its cells in raw; a shorter one is filled up. Without a header columns are named by number."""
    header, index, skipped = None, 0, 0
    for cells in sheet_rows(content, sheet, formatted):
        if not any(c.strip() for c in cells):
            continue
        if skipped < o.skip_rows:
            skipped += 1
            continue
        if header is None:
            named = o.header is not False
            header = unique([c.strip(" ") for c in cells]) if named else [f"c{i}" for i in range(len(cells))]
            if named:
                continue
        if o.preview_rows is not None and index >= o.preview_rows:
            return
        filled = max(i + 1 for i, c in enumerate(cells) if c.strip())
        if filled > len(header):
            yield index, header, None, "\t".join(cells), MISALIGNED, f"expected {len(header)} cells, got {filled}"
        else:
            yield index, header, [c.strip(" ") for c in [*cells, *[""] * len(header)][: len(header)]], "\t".join(cells), None, None
        index += 1


ROWS = "source_file string, row_index long, header array<string>, cells array<string>, raw string, reason string, detail string"


def books(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the books at a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read(spark: SparkSession, path: str, sheet: str | None = None, formatted: bool = True, options: Options = Options()) -> DataFrame:
    """ROWS of the sheets at a path."""
    return parse(books(spark, path), sheet, formatted, options)


def parse(found: DataFrame, sheet: str | None = None, formatted: bool = True, options: Options = Options()) -> DataFrame:
    """ROWS of the sheets of books (path, content), as sheet_records has them. Rows leave a task 5,000 at a time and their
    XML is freed, so it holds a book's compressed bytes and its shared strings."""
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string())

    def batch(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in ROWS.split(", ")])

    def batches(it):
        for b in it:
            for p, content in zip(b.column("path"), b.column("content")):
                rows = []
                for index, header, cells, raw, reason, detail in sheet_records(content.as_py(), options, sheet, formatted):
                    rows.append((p.as_py(), index, header, cells, raw, reason, detail))
                    if len(rows) == 5000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return found.select("path", "content").mapInArrow(batches, ROWS)


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """source_file, place, sheet of all sheets of the books at a path."""

    def batches(it):
        for b in it:
            for p, content in zip(b.column("path"), b.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    names = [n for n, _ in _sheets(z)]
                yield pa.record_batch([pa.array([p.as_py()] * len(names)), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string())], names=["source_file", "place", "sheet"])

    return books(spark, path).mapInArrow(batches, "source_file string, place int, sheet string")
