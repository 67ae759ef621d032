"""Readers against plain programs: delimited files in splits of any size, sheets."""

import csv
import hashlib
import io
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql.datasource import CaseInsensitiveDict, EqualTo, GreaterThan, IsNotNull
from pyspark.sql.types import StringType, StructField, StructType

from tallyloom.operators import routing
from tallyloom.sources import datasource, delimited, detect, ingest, ranges, spreadsheet
from tallyloom.sources.delimited import LITERAL, RELAXED, STRICT, Options

# --- delimited files -------------------------------------------------------------------------------------------------


def plain(content, o):
    """(row_index, cells, raw, reason) of a file's records, read in one go."""
    content = content.removeprefix(b"\xef\xbb\xbf")
    encoding = o.encoding or detect.encoding(content[: detect.SAMPLE])
    text = content.decode(encoding, "replace")
    delimiter = o.delimiter or detect.delimiter(text[: 4 * detect.SAMPLE])

    def records(mode):
        taken = []

        def lines():
            for line in io.StringIO(text, newline=""):
                taken.append(line)
                yield line

        kind = {"quoting": csv.QUOTE_NONE} if mode == LITERAL else {"strict": mode == STRICT}
        out = []
        try:
            for cells in csv.reader(lines(), delimiter=delimiter, **kind):
                raw = "".join(taken).removesuffix("\n").removesuffix("\r")
                taken.clear()
                cells = [c.strip() for c in cells]
                if any(cells) or len(cells) > 1:
                    out.append((cells, raw))
        except csv.Error:
            return out, "".join(taken).removesuffix("\n").removesuffix("\r")
        return out, None

    mode = o.quote_mode or (STRICT if records(STRICT)[1] is None else RELAXED)
    found, fault = records(mode)
    found = found[o.skip_rows :]
    named = bool(found) and (o.header if o.header is not None else detect.has_header([c for c, _ in found[:5]]))
    width = len(found[0][0]) if found else 0
    out = []
    for cells, raw in found[named:]:
        lost, text_ = "".join(cells).count("�"), "".join(cells)
        reason = delimited.MISALIGNED if len(cells) != width else delimited.UNDECODABLE if lost and lost / len(text_) >= 0.5 else None
        out.append((len(out), None if reason else cells, raw, reason))
    if fault is not None:
        out.append((len(out), None, fault, delimited.BROKEN))
    return out if o.preview_rows is None else out[: o.preview_rows], mode


def made(r, kind):
    """A file of odd records: quoted cells with line ends, quotes and blanks, long ones, faults of quoting."""
    cell = lambda: r.choice(["", "a", " b ", "山田", "x" * r.randrange(40), '"q"', '"a\nb"', '"\n\n"', '"a, b"', '"say ""x"""', '"' + "long\n" * r.randrange(12) + '"', "1.5", "　"])
    bad = lambda: r.choice(['"x"y', 'a"b', '"a""', '"un\r\nclosed"z', "'"])
    end = {"crlf": "\r\n", "cr": "\r"}.get(kind, "\n")
    lines = ["name,note,n"]
    for _ in range(r.randrange(0, 40)):
        cells = [cell() for _ in range(r.choice([1, 3, 3, 3, 3, 4]))]
        if kind == "bad" and r.random() < 0.2:
            cells[0] = bad()
        lines.append(",".join(cells))
    if kind == "open":
        lines.insert(r.randrange(len(lines) + 1), 'z,"never closed,1')
    text = end.join(lines) + r.choice(["", end, end * 3])
    return ("﻿" if kind == "bom" else "") + text


@pytest.mark.parametrize("size", ["40", "1000000"])
def test_records_are_those_of_one_pass_however_files_are_split(spark, tmp_path, size):
    r = random.Random(int(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for mode in (None, STRICT, RELAXED, LITERAL):
            o = Options(header=True, quote_mode=mode, delimiter=",", encoding="utf-8") if mode else Options(header=True)
            folder, files = tmp_path / f"{mode}", {}
            folder.mkdir()
            for i, kind in enumerate(["good", "crlf", "bom", "bad", "bad", "open", "cr"] * 2):
                files[f"f{i}.csv"] = made(r, kind).encode("cp932" if i % 7 == 1 and mode is None else "utf-8", "replace")
                (folder / f"f{i}.csv").write_bytes(files[f"f{i}.csv"])
            got = {}
            for x in ranges.scan(spark, str(folder), o).collect():
                got.setdefault(x.source_file.rsplit("/", 1)[-1], []).append(((x.row_index, x.cells, x.raw, x.reason), x.quote_mode))
            for name, content in files.items():
                want, used = plain(content, o)
                found = sorted(got.get(name, []), key=lambda x: x[0][0])
                assert [x for x, _ in found] == want, (name, content)
                assert {m for _, m in found} <= {used}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_skipped_previewed_and_nameless_files(spark, tmp_path):
    content = b'skip,1,"\n"\n,\n' + b"".join(b'r%d,"a\nb",2024-01-%02d\n' % (i, i % 28 + 1) for i in range(60))
    (tmp_path / "a.csv").write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        for o in (Options(skip_rows=2), Options(skip_rows=1, header=True), Options(header=False), Options(skip_rows=2, header=False, preview_rows=7), Options(delimiter=";")):
            got = [(x.row_index, x.cells, x.raw, x.reason) for x in ranges.scan(spark, str(tmp_path / "a.csv"), o).orderBy("row_index").collect()]
            assert got == plain(content, o)[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_names_of_files_come_as_they_are(spark, tmp_path):
    (tmp_path / "顧客 +100%.csv").write_bytes(b"a,b\n1,2\n")
    found = delimited.read(spark, str(tmp_path / "*.csv"), Options(header=True)).rows.first()
    assert found["_source_file"].endswith("/顧客 +100%.csv") and found.a == "1"


def test_effects_compose():
    """Where a text ends is where its second half ends from where its first half does."""
    r = random.Random(2)
    for _ in range(300):
        lines = made(r, r.choice(["good", "bad", "open"])).splitlines(keepends=True)
        cut = r.randrange(len(lines) + 1)
        a, b = "".join(lines[:cut]), "".join(lines[cut:])
        for mode in (STRICT, RELAXED):
            for begins in (ranges.OUTSIDE, ranges.INSIDE):
                assert ranges.effect(a + b, ",", mode, begins) == ranges.effect(b, ",", mode, ranges.effect(a, ",", mode, begins))


# --- sheets ----------------------------------------------------------------------------------------------------------

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, rows, strings=(), formats=()):
    """A book with a sheet of rows of cells in XML, shared strings in XML, and a cell style for each format code."""
    styles = "".join(f'<numFmt numFmtId="{170 + i}" formatCode="{c}"/>' for i, c in enumerate(formats))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="r1"/><sheet name="two" sheetId="2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(strings)}</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {NS}><numFmts>{styles}</numFmts><cellXfs>{''.join(f'<xf numFmtId=\"{170 + i}\"/>' for i in range(len(formats)))}</cellXfs></styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{''.join('<row>' + ''.join(r) + '</row>' for r in rows)}</sheetData></worksheet>")
    return str(path)


def test_readings_and_rich_text(spark, tmp_path):
    strings = ["<si><t>東京</t><rPh sb='0' eb='2'><t>トウキョウ</t></rPh><phoneticPr fontId='1'/></si>", "<si><r><t>山</t></r><r><rPr/><t>田</t></r><rPh sb='0' eb='2'><t>ヤマダ</t></rPh></si>", "<si><t>a_x000A_b</t></si>"]
    inline = "<c t='inlineStr'><is><t>大阪</t><rPh sb='0' eb='2'><t>オオサカ</t></rPh></is></c>"
    path = book(tmp_path / "r.xlsx", [["<c t='s'><v>0</v></c>", "<c t='s'><v>1</v></c>"], [inline, "<c t='s'><v>2</v></c>"]], strings)
    found = ingest.read_source(spark, path)
    assert found.columns == ["東京", "山田"] and [tuple(r)[2:] for r in found.rows.collect()] == [("大阪", "a\nb")]
    assert [(r.place, r.sheet) for r in spreadsheet.sheet_names(spark, path).collect()] == [(0, "one"), (1, "two")]


def test_cells_behind_the_header_are_reported(spark, tmp_path):
    cell = lambda v: f"<c t='inlineStr'><is><t>{v}</t></is></c>"
    path = book(tmp_path / "w.xlsx", [[cell("a"), cell("b")], [cell(1), cell(2), cell("lost")], [cell(3)], [cell(4), cell(5), cell(" ")]])
    found = ingest.read_source(spark, path)
    assert sorted(tuple(r)[2:] for r in found.rows.collect()) == [("3", ""), ("4", "5")]
    assert [(r.row_index, r.reason, r.raw, r.detail) for r in found.failures.collect()] == [(0, delimited.MISALIGNED, "1\t2\tlost", "expected 2 cells, got 3")]
    nameless = ingest.read_source(spark, path, Options(header=False, skip_rows=1, preview_rows=2))
    assert nameless.columns == ["c0", "c1", "c2"] and nameless.rows.count() == 2 and nameless.failures.count() == 0


@pytest.mark.parametrize(
    "value, code, shown",
    [("1234.5", "#,##0.00", "1,234.50"), ("-1234.5", "#,##0;(#,##0)", "(1,235)"), ("0.256", "0.0%", "25.6%"), ("0", "0.00;-0.00;none", "none"), ("12345678", "#,##0,", "12,346"), ("7", "000", "007")]
    + [("1234567", "0.00E+00", "1.23E+06"), ("5", '0"円"', "5円"), ("0.5", "#.##", ".5"), ("2.5", "0.0##", "2.5"), ("-3", "0", "-3"), ("1000", "\\¥#,##0", "¥1,000"), ("0.1", "General", "0.1"), ("1.005", "0.00", "1.01"), ("-0.001", "0.00", "0.00"), ("8", "[Red]0_ ", "8")],
)
def test_numbers_as_shown(value, code, shown):
    assert spreadsheet.shown_number(value, code) == shown


def test_numbers_without_a_format(spark, tmp_path):
    assert [spreadsheet.shown_general(v) for v in ("45292", "0.30000000000000004", "-2.50", "1e21", "0.00001234", "12345678901")] == ["45292", "0.3", "-2.5", "1E+21", "1.234E-05", "12345678901"]
    path = book(tmp_path / "n.xlsx", [[f"<c s='{i}'><v>{v}</v></c>" for i, v in enumerate(("45292.5", "1234.5", "3"))]], formats=["yyyy/mm/dd", "#,##0.0", "General"])
    assert spreadsheet.read(spark, path, options=Options(header=False)).first().cells == ["2024-01-01 12:00:00", "1,234.5", "3"]


def test_a_long_sheet_stays_small(tmp_path):
    """Rows are freed as they are read: memory doesn't grow with the sheet."""
    path = book(tmp_path / "l.xlsx", (["<c><v>1</v></c>", f"<c t='inlineStr'><is><t>row {i}</t></is></c>"] for i in range(60_000)))
    content = open(path, "rb").read()
    tracemalloc.start()
    n = sum(1 for _ in spreadsheet.sheet_rows(content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 8_000_000


# --- hashes ----------------------------------------------------------------------------------------------------------


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    size = (1 << 31) + 10
    with open(tmp_path / "sparse 100%.bin", "wb") as f:
        f.write(b"head")
        f.truncate(size)
    zeros, whole = bytes(1 << 24), hashlib.sha256(b"head" + bytes((1 << 24) - 4))
    for _ in range((1 << 7) - 1):
        whole.update(zeros)
    whole.update(bytes(10))
    one = routing.file_hashes(spark, str(tmp_path)).first()
    assert (one.size, one.content_sha256) == (size, whole.hexdigest())
    assert one.head_sha256 == hashlib.sha256(b"head" + bytes(512 * 1024 - 4) + str(size).encode()).hexdigest()
    quick = routing.file_hashes(spark, str(tmp_path), whole=False).first()
    assert quick.content_sha256 is None and quick.head_sha256 == one.head_sha256


# --- data source -----------------------------------------------------------------------------------------------------


def cells_of(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_the_data_source_reads_as_the_reader_does(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes('﻿name,note,n\n山田,"x, ""y""\nz",1\nshort,2\n\n b , c ,3\n'.encode())
    (tmp_path / "in" / "b b.csv").write_bytes("n;name\n4;鈴木\n5;佐藤\n".encode("cp932"))
    path = str(tmp_path / "in")
    want = ingest.read_source(spark, path + "/*.csv", Options(header=True))
    found = spark.read.format("tallyloom").option("header", "true").load(path)
    assert cells_of(found, ["name", "note", "n"]) == cells_of(want.rows, ["name", "note", "n"])
    bad = spark.read.format("tallyloom").options(header="true", rows="failures").load(path)
    assert cells_of(bad, ["raw", "reason", "detail"]) == cells_of(want.failures, ["raw", "reason", "detail"]) and bad.count() == 1
    some = spark.read.format("tallyloom").schema("n string, name string").option("header", "true").load(path)
    assert cells_of(some.where("name = '鈴木' and n in ('4', '9')"), ["n", "name"]) == [("4", "鈴木")]
    assert cells_of(some.where("name like '佐%' or n = '1'"), ["n"]) == [("1",), ("5",)] and some.count() == 4
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        filtered = lambda: spark.read.format("tallyloom").options(header="true", pushdown="true").load(path)
        assert cells_of(filtered().where("name = '鈴木' and n in ('4', '9')"), ["n", "name"]) == [("4", "鈴木")]
        assert cells_of(filtered().where("name like '佐%'"), ["n"]) == [("5",)] and filtered().where("name = 'no'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_reach_the_data_source():
    schema = StructType([StructField(n, StringType()) for n in ("a", "b", "_source_file")])
    reader = datasource.FilteringReader(schema, CaseInsensitiveDict({"path": "x"}))
    left = list(reader.pushFilters([EqualTo(("a",), "1"), EqualTo(("_source_file",), "f"), IsNotNull(("b",)), GreaterThan(("a",), "0")]))
    assert [type(f) for f in left] == [EqualTo, GreaterThan] and len(reader.tests) == 2


@pytest.mark.parametrize("wide", [7, 64, 10**6])
def test_ranges_of_a_literal_file(spark, tmp_path, wide):
    datasource.register(spark)
    text = 'a,b\r\n' + "".join(f'{i},"x{i}\r\n' for i in range(60)) + "\n\nlast,é"
    (tmp_path / "l.csv").write_text(text, newline="")
    found = spark.read.format("tallyloom").options(header="true", quoteMode="literal", rangeBytes=str(wide)).load(str(tmp_path / "l.csv"))
    want = delimited.read(spark, str(tmp_path / "l.csv"), Options(header=True, quote_mode=LITERAL)).rows.orderBy("row_index").collect()
    assert [(r.a, r.b) for r in found.orderBy("_at", "_n").collect()] == [(r.a, r.b) for r in want] and len(want) == 61
    assert found.rdd.getNumPartitions() == -(-len(text.encode()) // wide)


def test_a_stream_of_files_goes_on_from_its_offsets(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in").mkdir()

    def run(name, content):
        (tmp_path / "in" / name).write_text(content)
        stream = spark.readStream.format("tallyloom").schema("a string, b string").option("header", "true").load(str(tmp_path / "in"))
        assert stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination(120)
        return cells_of(spark.read.parquet(str(tmp_path / "out")), ["a", "b"])

    assert run("z.csv", 'a,b\n1,"x\ny"\n') == [("1", "x\ny")]
    assert run("a.csv", "b,a\n2,3\n") == [("1", "x\ny"), ("3", "2")]
