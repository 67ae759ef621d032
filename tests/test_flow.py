"""The plan from files to packs on small mixed exports, sources of all kinds, routing, suggestions and checks."""

import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import hashing
from tallyloom.operators import audit, checks, core, flow, routing, suggest
from tallyloom.sources import delimited, detect, ingest, spreadsheet

LEDGER = "ledger_key string, fp string, batch string, last_run string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def export(spark, names, data):
    """A mixed export: columns by name, row_index in file order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "row_index long, " + ", ".join(f"`{n}` string" for n in names))


def ran(spark, df, **more):
    source = flow.Source("sample.xlsx", batch="b1", mainline=True, mixed=True, strategy=core.Strategy(family="customer_master_like"), **more)
    normalized = flow.normalize_files([(df, source)], "r1")
    return flow.merged(normalized, spark.createDataFrame([], LEDGER), "r1")


def counted(df, column):
    return dict(df.groupBy(column).count().collect())


def test_mixed_export_of_four_rows(spark, tmp_path):
    names = ["お客様ID", "契約者", "住所", "電話番号", "営業担当", "ｺｰﾙ履歴::日付", "ｺｰﾙ履歴::内容"]
    data = [("C1", "山田", "東京", "0311112222", "a", "2024-01-01", "x"), ("", "", "", "", "", "2024-01-02", "y"), ("", "鈴木", "", "", "b", "", ""), ("C2", "佐藤", "大阪", "0611112222", "c", "", "")]
    done, ledger = ran(spark, export(spark, names, data))
    assert counted(done, "_quarantine_reason") == {"": 3, "CHILD_CONTINUATION": 1}
    assert counted(done, "_final_disposition") == {"inserted": 2, "review": 1, "quarantine": 1}
    assert done.where("_final_disposition = 'review'").first()["_review_reason"] == "mixed_parent_child_ambiguous"
    assert counted(flow.pack_rows(done), "pack") == {"mainline": 2, "review": 1, "quarantine": 1} and ledger.count() == 2
    assert flow.write_packs(done, str(tmp_path / "packs")) == {"mainline": 2, "review": 1, "quarantine": 1}
    back = spark.read.option("header", True).csv(str(tmp_path / "packs" / "pack=mainline"))
    assert back.count() == 2 and back.where("customer_name = '山田' and phone = '0311112222'").count() == 1
    again, _ = flow.merged(done.drop("_ledger_key", "_final_disposition", "_final_disposition_reason").withColumns({"_final_disposition": F.lit(""), "_final_disposition_reason": F.lit("")}), ledger, "r2")
    assert counted(again, "_final_disposition") == {"duplicate": 2, "review": 1, "quarantine": 1}


def test_mixed_export_with_collisions(spark):
    names = ["お客様ID", "契約者", "会社名", "設置住所", "住所", "電話番号", "ｺｰﾙ履歴::日付", "ｺｰﾙ履歴::内容"]
    data = [
        ("C1", "山田", "", "", "東京", "0311112222", "", ""),
        ("C1", "山田", "", "", "東京", "0311112222", "d", ""),
        ("", "", "", "", "", "", "d", "c"),
        ("", "", "", "京都", "", "", "", ""),
        ("C3", "", "", "", "", "", "", ""),
        ("C4", "高橋", "甲", "", "神戸", "0781112222", "", ""),
        ("C5", "高橋", "甲", "", "奈良", "0781112222", "", ""),
    ]
    done, _ = ran(spark, export(spark, names, data))
    assert counted(done, "_final_disposition") == {"inserted": 1, "duplicate": 1, "review": 3, "quarantine": 2}
    assert counted(done.where("_final_disposition = 'review'"), "_review_reason") == {"mixed_parent_child_ambiguous": 1, "deterministic_collision": 2}
    counts = {(r.name, r.a, r.b): r.n for r in flow.reconciliation(done).collect()}
    assert counts["disposition", "review", ""] == 3 and counts["eligibility", "mainline_ready", ""] == 2 and counts["parent", "not_applicable", ""] == 0
    assert counts["parent_disposition", "parent_candidate", "duplicate"] == 1
    one = flow.row_flow(done).first()
    assert (one.input_rows, one.normalized_rows, one.quarantine_rows, one.child_continuations, one.ambiguous_parents) == (7, 5, 2, 1, 1)
    assert {r.value: r.n for r in flow.merge_summary(done).collect()} == {"inserted": 1, "updated": 0, "unchanged": 0, "duplicate": 1, "skipped_archive": 0, "skipped_review": 3}


def test_unknown_disposition_is_no_pack(spark):
    df = spark.createDataFrame([(1, "mainline_ready")], "row_index int, _final_disposition string").withColumns({c: F.lit("") for c in flow.PACK_ORDER if c != "_final_disposition"})
    with pytest.raises(Exception, match="no pack"):
        flow.pack_rows(df).collect()


def test_archive_rows_keep_out_of_the_ledger(spark):
    df = export(spark, ["customer_name", "phone"], [("山田", "0311112222"), ("", "")])
    old = flow.normalize_files([(df, flow.Source("old.csv"))], "r1")
    done, ledger = flow.merged(old, spark.createDataFrame([], LEDGER), "r1")
    assert counted(done, "_final_disposition") == {"archive_only": 1, "quarantine": 1} and ledger.count() == 0
    assert counted(done, "_quarantine_reason") == {"": 1, "ALL_COLUMNS_EMPTY": 1}


def test_runs_and_parts_on_disk(spark, tmp_path):
    df = spark.range(25).withColumnRenamed("id", "row_index")
    flow.write_run(str(tmp_path / "runs"), "r1", {"t": df})
    flow.write_run(str(tmp_path / "runs"), "r2", {"t": df.limit(0)})
    assert flow.read_run(spark, str(tmp_path / "runs"), "t", "r1").count() == 25 and flow.read_run(spark, str(tmp_path / "runs"), "t", "r2").columns == ["row_index"]
    manifest = flow.write_parts(df.repartition(4), str(tmp_path / "parts"), 10, ["row_index"])
    assert rows(manifest) == [(1, 10, 1, 10), (2, 10, 11, 20), (3, 5, 21, 25)]
    assert spark.read.option("header", True).csv(str(tmp_path / "parts")).groupBy("part").count().count() == 3
    page, total = flow.latest_runs(spark.createDataFrame([(f"r{i}",) for i in range(7)], "run_id string"), 2, 3)
    assert [r.run_id for r in page.collect()] == ["r4", "r3", "r2"] and total == 7


# --- sources ---------------------------------------------------------------------------------------------------------


def file(folder, name, content):
    path = folder / name
    path.write_bytes(content)
    return str(path)


def test_a_cell_of_a_megabyte_keeps_the_rows_behind_it(spark, tmp_path):
    big = "x" * 1_000_000
    for mode in (None, delimited.STRICT, delimited.RELAXED, delimited.LITERAL):
        found = delimited.read(spark, file(tmp_path, "big.csv", f"name,note\na,1\nb,{big}\nc,3\n".encode()), delimited.Options(quote_mode=mode))
        assert [(r.name, len(r.note)) for r in found.rows.orderBy("row_index").collect()] == [("a", 1), ("b", 1_000_000), ("c", 1)]
        assert found.failures.count() == 0


def test_files_with_other_headers_keep_their_names(spark, tmp_path):
    file(tmp_path, "a.csv", b"name,row_index\nx,7\n")
    file(tmp_path, "b.csv", b"phone,name\n01,y\n")
    found = delimited.read(spark, str(tmp_path / "*.csv"), delimited.Options(header=True))
    assert found.columns == ["name", "row_index_2", "phone"]
    assert rows(found.rows.select("name", "row_index_2", "phone")) == [("x", "7", ""), ("y", "", "01")]


def test_raw_records_warnings_and_diagnosis(spark, tmp_path):
    found = delimited.scan(spark, file(tmp_path, "w.csv", b'a,b\n "x ""1""\ny" , 2 \nhalf\xff of it,3\n1,2,3\n'), delimited.Options(encoding="utf8", header=True, quote_mode=delimited.RELAXED))
    got = {r.row_index: (r.raw, r.reason, r.detail) for r in found.collect()}
    assert got[0][0] == ' "x ""1""' and got[3][0] == "1,2,3" or got[2][1] == delimited.MISALIGNED
    one = delimited.diagnosis(found).first()
    assert one.rows_with_lost_characters == 1 and one.misaligned >= 1 and one.delimiter == ","
    assert delimited.raw_line_count(spark, file(tmp_path, "l.csv", b"a\n\nb\n")) == 3 and delimited.raw_line_count(spark, str(tmp_path / "l.csv"), blank=False) == 2


def test_header_verdicts():
    assert detect.header_verdict(["name", "phone"]) == (True, "high") and detect.header_verdict(["1", "2024-01-02", "a@b.jp"]) == (False, "high")
    assert detect.header_verdict(["1", "x"]) == (False, "medium") and detect.header_verdict(["1", "x", "y", "z"]) == (True, "low") and detect.header_verdict([""]) == (True, "low")
    assert detect.data_like("2024-01-02 later") is False and detect.data_like("see http://x") and detect.data_like("03-1234-5678") and not detect.data_like("+81 3 1234 5678")


def book(path, rows_xml, styles="", shared=""):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows_xml}</sheetData></worksheet>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")
    return str(path)


def test_dates_of_sheets_and_one_front(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="200" formatCode="yyyy&quot;y&quot;"/><numFmt numFmtId="201" formatCode="&quot;day&quot;0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="200"/><xf numFmtId="201"/><xf numFmtId="21"/></cellXfs>'
    line = lambda *cells: "<row>" + "".join(f'<c r="{chr(65 + i)}1" s="{s}"><v>{v}</v></c>' if s is not None else f'<c r="{chr(65 + i)}1" t="inlineStr"><is><t>{v}</t></is></c>' for i, (v, s) in enumerate(cells)) + "</row>"
    path = book(tmp_path / "d.xlsx", line(*[(n, None) for n in "abcde"]) + line((45292, 1), (45292.5, 2), (45292, 3), (0.25, 4), (45292, 0)), styles)
    got = spreadsheet.read(spark, path).first().cells
    assert got == ["2024-01-01", "2024-01-01 12:00:00", "day45292", "06:00:00", "45292"]
    assert spreadsheet.read(spark, path, formatted=False).first().cells[0] == "45292"
    csv = file(tmp_path, "c.csv", b"b,z\n1,2\n3\n")
    both = ingest.read_inputs(spark, [ingest.Input(path, key="sheet"), ingest.Input(csv, options=delimited.Options(header=True))])
    assert rows(both.rows.select("_source_key", "a", "b", "z")) == [("c.csv", "", "1", "2"), ("sheet", "2024-01-01", "2024-01-01 12:00:00", "")]
    assert both.failures.count() == 1 and {r.field: r.non_empty for r in ingest.preview(both).collect()}["b"] == 2
    with pytest.raises(ValueError):
        ingest.format_of("x.pdf")


# --- routing and suggestions -----------------------------------------------------------------------------------------


def test_names_of_files_and_hashes(spark, tmp_path):
    names = spark.createDataFrame([("in/Visit_1.CSV",), ("x.csv",)], "file string")
    assert [r[0] for r in names.select(routing.first_match(F.col("file"), [("visit_*.csv", "v"), ("*", "other")])).collect()] == ["v", "other"]
    assert routing.renamed(["a", "b"], {"a": "x"}) == ["x", "b"] and routing.combined_key(["b", "a"]) == routing.combined_key(["a", "b"])
    path = file(tmp_path, "h.bin", b"abc")
    import hashlib

    one = routing.file_hashes(spark, path).first()
    assert one.content_sha256 == hashlib.sha256(b"abc").hexdigest() and one.head_sha256 == hashlib.sha256(b"abc3").hexdigest()
    shapes = spark.createDataFrame([(["b", "a"], ["A ", "b"])], "x array<string>, y array<string>").select(routing.schema_key(F.col("x")), routing.review_schema_key(F.col("x")) == routing.review_schema_key(F.col("y")), routing.file_shape(F.col("x"), F.lit("utf8"), F.lit(True))).first()
    assert shapes[0] == hashing.schema_fingerprint(["a", "b"]) and shapes[1] and shapes[2] == hashlib.sha256(b"a,b|2|utf8|1").hexdigest()
    assert len(routing.file_batch_id("p", "h", "mainline", "c")) == 16


def test_families_by_shape_before_words(spark):
    files = spark.createDataFrame([(1, ["a", "b"], "s1"), (2, ["a", "b"], "s2"), (3, ["z"], "s3"), (4, [], "s4")], "n int, columns array<string>, shape string")
    known = spark.createDataFrame([("s1", "old", "confirmed")], "shape string, family string, certainty string")
    out = routing.family_of(files, known, {"a": ("f", 1.0), "b": ("f", 1.0), "z": ("g", 1.0)}, 1.5)
    assert rows(out.select("n", "family", "certainty")) == [(1, "old", "confirmed"), (2, "f", "low"), (3, "unknown", "unknown"), (4, "unknown", "unknown")]


def test_fast_path_and_candidates(spark):
    profile = spark.createDataFrame([(0, "phone", ["電話番号"]), (1, "notes", ["メモ", "備考"])], "position int, key string, names array<string>")
    auto = suggest.auto_reviews(profile, ["TEL"])
    assert rows(auto.select("position", "header", "proposed")) == [(0, "TEL", "phone"), (1, "メモ", "notes")]
    mapping = suggest.effective_mapping(auto.withColumn("run", F.lit("r")), profile)
    assert rows(mapping.select("position", "key", "status")) == [(0, "phone", "active"), (1, "notes", "active")]
    made = suggest.candidate_profile(mapping, "in/list_1.csv", has_header=False)
    assert made["files"] == ("list_1*", "*list_1*") and made["preview"] == [0, 1] and made["headerless_suitable"]
    files = spark.createDataFrame([("p", "high"), (None, "high"), ("p", "low")], "profile string, confidence string")
    assert [r.eligible for r in suggest.fast_path(files).collect()] == [True, False, False]
    reviews = spark.createDataFrame([("a", "unknown"), ("b", "accepted"), ("c", "unknown"), ("d", "unknown")], "name string, decision string")
    template = spark.createDataFrame([("a", "x", "high"), ("b", "y", "high"), ("c", None, "confirmed"), ("d", "z", "low")], "name string, field string, certainty string")
    assert rows(suggest.applied_template(reviews, template).select("name", "decision", "field")) == [("a", "accepted", "x"), ("b", "accepted", None), ("c", "unused", None), ("d", "unknown", None)]


# --- bounded lookups and checks --------------------------------------------------------------------------------------


def test_one_number_of_half_of_the_customers(spark):
    customers = spark.range(1, 401).select(F.col("id").alias("customer_id"), F.when(F.col("id") % 2 == 0, "03-1111-2222").otherwise(F.format_string("06%08d", "id")).alias("phone"))
    calls = spark.createDataFrame([(1, "0311112222"), (2, "0600000001"), (3, "03-1111-2222"), (4, None)], "row_index int, raw_phone string")
    got = {r.row_index: r for r in audit.match_phones(calls, customers, ["phone"]).collect()}
    assert got[1].match_type == "multi_match" and got[1].candidate_count == 200 and len(got[1].candidates.split(";")) == audit.CANDIDATES and got[1].candidates.startswith("2;4;6;")
    assert got[3].candidate_count == 200 and got[2].matched_customer_id == 1 and got[4].match_type == "empty"
    assert audit.phone_candidates(customers, ["phone"]).where("number = '0311112222'").count() == 200


def test_close_names_have_no_block_of_pairs(spark):
    names = [(i, n) for i, n in enumerate(["tanaka", "tanak", "tanakaa", "tnkaa", "suzuki", "suzuqi", "", "ab", "tanaka"])]
    df = spark.createDataFrame(names, "id int, name string")

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            p, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
        return d[-1]

    first = {}
    for i, n in names:
        first.setdefault(n, i)
    want = sorted((min(i, j), max(i, j), edits(a, b)) for a, i in first.items() for b, j in first.items() if i < j and edits(a, b) <= 2)
    assert rows(audit.close_names(df, "id", "name", F.lit("all"))) == want


def test_numbers_in_order_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = audit.numbered(df, ["v"]).orderBy("v").collect()
    assert [r.n for r in got] == list(range(1, 1001))
    assert audit.numbered(df.limit(0), ["v"]).count() == 0


def test_versions_and_their_log(spark, tmp_path):
    path, log = str(tmp_path / "t"), str(tmp_path / "log")
    checks.load(spark.range(3), path, "e", log, "v1")
    checks.load(spark.range(5), path, "e", log, "v2")
    with pytest.raises(ValueError):
        checks.load(spark.range(1), path, "e", log, "v1")
    assert checks.current(spark, path, "e", log).count() == 5
    checks.roll_back(spark, path, "e", log, "v1")
    assert checks.current(spark, path, "e", log).count() == 3
    assert rows(spark.read.parquet(log).select("action", "run", "row_count")) == [("load", "v1", 3), ("load", "v2", 5), ("rollback", "v1", 3)]


def test_cells_of_sheets_and_files_compare(spark):
    df = spark.createDataFrame([("2024/1/2", 45293.0, "8時間 25分 38秒"), ("x", 0.5, ""), (None, None, None)], "a string, n double, d string")
    got = df.select(audit.comparable(F.col("a"), "契約日"), audit.comparable(F.col("n").cast("string"), "契約日", F.col("n")), audit.comparable(F.col("d"), "時刻"), audit.comparable(F.col("n").cast("string"), "金額", F.col("n"))).collect()
    assert tuple(got[0])[:3] == ("2024-01-02", "2024-01-02", "08:25:38") and got[1][1] == "12:00:00" and got[0][3] == "45293.0"


def test_garbled_columns(spark):
    df = spark.createDataFrame([(i, "Ã©Ã¨Ã" if i < 2 else "plain", "fine") for i in range(10)], "row_index int, a string, b string")
    assert rows(audit.mojibake_verdict(df, ["a", "b"]).select("field", "garbled", "verdict")) == [("a", 2, "suspect"), ("b", 0, "ok")]


def test_runs_are_compared(spark):
    hints = spark.createDataFrame([("r1", "a", 5), ("r2", "a", 1), ("r2", "b", 9)], "run string, value string, n long")
    assert rows(flow.compare_runs(hints)) == [("a", 6, 2), ("b", 9, 1)]


def test_hot_keys_look_back_over_ranges(spark, monkeypatch):
    """A ledger key, a source and a null source with most of the rows, against the same without any range."""
    from tallyloom.operators import decisions, settle

    ids = spark.range(0, 900, 1, 5)
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))
    changes = ids.select(F.col("id").alias("row_index"), key.alias("ledger_key"), (F.col("id") % 7 * F.col("id") % 5).cast("string").alias("fp"))
    ledger = spark.createDataFrame([("hot", "0", "b1", "r0"), ("k1", "4", "b2", "r0"), ("gone", "1", "b1", "r0")], LEDGER)
    source = F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 3 == 1, "s").otherwise((F.col("id") % 30).cast("string"))
    runs = ids.select(F.col("id").alias("run_id"), source.alias("source"), (F.col("id") % 4).cast("string").alias("profile"), (F.col("id") % 211).alias("started_at"), F.when(F.col("id") % 5 == 0, "failed").otherwise("completed").alias("status"), (F.col("id") % 6).cast("string").alias("file_fp"), F.lit("x").alias("schema_fp"), F.lit(3).alias("column_count"))

    def all_of():
        out, after = core.merge(changes, ledger, "b2", "r1")
        return [rows(out.select("row_index", "disposition")), rows(after), rows(audit.latest_before(runs).select("run_id", "previous_run")), rows(decisions.pre_run_diff(runs).select("run_id", "previous_run", "change"))]

    plain = all_of()
    monkeypatch.setattr(settle, "LEAST", 40)
    monkeypatch.setattr(settle, "SHARE", 20)
    assert len(settle.parted(changes, ["ledger_key"], ["row_index"])) == 2 and len(settle.parted(runs, ["source"], ["started_at"])) == 2
    assert all_of() == plain


def test_close_texts_are_those_of_all_pairs(spark):
    import random

    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (5, 40, 90, 90)]
    texts = []
    for i in range(80):
        t = list(r.choice(base))
        for _ in range(r.randrange(0, 9)):
            t[r.randrange(len(t))] = r.choice("xyz")
        texts.append((i, "".join(t)))
    df = spark.createDataFrame(texts, "id int, t string")
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.id < b.id and a.t <> b.t and levenshtein(a.t, b.t) <= 10"))
    first = {t: i for i, t in reversed(texts)}
    want = {(min(first[x.at], first[x.bt]), max(first[x.at], first[x.bt])) for x in pairs.selectExpr("a.t as at", "b.t as bt").collect()}
    assert {(x.a, x.b) for x in audit.close_texts(df, "id", "t", F.lit(1)).collect()} == want and want


def test_long_names_and_texts_with_the_same_ends(spark):
    """Names beyond those that are compared by what is left of them, and blocks whose texts begin and end alike."""
    import random

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            p, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
        return d[-1]

    r = random.Random(8)
    base = ["".join(r.choice("ab山") for _ in range(n)) for n in (3, 30, 31, 33, 34, 60)]
    names = []
    for i in range(70):
        t = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(t))
            t[at : at + 1] = r.choice([[], ["x"], [t[at], "y"]])
            t = t or ["z"]
        names.append((i, "".join(t)))
    first = {}
    for i, n in names:
        first.setdefault(n, i)
    want = lambda most: sorted((min(i, j), max(i, j), edits(a, b)) for a, i in first.items() for b, j in first.items() if i < j and edits(a, b) <= most)
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(audit.close_names(spark.createDataFrame(names, "id int, name string"), "id", "name", F.lit("all"))) == want(2)
    for front, back in (("", ""), ("the same ", " of all"), ("aa", "aa")):
        df = spark.createDataFrame([(i, front + n + back) for i, n in names] + [(99, None)], "id int, t string")
        for most in (3, 10):
            assert got(audit.close_texts(df, "id", "t", F.lit(1), most)) == want(most)


def test_texts_that_differ_in_digits_are_all_pairs_in_cells(spark, monkeypatch):
    """Forms of many texts, also of forms that are close, and texts with more digits than edits; cells of few."""
    import random

    r = random.Random(5)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = {f(i) for i in range(40) for f in (lambda i: f"a note Customer#{i:04d} more", lambda i: f"a note Customers#{digits(3)} more", lambda i: f"quite another thing {i}", lambda i: digits(5), lambda i: f"no {digits(9)}", lambda i: "same 12" + digits(3))}
    rows = list(enumerate(sorted(texts) + sorted(texts)[:5])) + [(9_999, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.id < b.id and a.t <> b.t"))
    first = {t: i for i, t in reversed(rows)}
    for most, cell in ((3, 7), (6, 7), (10, 2_000)):
        monkeypatch.setattr(audit, "CELL", cell)
        found = pairs.withColumn("d", F.expr("levenshtein(a.t, b.t)")).where(F.col("d") <= most).selectExpr("a.t as x", "b.t as y", "d").collect()
        want = sorted({(min(first[p.x], first[p.y]), max(first[p.x], first[p.y]), p.d) for p in found})
        assert sorted(map(tuple, audit.close_texts(df, "id", "t", F.lit(1), most).collect())) == want


def test_calls_without_a_number_and_on_one_number_spread_out(spark):
    """Half of the calls have no number, half of the rest one and the same: no task of the join gets twice as many as others."""
    from pyspark.sql import functions as F

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in settings}
    number = F.when(F.col("id") % 2 == 0, "").when(F.col("id") % 4 == 1, "0312345678").otherwise(F.concat(F.lit("03"), F.lpad((F.col("id") % 997).cast("string"), 8, "0")))
    calls = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("row_index"), number.alias("raw_phone"), F.sha2(F.col("id").cast("string"), 512).alias("note"))
    customers = spark.range(500).select(F.col("id").alias("customer_id"), F.when(F.col("id") == 0, "0312345678").otherwise(F.concat(F.lit("03"), F.lpad(F.col("id").cast("string"), 8, "0"))).alias("phone"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = audit.match_phones(calls, customers, ["phone"])
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect())
        kinds = counted(out, "match_type")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sum(sizes) == 40_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert kinds["empty"] == 20_000 and kinds["exact"] >= 10_000


def test_close_names_send_nothing_through_the_driver(spark):
    names = spark.range(2_000).selectExpr("id", "concat('Customer#', lpad(id, 9, '0')) as name", "cast(id div 10 as string) as block")
    for df in (audit.close_names(names, "id", "name", F.col("block")), audit.close_texts(names, "id", "name", F.col("block"))):
        joins = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())
        assert all(re.fullmatch(r"block#\d+", j) for j in joins)  # what a block's texts share, a row a block
    assert audit.close_names(names, "id", "name", F.col("block")).count() == 200 * 45


def test_files_that_are_alike_are_compared_once(spark):
    shape = ["'list' as stem", "array('a', 'b') as columns", "'s' as schema", "'utf8' as encoding", "true as has_header"]
    other = [x.replace("'a'", "'z'").replace("'s'", "'t'") for x in shape]
    files = spark.range(50).selectExpr("id as file_id", *shape).unionByName(spark.range(99, 100).selectExpr("id as file_id", *other))
    templates = spark.range(5).selectExpr("id as template_id", "array('list') as stems", "array('a', 'b') as columns", "if(id = 2, 's', 'o') as schema", "'utf8' as encoding", "true as has_header")
    found = suggest.template_matches(files, templates, k=2)
    got = rows(found.select("file_id", "template_id", "place", "score"))
    assert [r for r in got if r[0] != 99] == sorted([(i, t, p, s) for i in range(50) for t, p, s in ((2, 1, 1.0), (0, 2, 0.5))], key=repr)
    assert [r[:3] for r in got if r[0] == 99] == [(99, 0, 1), (99, 1, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Generate", 1)[1]


def test_packs_are_written_in_the_ranges_they_are_numbered_in(spark, tmp_path):
    done = spark.range(200).selectExpr("id as row_index", "if(id % 3 = 0, 'review', 'inserted') as _final_disposition", "'x' as _final_disposition_reason", "'p' as _parent", "'f' as _source_file", "'k' as _source_key", "cast(id % 7 as string) as _source_record_key", "'s' as _structural_fingerprint_full")
    thin = flow.pack_rows(done, ["row_index"])
    assert thin.columns == ["pack", *flow.PACK_ORDER, "row_index", "place"] and counted(thin, "pack") == {"mainline": 133, "review": 67}
    assert rows(thin.select("row_index", "pack", "place")) == rows(flow.pack_rows(done).select("row_index", "pack", "place"))
    flow.write_packs(done, str(tmp_path / "packs"))
    for pack, n in (("mainline", 133), ("review", 67)):
        files = sorted((tmp_path / "packs" / f"pack={pack}").glob("part-*.csv"))
        cells = [line.split(",") for f in files for line in f.read_text().splitlines()]
        at = cells[0].index("place")
        assert [int(c[at]) for c in cells if c[at] != "place"] == list(range(1, n + 1))
