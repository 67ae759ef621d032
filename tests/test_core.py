"""Operators as a whole: invariance of keys, merging against a sequential run, sources and the stream."""

import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import audit, core, decisions
from tallyloom.operators.settle import spread
from tallyloom.plans.views import CONTACT, view
from tallyloom.sources import delimited, detect, spreadsheet
from tallyloom.streaming.ledger import Ledger, merge_stream, query_id

PEOPLE = [(0, "山田", "ACME", "0312345678", "a@b.jp", "東京", "x"), (1, "鈴木", "", "", "", "大阪", "y"), (2, "", "", "", "", "", "")]
COLUMNS = ["row_index", "customer_name", "company_name", "phone", "email", "address", "internal_note"]
MASTER = core.Strategy(family="customer_master_like")
KEYS = ["_source_record_key", "_entity_match_key", "_structural_fingerprint", "_merge_eligibility", "_review_reason"]


def keys(df):
    return {r[0]: tuple(r)[1:] for r in core.identify(df, MASTER).select("row_index", *KEYS).collect()}


def test_keys_do_not_depend_on_order_or_other_fields(spark):
    base = spark.createDataFrame(PEOPLE, COLUMNS)
    want = keys(base)
    assert keys(base.orderBy(F.desc("row_index"))) == want
    assert keys(base.select("row_index", *reversed(COLUMNS[1:]))) == want
    noted = keys(base.withColumn("internal_note", F.lit("other")))
    assert {i: noted[i][:3] for i in (0, 1)} == {i: want[i][:3] for i in (0, 1)}
    assert want[2][3:] == ("review", "fallback_key") and want[0][3:] == ("mainline_ready", "")


def test_colliding_keys_go_to_review(spark):
    rows = [(0, "山田", "A", "0312345678", "a@b.jp", "x", ""), (1, "山田", "A", "0312345678", "c@d.jp", "x", ""), (2, "林", "B", "0399999999", "", "", "")]
    out = core.demote_collisions(core.identify(spark.createDataFrame(rows, COLUMNS), MASTER))
    assert {r.row_index: r._review_reason for r in out.collect()} == {0: "deterministic_collision", 1: "deterministic_collision", 2: ""}


@pytest.mark.parametrize(
    "row, reason",
    [
        (("2024-01-01", "", ""), "activity_timestamp_insufficient"),
        (("2024-01-01", "op", ""), ""),
        (("2024-01-01", "", "done"), ""),
        (("", "op", ""), "activity_timestamp_insufficient"),
    ],
)
def test_activities_need_a_date_and_an_actor(spark, row, reason):
    df = spark.createDataFrame([(0, "山田", *row)], "row_index long, customer_name string, activity_date string, operator string, result_code string")
    assert core.identify(df, core.Strategy(family="call_activity")).first()._review_reason == reason


def test_parents_and_packs(spark):
    rows = [(0, "1", "a", "", "", "h"), (1, "", "", "", "", "h"), (2, "", "b", "", "", ""), (3, "", "", "", "", ""), (4, "", "c", "", "03", "")]
    df = spark.createDataFrame(rows, "row_index long, `お客様ID` string, `契約者` string, `会社名` string, `電話番号` string, `ｺｰﾙ履歴::内容` string")
    out = core.parent_extraction(df, ["ｺｰﾙ履歴::内容"])
    assert [r._parent for r in out.orderBy("row_index").collect()] == ["parent_candidate", "child_continuation", "ambiguous_parent", "ambiguous_parent", "parent_candidate"]
    good = spark.createDataFrame([("inserted",), ("review",), ("quarantine",), ("archive_only",)], "disposition string")
    assert Counter(r.pack for r in core.hand_off(good).collect()) == {"mainline": 2, "review": 1, "quarantine": 1}
    with pytest.raises(Exception, match="no pack for disposition"):
        core.hand_off(spark.createDataFrame([("lost",)], "disposition string")).collect()


def one_by_one(rows, ledger, batch):
    state, out = dict(ledger), {}
    for i, key, fp in sorted(rows):
        old = state.get(key)
        if old is None:
            out[i], state[key] = "inserted", (fp, batch)
        elif old[0] != fp:
            out[i], state[key] = "updated", (fp, batch)
        else:
            out[i] = "duplicate" if old[1] == batch else "unchanged"
    return out, state


def test_merge_is_the_sequential_merge(spark):
    r = random.Random(4)
    ledger = {f"k{i}": (r.choice("ab"), r.choice(["b0", "b1"])) for i in range(15)}
    rows = [(i, f"k{r.randrange(30)}", r.choice("abc")) for i in range(300)]
    frame = spark.createDataFrame(rows, "row_index long, ledger_key string, fp string").repartition(5)
    held = spark.createDataFrame([(k, f, b, "r0") for k, (f, b) in ledger.items()], "ledger_key string, fp string, batch string, last_run string")
    out, after = core.merge(frame, held, "b1", "r1")
    want, state = one_by_one(rows, ledger, "b1")
    assert {x.row_index: x.disposition for x in out.collect()} == want
    assert {x.ledger_key: (x.fp, x.batch) for x in after.collect()} == state
    again, _ = core.merge(frame.groupBy("ledger_key").agg(F.max("row_index").alias("row_index"), F.max_by("fp", "row_index").alias("fp")), after, "b1", "r2")
    assert {x.disposition for x in again.collect()} <= {"duplicate", "unchanged"}


def test_fill_forward_across_stretches(spark):
    df = spark.createDataFrame([(i, "c" + str(i) if i % 7 == 3 else "", str(i)) for i in range(40)], "row_index long, customer_id string, phone string")
    got = {r.row_index: (r._filled_customer_id, r._filled_phone) for r in core.fill_forward(df, "customer_id", ["phone"], bucket=5).collect()}
    last = None
    for i in range(40):
        last = i if i % 7 == 3 else last
        assert got[i] == ((f"c{last}", str(last)) if last is not None else (None, None))


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    assert [r.n for r in audit.numbered(df, ["x"]).orderBy("x").collect()] == list(range(1, 1001))


def test_remembered_decisions(spark):
    memory = spark.createDataFrame([(1, "c", "global", "column_ignore", "high", False), (2, "c", "f", "column_canonical", "confirmed", False), (3, "d", "f", "column_canonical", "low", False), (4, "e", "g", "column_canonical", "high", False)], "id long, context string, family string, kind string, certainty string, deleted boolean")
    asks = spark.createDataFrame([(1, "c", "f"), (2, "d", "f"), (3, "e", "f"), (4, "e", "g")], "ask_id long, context string, family string")
    assert {r.ask_id: (r.decision, r.kind) for r in decisions.auto_apply(asks, memory).collect()} == {1: (1, "column_ignore"), 2: (None, "unresolved"), 3: (None, "unresolved"), 4: (4, "column_canonical")}
    changed = decisions.upsert(memory, memory.where("id = 1").withColumn("kind", F.lit("column_canonical")), ["context", "family"])
    assert changed.count() == 4 and changed.where("id = 1").first().kind == "column_canonical"
    assert [decisions.eligibility(n, 10) for n in (0, 2, 3)] == ["full", "partial", "review_required"]


def test_rows_of_several_files_share_numbers(spark):
    one = spark.createDataFrame([(0, "0312345678"), (1, "0312345679"), (2, "12")], "row_index long, phone string")
    both = one.withColumn("_source_file", F.lit("a")).unionByName(one.withColumn("_source_file", F.lit("b")))
    groups = sorted((r.match_key, r.first_file, r.first_row, r.size) for r in core.duplicate_groups(both).where("match_type = 'phone'").collect())
    assert [g for g in groups if g[0] == "0312345679"] == [("0312345679", "a", 1, 2)]
    members = core.duplicate_members(both).where("match_type = 'phone' and match_key = '0312345679'")
    assert sorted((r._source_file, r.row_index) for r in members.collect()) == [("a", 1), ("b", 1)]
    assert sorted((r._source_file, r.row_index) for r in core.anomalies(both).collect()) == [("a", 2), ("b", 2)]
    assert core.duplicate_groups(one).columns == ["match_type", "match_key", "first_row", "size"]
    staged = audit.staging_calls(both.withColumns({"matched_customer_id": F.lit(1), "candidate_count": F.lit(1), "match_type": F.lit("exact")}), "f", {"call_date": "d"}, matched=True)
    assert staged.count() == 6


# --- sources ---------------------------------------------------------------------------------------------------------


def file(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def rows(found):
    return [tuple(r[c] for c in found.columns) for r in found.rows.orderBy("row_index").collect()]


def test_csv(spark, tmp_path):
    found = delimited.read(spark, file(tmp_path, "a.csv", 'name,phone,email\n a ,01,"x, y"\n\nb,02\nc,03,z\n'.encode()))
    assert found.columns == ["name", "phone", "email"]
    assert rows(found) == [("a", "01", "x, y"), ("c", "03", "z")]
    bad = found.failures.collect()
    assert [(r.row_index, r.reason, r.preview) for r in bad] == [(1, delimited.MISALIGNED, "b,02")]


def test_encodings_delimiters_and_headers(spark, tmp_path):
    table = "名前\t電話\n山田\t０３\n鈴木\tｱ\n"
    assert rows(delimited.read(spark, file(tmp_path, "s.tsv", table.encode("cp932")))) == [("山田", "０３"), ("鈴木", "ｱ")]
    bom = delimited.read(spark, file(tmp_path, "b.csv", b"\xef\xbb\xbf" + table.replace("\t", ";").encode()))
    assert bom.columns == ["名前", "電話"]
    none = delimited.read(spark, file(tmp_path, "n.csv", b"a,2024-01-01,0312345678\nb,2024-01-02,0312345679\n"))
    assert none.columns == ["c0", "c1", "c2"] and len(rows(none)) == 2
    twice = delimited.read(spark, file(tmp_path, "t.csv", b"a,a\nx,y\n"))
    assert twice.columns == ["a", "a_2"]
    empty = delimited.read(spark, file(tmp_path, "e.csv", b""))
    assert empty.columns == [] and empty.failures.count() == 0


def test_quotes_fall_back(spark, tmp_path):
    path = file(tmp_path, "q.csv", b'a,b\n"x"y,1\nz,2\n')
    found = delimited.scan(spark, path)
    assert {r.quote_mode for r in found.collect()} == {delimited.RELAXED}
    literal = delimited.read(spark, path, delimited.Options(quote_mode=delimited.LITERAL))
    assert rows(literal)[0] == ('"x"y', "1")
    strict = delimited.scan(spark, path, delimited.Options(quote_mode=delimited.STRICT))
    assert [r.reason for r in strict.where("reason is not null").collect()] == [delimited.BROKEN]


def test_options_and_undecodable_rows(spark, tmp_path):
    path = file(tmp_path, "o.csv", b"skip me\na,b\n1,2\n3,4\n5,6\n")
    found = delimited.read(spark, path, delimited.Options(skip_rows=1, header=True, delimiter=",", preview_rows=2))
    assert rows(found) == [("1", "2"), ("3", "4")]
    broken = delimited.read(spark, file(tmp_path, "u.csv", b"a,b\n\xff\xff,\xff\nok,1\n"), delimited.Options(encoding="utf8", header=True))
    assert rows(broken) == [("ok", "1")] and broken.failures.first().reason == delimited.UNDECODABLE


def test_detection():
    assert detect.encoding("山田".encode()[:5]) == "utf8" and detect.encoding("山田".encode("cp932")) == "cp932"
    assert detect.delimiter("a;b\nc;d\n") == ";" and detect.delimiter("abc") == ","
    assert detect.header_likelihood(["name", "phone"]) == "high" and detect.header_likelihood(["1", "2"]) == "none"


def test_written_csv_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b,c", "x")], "n string, v string")
    delimited.write(df, str(tmp_path / "out"))
    delimited.write(df.limit(0), str(tmp_path / "none"))
    found = delimited.read(spark, str(tmp_path / "out" / "*.csv"), delimited.Options(header=True))
    assert sorted(r.n for r in found.rows.collect()) == ["a", "b,c"]


def test_xlsx(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>名前</t></si><si><t>電話</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>山田</t></is></c><c r="C2"><v>12</v></c></row><row/><row><c r="A3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    got = spreadsheet.read(spark, str(path)).orderBy("row_index").collect()
    assert got[0].header == ["名前", "", "電話"] and [r.cells for r in got] == [["山田", "", "12"], ["TRUE", "", ""]]


# --- stream ----------------------------------------------------------------------------------------------------------


def test_stream_merges_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    schema = "row_index long, ledger_key string, fp string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        merge_stream(spark.readStream.schema(schema).parquet(source), ledger, out, str(tmp_path / "check")).awaitTermination()

    add([(0, "a", "1"), (1, "b", "1")])
    add([(0, "a", "1"), (1, "b", "2"), (2, "c", "1")])
    merge_stream(spark.readStream.schema(schema).parquet(source), ledger, out, str(tmp_path / "check")).awaitTermination()
    assert {r.ledger_key: r.fp for r in ledger.read().collect()} == {"a": "1", "b": "2", "c": "1"}
    assert Counter(r.disposition for r in spark.read.parquet(out).collect()) == {"inserted": 3, "unchanged": 1, "updated": 1}
    name = query_id(spark, str(tmp_path / "check"))
    before = ledger.current()
    ledger.merge(spark.createDataFrame([(0, "z", "1")], schema), f"{name}/0", name)
    assert ledger.current() == before
    again = ledger.merge(spark.createDataFrame([(0, "a", "1"), (1, "b", "2"), (2, "c", "1")], schema), f"{name}/1", name)
    assert Counter(r.disposition for r in again.collect()) == {"inserted": 1, "unchanged": 1, "updated": 1}


def test_two_streams_and_a_reset_checkpoint(spark, tmp_path):
    """Each stream has its own first batch; one whose checkpoint is gone merges its rows again, as unchanged ones."""
    ledger, schema = Ledger(spark, str(tmp_path / "ledger"), buckets=3), "row_index long, ledger_key string, fp string"

    def run(name, check, rows):
        source = str(tmp_path / name)
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        merge_stream(spark.readStream.schema(schema).parquet(source), ledger, str(tmp_path / "out"), str(tmp_path / check)).awaitTermination()
        return {r.ledger_key: r.fp for r in ledger.read().collect()}

    assert run("one", "c1", [(0, "a", "1")]) == {"a": "1"}
    assert run("two", "c2", [(0, "b", "1"), (1, "a", "2")]) == {"a": "2", "b": "1"}
    assert run("two", "c2", []) == {"a": "2", "b": "1"} and ledger.current()["merges"] == 2
    assert run("two", "c3", []) == {"a": "2", "b": "1"} and ledger.current()["merges"] == 3
    assert Counter(r.disposition for r in spark.read.parquet(str(tmp_path / "out")).collect()) == {"inserted": 2, "updated": 1, "unchanged": 2}


def rows_written(spark, ledger, version):
    return spark.read.parquet(f"{ledger.path}/data/{version:08d}").count()


def test_a_merge_writes_what_it_changes(spark, tmp_path):
    """Against the merge of whole tables: deltas, compactions and versions; the rows written are those of the batch."""
    r = random.Random(5)
    ledger, schema = Ledger(spark, str(tmp_path / "ledger"), buckets=4, deltas=2), "row_index long, ledger_key string, fp string"
    held = spark.createDataFrame([], "ledger_key string, fp string, batch string, last_run string")
    states = []
    for version in range(1, 7):
        size = 400 if version == 1 else 5
        batch = spark.createDataFrame([(i, f"k{r.randrange(200)}", r.choice("xyz")) for i in range(size)], schema)
        out, held = core.merge(batch, held, f"b{version}", f"r{version}")
        got = ledger.merge(batch, f"b{version}", f"r{version}")
        key = lambda df: sorted(map(tuple, df.select("row_index", "disposition").collect()))
        assert key(got) == key(out)
        held = spark.createDataFrame(held.collect(), held.schema)
        states.append(sorted(map(tuple, held.collect())))
        assert sorted(map(tuple, ledger.read().collect())) == states[-1]
    assert rows_written(spark, ledger, 2) <= 5 and rows_written(spark, ledger, 3) <= 5
    assert any(whole > 1 for whole, _ in ledger.manifest(6).values())  # compacted
    assert all(sorted(map(tuple, ledger.read(v).collect())) == states[v - 1] for v in range(1, 7))
    ledger.roll_back(2, "back")
    assert sorted(map(tuple, ledger.read().collect())) == states[1]


def test_a_crash_before_a_version_counts(spark, tmp_path, monkeypatch):
    ledger, schema = Ledger(spark, str(tmp_path / "ledger")), "row_index long, ledger_key string, fp string"
    ledger.merge(spark.createDataFrame([(0, "a", "1")], schema), "b1", "r1")
    batch = spark.createDataFrame([(0, "a", "2"), (1, "b", "1")], schema)

    def crash(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_name", crash)
        with pytest.raises(RuntimeError):
            ledger.merge(batch, "b2", "r2")
    assert {r.ledger_key: r.fp for r in ledger.read().collect()} == {"a": "1"}
    got = ledger.merge(spark.createDataFrame([(0, "c", "9")], schema), "b3", "r3")
    assert [r.disposition for r in got.collect()] == ["inserted"]
    assert {r.ledger_key: r.fp for r in ledger.read().collect()} == {"a": "1", "c": "9"}
    ledger.merge(batch, "b2", "r2")
    assert {r.ledger_key: r.fp for r in ledger.read().collect()} == {"a": "2", "b": "1", "c": "9"}
    open(tmp_path / "ledger" / "merges" / "part-x.parquet", "wb").write(b"broken")
    with pytest.raises(Exception):  # a fault in the table of merges is no empty ledger
        ledger.merge(batch, "b4", "r4")


def test_a_run_can_merge_several_batches(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for batch, fp in (("b1", "1"), ("b2", "2"), ("b3", "3")):
        ledger.merge(spark.createDataFrame([(0, "a", fp)], "row_index long, ledger_key string, fp string"), batch, "r1")
    assert [(r.fp, r.batch) for r in ledger.read().collect()] == [("3", "b3")]


def test_a_ledger_goes_back(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    schema = "row_index long, ledger_key string, fp string"
    for batch, fp in (("b1", "1"), ("b2", "2")):
        ledger.merge(spark.createDataFrame([(0, "a", fp)], schema), batch, "r1")
    ledger.roll_back(1, "r2")
    assert [r.fp for r in ledger.read().collect()] == ["1"] and ledger.current() == {"version": 3, "merges": 3}
    ledger.merge(spark.createDataFrame([(0, "a", "3")], schema), "b3", "r3")
    assert [r.fp for r in ledger.read().collect()] == ["3"]


def test_dense_rows_are_spread_before_they_are_normalised(spark):
    n = core.normalize(view(spark, "/root/testdata/sf0.001", CONTACT))
    plan = n._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Project") < plan.index("RepartitionByExpression [c_custkey") < plan.index("parquet")


def test_breakdown_works_out_its_column_once(spark):
    df = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "kind string")
    counts = core.breakdown(df.withColumn("kind", F.lower("kind")), "kind", ("a", "b"))
    assert sorted(map(tuple, counts.collect())) == [("a", 2), ("b", 0)]
    assert "Join" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_few_bytes_of_dense_rows_are_many_parts(spark):
    """90,000 short rows are about a megabyte, of which adaptive execution would make one task."""
    rows = spread(spark.range(0, 90_000, 1, 1).withColumnRenamed("id", "c_custkey"), "c_custkey")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert rows.groupBy(F.spark_partition_id().alias("p")).count().count() == int(before)


def test_texts_that_are_normal_are_told_by_one_look(spark):
    """What normal_text passes by comes out as by all of its steps, and company names without a short form as they were."""
    edges = ["", " ", "a", "a b", "a  b", " a", "a\u3000", "Ａ", "ｱ", "ｶﾞ", "ﾞ", "a\tb", "a\x7fb", "a\x00", "㈱a", "a(株)b", "a（有）", "(同)(資)x", "株式会社　x", "\ufffd", "é e", "\U00020BB7 野", "～", "､x", "\u00a0x", "\ufeff", "東京都 1丁目"]
    df = spark.createDataFrame([(e,) for e in edges] + [(None,)], "t string").repartition(2)
    steps = lambda c: text.tidy(text.wide_kana(F.translate(text.text(c), text.FULL_ASCII, text.HALF_ASCII)))
    got = df.select("t", text.normal_text(F.col("t")).alias("a"), steps(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and {r.t: r.a for r in got}["ｶﾞ"] == "ガ"
    names = {r.t: r.c for r in df.select("t", text.company_name(F.col("t")).alias("c")).collect()}
    assert [names[t] for t in ("㈱a", "a(株)b", "a（有）", "(同)(資)x", "a")] == ["株式会社a", "a(株)b", "a有限会社", "合同会社(資)x", "a"]


def test_keys_of_candidates_are_shuffled_once(spark):
    df = spark.createDataFrame([(i, f"03{i % 3:08d}", "") for i in range(9)], "row_index int, phone string, email string")
    found = core.duplicate_members(df)
    assert sorted((r.first_row, r.size) for r in found.collect()) == [(i, 3) for i in range(3) for _ in range(3)]
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_a_values_type_is_worked_out_once(spark):
    df = spark.createDataFrame([(0, "1"), (1, "x@y"), (2, "a@b")], "row_index int, v string")
    types = audit.infer_types(df, ["v"])
    assert [tuple(r) for r in types.collect()] == [("v", "email")]
    assert types._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= len(audit.TYPES)


def test_a_report_counts_values_once(spark):
    """From counts that are kept, profile and most frequent values are the same as from the rows."""
    df = spark.createDataFrame([(i, "abc"[i % 3], "" if i % 2 else " x ") for i in range(10)], "row_index int, v string, w string")
    counts = audit.value_counts(df, ["v", "w"]).localCheckpoint()
    for f in (audit.column_profile, audit.top_values):
        kept = f(df, ["v", "w"], counts=counts)
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, f(df, ["v", "w"]).collect()))
