"""Queries of sources, sinks and versions: a given table is written to the shared folder and read back, with its SQL."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.operators import audit, checks, core, decisions, flow, keyfilter, routing, sketches, suggest
from tallyloom.operators.settle import shared_folder
from tallyloom.plans import duck
from tallyloom.plans.catalogue import _RUNS, query, table
from tallyloom.plans.flows import _ROWS, run
from tallyloom.plans.views import CONTACT, FLOW
from tallyloom.sources import delimited, detect, ingest, ranges, spreadsheet
from tallyloom.sources.delimited import Options
from tallyloom.streaming.ledger import Ledger, merge_stream

# --- delimited files -------------------------------------------------------------------------------------------------

_CELL = "concat('say \"', customer_name, '\"\n', address, ', ', email, '\n')"
_EXPORT = f"select cast(row_index as string) as id, customer_name, address, {_CELL} as memo, store_name from ({CONTACT}) c"
_SHOWN = f"select id, {duck.trimmed('customer_name')} as customer_name, {duck.trimmed('address')} as address, {duck.trimmed('memo')} as memo, {duck.trimmed('store_name')} as store_name from export"
_NAMES = ["id", "customer_name", "address", "memo", "store_name"]


def _written(df, **options):
    path = shared_folder(df.sparkSession, "export")
    delimited.write(df, path, **options)
    return path


@query(_SHOWN, export=_EXPORT)
def csv_read_back(export):
    """Cells with quotes, line ends and delimiters, written as files and read again."""
    found = ingest.read_source(export.sparkSession, _written(export) + "/*.csv", Options(header=True))
    return found.rows.select(*_NAMES)


@query(_SHOWN.replace(f"{duck.trimmed('memo')} as memo", "regexp_replace(trim(store_name), '^$', '-') as memo"), export=_EXPORT)
def tsv_of_another_encoding(export):
    """Tabs and CP932, both found out from files without a header."""

    def encoded(it):
        for b in it:
            rows = zip(*(b.column(c).to_pylist() for c in ("id", "customer_name", "address", "store_name")))
            yield pa.record_batch([pa.array(["\t".join((i, n, a, t.strip() or "-", t)).encode("cp932") for i, n, a, t in rows], pa.binary())], names=["line"])

    path = shared_folder(export.sparkSession, "tabs")
    export.mapInArrow(encoded, "line binary").select(F.col("line").cast("string")).write.text(path)
    found = ranges.scan(export.sparkSession, path + "/*.txt", Options(header=False))
    kinds = found.where((F.col("encoding") == "cp932") & (F.col("delimiter") == "\t"))
    return delimited.tabled(kinds).rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(_NAMES)])


_ODD = "select o_orderkey as k, concat(cast(o_orderkey as string), ',', replace(o_orderpriority, ',', ' '), case when o_orderkey % 9 = 4 then '' when o_orderkey % 9 = 5 then ',2024-01-01,more' else ',2024-01-01' end) as line from {orders}"


def _odd_file(odd):
    path = shared_folder(odd.sparkSession, "odd")
    good_first = odd.withColumn("_bad", F.col("k") % 9 == 4).repartition(3, "k").sortWithinPartitions("_bad", "k")
    good_first.select("line").write.text(path)
    return path + "/*.txt"


@query("select line as raw, 'COLUMN_MISALIGNMENT' as reason, sha256(line) as raw_sha256, case when k % 9 = 4 then 'expected 3 cells, got 2' else 'expected 3 cells, got 4' end as detail from odd where k % 9 in (4, 5)", odd=_ODD)
def csv_failures(odd):
    """Records with another number of cells than the first one, whose file has no header."""
    found = delimited.read(odd.sparkSession, _odd_file(odd.where("k % 9 <> 5 or k > 0")), Options(header=False))
    return found.failures.select("raw", "reason", "raw_sha256", "detail")


@query("select 'c0,c1,c2' as columns, count(*) filter (k % 9 not in (4, 5)) as good, count(*) filter (k % 9 in (4, 5)) as misaligned, 'utf8' as encoding, 'strict' as quote_mode from odd", odd=_ODD)
def csv_diagnosis(odd):
    found = delimited.diagnosis(delimited.scan(odd.sparkSession, _odd_file(odd), Options(header=False)))
    whole = found.agg(F.lit("c0,c1,c2").alias("columns"), F.sum("rows").alias("good"), F.sum("misaligned").alias("misaligned"), F.max("encoding").alias("encoding"), F.max("quote_mode").alias("quote_mode"))
    return whole


@query("select o_orderkey as k, o_orderkey % 3 <> 0 as named from orders")
def headers_found_out(spark, sf_dir):
    """Files of one record below a first line that may be a header, or data itself: as the reader decides."""
    o = table(spark, sf_dir, "orders")
    first = F.when(F.col("o_orderkey") % 3 == 0, "2024-01-02,0312345678,77,x").otherwise("date,phone,n,text")
    cells = lambda c: F.split(c, ",")
    rows = o.select(F.col("o_orderkey").alias("k"), cells(first).alias("first"), cells(F.lit("2024-01-03,0398765432,78,y")).alias("next"))

    def judged(it):
        for b in it:
            named = [detect.has_header([x, y]) for x, y in zip(b.column("first").to_pylist(), b.column("next").to_pylist())]
            yield pa.record_batch([b.column("k"), pa.array(named, pa.bool_())], names=["k", "named"])

    return rows.mapInArrow(judged, "k long, named boolean")


@query("with d as (select coalesce(lang, '?') as lang, coalesce(text, '') as text from documents) select lang, cast(sum(length(regexp_replace(text, '[^\\n]', '', 'g')) + 1) as bigint) as lines, (select cast(sum(length(regexp_replace(text, '[^\\n]', '', 'g')) + 1) as bigint) from d) as total from d group by 1")
def raw_lines(spark, sf_dir):
    """Lines of whole texts as files hold them, by folder and in all."""
    path = shared_folder(spark, "lines")
    table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.groupBy("lang").agg(F.count("*").alias("lines")).withColumn("total", F.lit(lines.count()))


@query("select length(b) as size, sha256(b) as content_sha256, sha256(left(b, 40) || length(b)) as head_sha256 from (select string_agg(c_custkey || '-' || c_mktsegment || chr(10), '' order by c_custkey) as b from customer group by c_nationkey)")
def file_hashes(spark, sf_dir):
    """A file a nation, read in the task that hashes it; heads are of 40 bytes here."""
    path = shared_folder(spark, "hashed")
    lines = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit("-"), "c_mktsegment").alias("line"))
    lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "line").write.partitionBy("c_nationkey").text(path)
    return routing.file_hashes(spark, path + "/*/*.txt", 40).select("size", "content_sha256", "head_sha256")


# --- sheets ----------------------------------------------------------------------------------------------------------

_BOOK_ROWS = 500  # of each book that the queries make
_PARTS = {
    "xl/workbook.xml": '<workbook xmlns="{m}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="customers" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="{m}"><numFmts><numFmt numFmtId="170" formatCode="#,##0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
}
_SPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _book(rows) -> bytes:
    """A book of (name, day number, amount, extra cell): names as shared strings with a reading, rich text every third."""
    strings, lines = [], ["<row><c t='inlineStr'><is><t>氏名</t></is></c><c t='inlineStr'><is><t>契約日</t></is></c><c t='inlineStr'><is><t>金額</t></is></c></row>"]
    for i, (name, day, amount, more) in enumerate(rows):
        t = escape(name)
        inner = f"<r><t xml:space='preserve'>{t[:1]}</t></r><r><rPr/><t xml:space='preserve'>{t[1:]}</t></r>" if i % 3 == 0 and "&" not in t else f"<t xml:space='preserve'>{t}</t>"
        strings.append(f"<si>{inner}<rPh sb='0' eb='1'><t>ヨミ</t></rPh></si>")
        extra = f"<c t='inlineStr'><is><t>{more}</t></is></c>" if more else ""
        lines.append(f"<row><c t='s'><v>{i}</v></c><c s='1'><v>{day}</v></c><c s='2'><v>{amount}</v></c>{extra}</row>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in _PARTS.items():
            z.writestr(name, part.replace("{m}", _SPACE))
        z.writestr("xl/sharedStrings.xml", f"<sst xmlns='{_SPACE}'>{''.join(strings)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet xmlns='{_SPACE}'><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return out.getvalue()


def _books(spark, sf_dir):
    """path, content: a table's rows as books of _BOOK_ROWS each."""
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.concat(F.lit("顧客 "), "c_name").alias("name"), (F.lit(45000) + F.col("c_custkey") % 300).alias("day"), F.round(F.col("c_acctbal"), 2).cast("decimal(18,2)").cast("string").alias("amount"), F.when(F.col("c_custkey") % 7 == 0, F.lit("note")).otherwise("").alias("more"), F.floor(F.col("c_custkey") / _BOOK_ROWS).alias("book"))

    def made(df):
        df = df.sort_values("c_custkey")
        return type(df)({"path": [f"book{df.book.iloc[0]}.xlsx"], "content": [_book(zip(df.name_, df.day, df.amount, df.more))]})

    return rows.withColumnRenamed("name", "name_").groupBy("book").applyInPandas(made, "path string, content binary")  # _BOOK_ROWS a group


_ROW_OF = f"row_number() over (partition by c_custkey // {_BOOK_ROWS} order by c_custkey) - 1 as row_index, 'book' || (c_custkey // {_BOOK_ROWS}) || '.xlsx' as file"


@query(f"select file, row_index, '顧客 ' || c_name as name, strftime(date '1899-12-30' + cast(45000 + c_custkey % 300 as int), '%Y-%m-%d') as day, format('{{:,.2f}}', cast(cast(round(c_acctbal, 2) as decimal(18, 2)) as double)) as amount from (select *, {_ROW_OF} from customer) where c_custkey % 7 <> 0")
def sheets_read(spark, sf_dir):
    """Names without their readings, dates and numbers as the sheet shows them."""
    found = delimited.tabled(spreadsheet.parse(_books(spark, sf_dir)))
    return found.rows.select(F.col("_source_file").alias("file"), "row_index", F.col("氏名").alias("name"), F.col("契約日").alias("day"), F.col("金額").alias("amount"))


@query(f"select file, row_index, 'COLUMN_MISALIGNMENT' as reason, 'expected 3 cells, got 4' as detail from (select *, {_ROW_OF} from customer) where c_custkey % 7 = 0")
def sheet_failures(spark, sf_dir):
    """Rows that go on behind the header."""
    found = delimited.tabled(spreadsheet.parse(_books(spark, sf_dir)))
    return found.failures.select(F.col("source_file").alias("file"), "row_index", "reason", "detail")


# --- sinks -----------------------------------------------------------------------------------------------------------


@query(_ROWS + ", packed as (select *, case when disposition in ('review', 'pending') then 'review' when disposition = 'quarantine' then 'quarantine' else 'mainline' end as pack from final) select pack, cast(row_index as varchar) as row_index, cast(row_number() over (partition by pack order by disposition, disposition_reason, parent, file, source_key, record_key, full_fp, cast(row_index as varchar)) as varchar) as place, disposition from packed", flow=FLOW)
def packs_read_back(f):
    path = shared_folder(f.sparkSession, "packs")
    counts = flow.write_packs(run(f)[0], path, "gzip")
    back = f.sparkSession.read.option("header", True).option("escape", '"').csv(path)
    total = sum(counts.values())
    return back.select("pack", "row_index", "place", F.col("_final_disposition").alias("disposition"), F.lit(total).alias("_n")).where("_n > 0").drop("_n")


@query("select (n - 1) // 1000 + 1 as part, min(n) as first_row, max(n) as last_row, count(*) as rows, string_agg(row_index, ',' order by n) as ids from (select *, row_number() over (order by row_index) as n from flow) group by 1", flow=FLOW)
def parts_read_back(f):
    """A large file in parts of 1,000 rows with its own columns alone, beside their manifest."""
    path = shared_folder(f.sparkSession, "parts")
    manifest = flow.write_parts(f.withColumn("_added", F.lit(1)), path, 1000, ["row_index"], ["row_index", "customer_id", "note"])
    back = f.sparkSession.read.option("header", True).csv(path)
    ids = back.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col("row_index").cast("long"))), lambda x: x.cast("string")), ",").alias("ids"), F.lit(",".join(back.columns)).alias("_columns"))
    return manifest.join(ids, "part").where("_columns = 'row_index,customer_id,note,part'").drop("_columns")


@query("select row_index, run from (select row_index, 'r1' as run from flow union all select row_index, 'r2' from flow where row_index % 2 = 0)", flow=FLOW)
def run_tables_read_back(f):
    """Two runs' tables side by side; a run that is written again replaces its own alone."""
    root, spark = shared_folder(f.sparkSession, "runs"), f.sparkSession
    flow.write_run(root, "r1", {"rows": f.limit(0)})
    flow.write_run(root, "r2", {"rows": f.where("row_index % 2 = 0")})
    flow.write_run(root, "r1", {"rows": f})
    return flow.read_run(spark, root, "rows", "r1").select("row_index", F.lit("r1").alias("run")).unionByName(flow.read_run(spark, root, "rows", "r2").select("row_index", F.lit("r2").alias("run")))


_FAULTS = f"select row_index, 'phone' as field, {duck.trimmed('phone')} as value, {duck.phone_fault(duck.phone('phone'))} as reason, 'in/contact.csv' as file from contact where {duck.filled('phone')}"


@query(f"select cast(row_index as varchar) as row_index, field, value, file from ({_FAULTS}) where reason is not null", contact=CONTACT)
def anomalies_written(contact):
    """Anomalies written with their file where there are any, and nothing where there are none."""
    spark, c = contact.sparkSession, contact.select("row_index", "phone")
    path, none = shared_folder(spark, "anomalies"), shared_folder(spark, "none")
    found = core.anomalies(c)
    n = delimited.write_found(found, path, "in/contact.csv")
    if delimited.write_found(found.limit(0), none) or n == 0:
        raise ValueError("anomalies are written where there are any")
    return delimited.read(spark, path + "/*.csv", Options(header=True)).rows.select(F.col("row_index_2").alias("row_index"), "field", "value", "file")


# --- versions --------------------------------------------------------------------------------------------------------

_CHANGES = "select o_orderkey as row_index, concat('k', cast(o_custkey as string)) as ledger_key, concat('f', cast(o_orderkey % 5 as string)) as fp, o_orderkey % 3 as part from {orders}"
@query(", o as (select ledger_key, fp, part, row_number() over (partition by ledger_key order by part, row_index) as n from changes), w as (select *, lag(fp) over (partition by ledger_key order by n) as p from o) select ledger_key, max_by(fp, n) as fp, max_by('b' || part, case when p is null or p <> fp then n end) as batch from w group by 1", changes=_CHANGES)
def ledger_versions(changes):
    """Three batches merged into a ledger one after the other, then gone back on and merged again."""
    ledger = Ledger(changes.sparkSession, shared_folder(changes.sparkSession, "ledger"), buckets=8, deltas=1)
    for part in (0, 1, 2):
        ledger.merge(changes.where(F.col("part") == part).drop("part"), f"b{part}", f"r{part}")
    ledger.roll_back(1, "back")
    for part in (1, 2):
        ledger.merge(changes.where(F.col("part") == part).drop("part"), f"b{part}", f"again{part}")
    return ledger.read().select("ledger_key", "fp", "batch")


@query(", w as (select *, lag(fp) over (partition by ledger_key order by row_index) as p from changes), f as (select *, coalesce(max(case when p is null or p <> fp then 1 end) over (partition by ledger_key order by row_index rows between unbounded preceding and 1 preceding), 0) as moved from w) select row_index, case when p is null then 'inserted' when p <> fp then 'updated' else 'duplicate' end as disposition from f", changes=_CHANGES)
def ledger_stream(changes):
    """A stream of files merged into a ledger once, and what each row came to."""
    spark, out = changes.sparkSession, shared_folder(changes.sparkSession, "dispositions")
    source = shared_folder(spark, "changes")
    changes.drop("part").write.parquet(source)
    stream = spark.readStream.schema("row_index long, ledger_key string, fp string").parquet(source)
    merge_stream(stream, Ledger(spark, shared_folder(spark, "ledger"), buckets=8), out, shared_folder(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("row_index", "disposition")


@query("select 'orders' as entity, o_orderkey as k, (select count(*) from orders where o_orderkey % 2 = 0) as loaded_first from orders where o_orderkey % 2 = 0")
def loaded_versions(spark, sf_dir):
    """Two loads of a table and a step back: the version that counts, and the rows of the first load by the log."""
    path, log, o = shared_folder(spark, "tables"), shared_folder(spark, "log"), table(spark, sf_dir, "orders")
    checks.load(o.where("o_orderkey % 2 = 0"), path, "orders", log, "v1")
    checks.load(o, path, "orders", log, "v2")
    checks.roll_back(spark, path, "orders", log, "v1")
    first = checks.steps(spark, log).where("step = 1").select("entity", F.col("row_count").alias("loaded_first"))
    return checks.current(spark, path, "orders", log).select(F.col("o_orderkey").alias("k")).join(F.broadcast(first)).select("entity", "k", "loaded_first")


@query("select run_id, (select count(*) from runs) as total from runs order by run_id desc limit 500 offset 200", runs=_RUNS)
def run_pages(runs):
    page, total = flow.latest_runs(runs, 200, 600)
    return page.select("run_id", F.lit(total).alias("total"))


# --- decisions -------------------------------------------------------------------------------------------------------

@query("select row_index as id, case when row_index % 3 = 0 then 'column_ignore' else 'column_canonical' end || case when row_index % 5 = 0 then '!' else '' end as kind from contact", contact=CONTACT)
def resolutions_kept(contact):
    memory = contact.select(F.col("row_index").alias("id"), F.when(F.col("row_index") % 3 == 0, "column_ignore").otherwise("column_canonical").alias("kind"))
    changes = memory.where("id % 5 = 0").withColumn("kind", F.concat("kind", F.lit("!")))
    return decisions.upsert(memory, changes, ["id"])


@query("select row_index, case when row_index % 4 = 0 and store_name like '%本店' then 'accepted' when row_index % 4 = 0 and store_name = '' then 'unused' when row_index % 4 = 0 then 'unknown' else 'rejected' end as decision, case when row_index % 4 = 0 and store_name like '%本店' then 'store_name' end as field from contact", contact=CONTACT)
def template_applied(contact):
    """A template's decisions where none has been made yet."""
    reviews_ = contact.select("row_index", F.when(F.col("store_name").endswith("本店"), "main").when(F.col("store_name") == "", "none").otherwise("branch").alias("name"), F.when(F.col("row_index") % 4 == 0, "unknown").otherwise("rejected").alias("decision"))
    template = contact.sparkSession.createDataFrame([("main", "store_name", "high"), ("none", "", "medium"), ("branch", "branch", "low")], "name string, field string, certainty string")
    return suggest.applied_template(reviews_, template).select("row_index", "decision", "field")


@query("select row_index, row_index % 6 = 0 as eligible from contact", contact=CONTACT)
def spared_reviews(contact):
    files = contact.select("row_index", F.when(F.col("row_index") % 3 == 0, "high").otherwise("low").alias("confidence"), F.when(F.col("row_index") % 2 == 0, "p").alias("profile"))
    return suggest.fast_path(files).select("row_index", "eligible")


@query("select reason, total, place from (select o_orderpriority as reason, cast(sum(o_orderkey % 7) as bigint) as total, cast(row_number() over (order by sum(o_orderkey % 7) desc, o_orderpriority) as int) as place from orders group by 1) where place <= 5")
def runs_compared(spark, sf_dir):
    hints = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), (F.col("o_orderkey") % 4).cast("string")).alias("run"), F.col("o_orderpriority").alias("value"), (F.col("o_orderkey") % 7).alias("n"))
    return flow.compare_runs(hints)


_GARBLED = "select c_custkey as row_index, case when c_custkey % 3 = 0 then concat('Ã©Ã¨', c_name) else c_name end as a, case when c_custkey % 25 = 0 then 'x�' else c_mktsegment end as b, c_mktsegment as c from {customer}"


@query(", s as (select * from g order by row_index limit 50), v as (select unnest([{'field': 'a', 'v': a, 'bad': row_index % 3 = 0}, {'field': 'b', 'v': b, 'bad': row_index % 25 = 0}, {'field': 'c', 'v': c, 'bad': false}]) as u from s), n as (select u.field as field, count(*) as cells, count(*) filter (u.bad) as garbled from v group by 1) select field, cells, garbled, round(garbled / cells, 4) as ratio, case when garbled / cells >= 0.3 then 'broken' when garbled / cells >= 0.02 then 'suspect' else 'ok' end as verdict from n", g=_GARBLED)
def mojibake_verdicts(g):
    return audit.mojibake_verdict(g, ["a", "b", "c"])


@query("select c_custkey as row_index, sha256(array_to_string(list_sort(['c_' || c_nationkey, 'a', c_mktsegment]), '|')) as schema from customer")
def schema_fingerprints(spark, sf_dir):
    names = F.array(F.concat(F.lit("c_"), F.col("c_nationkey").cast("string")), F.lit("a"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_index"), routing.schema_key(names).alias("schema"))


# --- staging ---------------------------------------------------------------------------------------------------------

_STAGED = "'{file}' as raw_source_file, cast(row_index + 2 as varchar) as raw_row_origin, '{file}:row_' || cast(row_index + 2 as varchar) as source_fingerprint"
_CUSTOMER = {"customer_name": "customer_name", "phone": "phone", "email": "email", "address": "address", "fax": "fax"}
_DEAL = {"product": "product", "contract_date": "contract_date", "amount": "amount", "memo": "note", "status": "deal_status"}


@query(f"select {duck.trimmed('customer_name')} as customer_name, {duck.trimmed('phone')} as phone, {duck.trimmed('email')} as email, {duck.trimmed('address')} as address, '' as fax, {_STAGED.format(file='customers.xlsx')} from contact", contact=CONTACT)
def staging_customers(contact):
    return audit.staging(contact, "customers.xlsx", _CUSTOMER)


@query(f"select {duck.trimmed('product')} as product, {duck.trimmed('contract_date')} as contract_date, {duck.trimmed('amount')} as amount, {duck.trimmed('note')} as memo, '' as status, {_STAGED.format(file='deals.xlsx')} from contact where product <> ''", contact=CONTACT)
def staging_deals(contact):
    return audit.staging(contact.where("product <> ''"), "deals.xlsx", _DEAL)


@query("with d as (select o_orderpriority || '/' || (o_orderkey % 40) as value, count(*) as n from orders group by 1), m as (select distinct o_orderpriority || '/' || (o_orderkey % 40) as value, 'stage ' || (o_orderkey % 40) % 6 as stage, case (o_orderkey % 40) % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as certainty from orders where o_orderkey % 40 < 30), j as (select d.value, n, case when certainty = 'high' then stage when certainty is not null then stage || '?' else 'unresolved' end as stage, n * case certainty when 'high' then 1 when 'medium' then 2 else 3 end as impact from d left join m using (value)) select value, n, stage, impact, cast(row_number() over (order by impact desc, value) as int) as priority_rank from j")
def stage_table_join(spark, sf_dir):
    """Statuses with the stages that a table of them gives."""
    o = table(spark, sf_dir, "orders").withColumn("_k", F.col("o_orderkey") % 40)
    value = F.concat("o_orderpriority", F.lit("/"), F.col("_k").cast("string"))
    found = o.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    certainty = F.when(F.col("_k") % 3 == 0, "high").when(F.col("_k") % 3 == 1, "medium").otherwise("low")
    stages = o.where("_k < 30").select(value.alias("value"), F.concat(F.lit("stage "), (F.col("_k") % 6).cast("string")).alias("stage"), certainty.alias("certainty")).distinct()
    return decisions.stage_impact(found, stages).select("value", "n", "stage", "impact", "priority_rank")


# --- profiles --------------------------------------------------------------------------------------------------------

_SKETCHED = ["o_orderpriority", "o_orderstatus", "o_custkey", "o_orderkey"]


@query("with v as (select unnest([{'field': 'o_orderpriority', 'v': o_orderpriority}, {'field': 'o_orderstatus', 'v': o_orderstatus}, {'field': 'o_custkey', 'v': cast(o_custkey as varchar)}, {'field': 'o_orderkey', 'v': cast(o_orderkey as varchar)}]) as u from orders), c as (select u.field as field, u.v as value, count(*) as n from v group by 1, 2) select field, cast(sum(n) as bigint) as n, cast(sum(n) as bigint) as filled, cast(1.0 as double) as fill_rate, true as distinct_is_close, max(length(value)) as longest, case when field in ('o_orderpriority', 'o_orderstatus') then max(n) end as most_frequent from c group by 1")
def merged_profiles(spark, sf_dir):
    """A batch's profile from the sketches of its four files, written beside them and read instead of them."""
    o = table(spark, sf_dir, "orders").withColumn("_source_file", F.concat(F.lit("part"), (F.col("o_orderkey") % 4).cast("string")))
    path = shared_folder(spark, "sketches")
    sketches.sketched(o, _SKETCHED).write.parquet(path)
    exact = o.select(*[F.count_distinct(c).alias(c) for c in _SKETCHED]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("_exact")) for c in _SKETCHED])))
    found = sketches.merged(spark.read.parquet(path)).join(F.broadcast(exact), "field")
    return found.select("field", "n", "filled", F.col("fill_rate").cast("double").alias("fill_rate"), sketches.close(F.col("distinct"), F.col("_exact")).alias("distinct_is_close"), F.col("longest").cast("long").alias("longest"), F.when(F.col("field").isin(_SKETCHED[:2]), F.array_max(F.transform("top_values", lambda x: x["n"]))).alias("most_frequent"))


@query("with old as (select o_custkey as k, o_orderstatus as s from orders where o_orderkey % 5 <> 0), new as (select o_custkey + case when o_orderkey % 10 = 0 then 1000000000 else 0 end as k, o_orderstatus as s from orders where o_orderkey % 5 = 0), sides as (select * from old union all select * from new) select 'unique(k,s)' as rule, k || '|' || s as value, count(*) as n from sides where (k, s) in (select (k, s) from new) group by k, s having count(*) > 1")
def added_violations(spark, sf_dir):
    """What a load adds against a unique key, by a filter of the keys that were there."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 5 <> 0").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    new = o.where("o_orderkey % 5 = 0").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 1_000_000_000).otherwise(0)).alias("k"), F.col("o_orderstatus").alias("s"))
    path = shared_folder(spark, "filter")
    keyfilter.key_filter(old, ["k", "s"], 100_000).write.parquet(path)
    return keyfilter.added_violations(new, ["k", "s"], spark.read.parquet(path), lambda: old)


# --- what cells, lines and templates are like ------------------------------------------------------------------------

_DATA = "(?i:https?://)|^\\d{4}[./-]\\d{1,2}[./-]\\d{1,2}$|^\\d{1,2}:\\d{2}(:\\d{2})?$|^\\d{2,4}-\\d{2,4}-\\d{3,4}$|[\\x00-\\x1f]|^[0-9０-９]+$"


@query("select row_index, " + ", ".join(f"regexp_matches({duck.trimmed(c)}, {duck.q(_DATA)}) as {c}" for c in ("phone", "contract_date", "email", "amount")) + " from contact", contact=CONTACT)
def data_like_cells(contact):
    """Which cells are data rather than names, as the header's detection asks."""
    names = ["phone", "contract_date", "email", "amount"]

    def judged(it):
        for b in it:
            yield pa.record_batch([b.column("row_index"), *[pa.array([detect.data_like(v or "") for v in b.column(c).to_pylist()], pa.bool_()) for c in names]], names=["row_index", *names])

    return contact.select(F.col("row_index").cast("long").alias("row_index"), *names).mapInArrow(judged, "row_index long, " + ", ".join(f"{c} boolean" for c in names))


@query("select o_orderkey as k, case o_orderkey % 4 when 0 then ',' when 1 then chr(9) when 2 then ';' else ',' end as delimiter from orders")
def delimiters_found(spark, sf_dir):
    """The delimiter of files of three lines; without one it is a comma."""
    k = F.col("o_orderkey")
    mark = F.when(k % 4 == 0, ",").when(k % 4 == 1, "\t").when(k % 4 == 2, ";").otherwise(" ")
    line = F.concat(k.cast("string"), mark, F.col("o_orderpriority"), mark, F.col("o_orderstatus"))
    files = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat_ws("\n", line, line, line).alias("head"))

    def judged(it):
        for b in it:
            yield pa.record_batch([b.column("k"), pa.array([detect.delimiter(t) for t in b.column("head").to_pylist()], pa.string())], names=["k", "delimiter"])

    return files.mapInArrow(judged, "k long, delimiter string")


@query("select cast(c_nationkey as varchar) as schema, count(*) as decisions, count(*) filter (c_custkey % 7 < c_nationkey % 4) as doubtful, case when count(*) filter (c_custkey % 7 < c_nationkey % 4) = 0 then 'full' when count(*) filter (c_custkey % 7 < c_nationkey % 4) <= 0.2 * count(*) then 'partial' else 'review_required' end as eligible from customer group by 1")
def template_eligibility(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return suggest.template_eligibility(c.select(F.col("c_nationkey").cast("string").alias("schema"), F.when(F.col("c_custkey") % 7 < F.col("c_nationkey") % 4, "low").otherwise("high").alias("certainty")))


_ACTIVITIES = "select event_id as row_index, cast(event_id as string) as call_id, case when user_id % 3 = 0 then '' else '2024-01-01' end as activity_date, case when event_id % 4 = 0 then 'op' else ' ' end as operator, case when event_id % 5 = 0 then 'done' else '' end as result_code from {events}"


@query("select row_index, case when activity_date = '' or (trim(operator) = '' and result_code = '') then 'activity_timestamp_insufficient' else '' end as reason from activities", activities=_ACTIVITIES)
def activity_timestamps(activities):
    """Calls need a date, and an operator or a result."""
    strategy = core.Strategy(family="call_activity", native="call_id")
    return core.identify(activities, strategy).select("row_index", F.col("_review_reason").alias("reason"))
