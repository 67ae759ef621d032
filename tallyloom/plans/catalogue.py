"""All queries of the engine's own operators by name, each with SQL that gives the same rows.

A query takes (spark, sf_dir) and reads the tables there in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import dates, hashing, similarity, text
from tallyloom.operators import audit, core, decisions, reviews
from tallyloom.operators import checks as checks_of
from tallyloom.operators.settle import spread, with_share
from tallyloom.plans import duck
from tallyloom.plans.views import CALLS, CONTACT, DATED, MIXED, view

FLAGSHIP = "dup_candidate_groups"

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, **views: str):
    """Register a query; views are view texts that sql and the function's first arguments get by name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, v) for v in views.values()]) if views else f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = run
        if sql:
            names = ", ".join(f"{n} as ({duck_view(v)})" for n, v in views.items())
            _SQL[f.__name__] = (f"with {names} " if names else "") + sql
        return f

    return register


def duck_view(sql: str) -> str:
    from tallyloom.plans.views import duck as plain

    return plain(sql)


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scalars ---------------------------------------------------------------------------------------------------------


@query(f"select row_index, {duck.phone('phone')} as phone, {duck.phone_fault(duck.phone('phone'))} as fault from contact", contact=CONTACT)
def normalize_phone(c):
    return c.select("row_index", text.phone(F.col("phone")).alias("phone"), text.phone_fault(text.phone(F.col("phone"))).alias("fault"))


@query(f"select row_index, {duck.email('email')} as email, {duck.email_fault(duck.email('email'))} as fault from contact", contact=CONTACT)
def normalize_email(c):
    return c.select("row_index", text.email(F.col("email")).alias("email"), text.email_fault(text.email(F.col("email"))).alias("fault"))


@query(f"select row_index, {duck.company('company_name')} as company, {duck.company_key('company_name')} as match_key from contact", contact=CONTACT)
def normalize_company(c):
    return c.select("row_index", text.company_name(F.col("company_name")).alias("company"), text.company_key(F.col("company_name")).alias("match_key"))


@query(f"select row_index, {duck.address('address')} as address, {duck.address_key('address')} as match_key from contact", contact=CONTACT)
def normalize_address(c):
    return c.select("row_index", text.address(F.col("address")).alias("address"), text.address_key(F.col("address")).alias("match_key"))


@query(f"select row_index, {duck.normal_text('store_name')} as store, {duck.store_key('store_name')} as match_key, {duck.normal_text('customer_name')} as name from contact", contact=CONTACT)
def normalize_store(c):
    return c.select("row_index", text.store_name(F.col("store_name")).alias("store"), text.store_key(F.col("store_name")).alias("match_key"), text.normal_text(F.col("customer_name")).alias("name"))


@query(f"select doc_id, sha256({duck.normal_text('text')}) as normal_sha256, left({duck.normal_text('text')}, 80) as head from documents")
def normalize_text_documents(spark, sf_dir):
    v = text.normal_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(v, 256).alias("normal_sha256"), text.preview(v, 80).alias("head"))


@query(f"select row_index, {duck.date('contract_date')} as date, {duck.date_fault(duck.date('contract_date'))} as fault from dated", dated=DATED)
def normalize_date_formats(d):
    return d.select("row_index", dates.date(F.col("contract_date")).alias("date"), dates.date_fault(dates.date(F.col("contract_date"))).alias("fault"))


_N = "(cast(datediff('day', date '1899-12-30', cast(o_orderdate as date)) as double) + (o_orderkey % 86400) / 86400.0)"
_SEC = "(cast(round((o_orderkey % 86400) / 86400.0 * 86400) as bigint) % 86400)"


@query(
    f"select o_orderkey as row_index, strftime(cast(o_orderdate as date), '%Y-%m-%d') as date, lpad(cast({_SEC} // 3600 as varchar), 2, '0') || ':' || lpad(cast({_SEC} % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast({_SEC} % 60 as varchar), 2, '0') as time, "
    "case when o_orderkey % 3 = 0 then lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') || ':00' when o_orderkey % 3 = 1 then '00:00:' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') else 'soon' end as duration from orders"
)
def excel_serial_datetime(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")) + (F.col("o_orderkey") % 86400) / F.lit(86400.0)
    s = lambda x: x.cast("string")
    key = F.col("o_orderkey")
    spelt = F.when(key % 3 == 0, F.concat(s(key % 24), F.lit("時間"), s(key % 60), F.lit("分"))).when(key % 3 == 1, F.concat(s(key % 60), F.lit("秒"))).otherwise("soon")
    return o.select(key.alias("row_index"), dates.excel_date(serial).alias("date"), dates.excel_time(serial).alias("time"), dates.duration(spelt).alias("duration"))


_STEM = "lower(regexp_replace(regexp_extract(url, '[^/]*$'), '[?#].*$', ''))"


@query(
    "select page_id, stem, case when stem = base then 1.0 when length(stem) < 2 or length(base) < 2 then 0.0 else "
    "round(2.0 * list_sum(list_transform(list_distinct(x), lambda g: least(len(list_filter(x, lambda h: h = g)), len(list_filter(y, lambda h: h = g))))) / (len(x) + len(y)), 6) end as similarity from "
    "(select *, list_transform(range(1, length(stem)), lambda i: substr(stem, i, 2)) as x, list_transform(range(1, length(base)), lambda i: substr(base, i, 2)) as y from "
    "(select page_id, regexp_replace(host, '[-_ .]+', '_', 'g') as stem, 'blog_example' as base from (select page_id, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) as host from pages)))"
)
def filename_similarity(spark, sf_dir):
    host = F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)
    stem = similarity.filename_stem(host)
    urls = spread(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    return urls.select("page_id", stem.alias("stem"), F.round(similarity.dice(stem, F.lit("blog_example")), 6).alias("similarity"))


# --- normalise, quarantine, identify ---------------------------------------------------------------------------------

_NORMAL = {
    "customer_name": duck.normal_text("customer_name"),
    "phone": duck.phone("phone"),
    "email": duck.email("email"),
    "company_name": duck.company("company_name"),
    "store_name": duck.normal_text("store_name"),
    "address": duck.address("address"),
    "product": duck.normal_text("product"),
    "contract_date": duck.date("contract_date"),
    "amount": "amount",
    "note": "note",
}
_NORMALIZED = "normalized as (select row_index, " + ", ".join(f"{v} as {k}" for k, v in _NORMAL.items()) + " from contact)"


def with_contact(sql: str) -> str:
    return f"with contact as ({duck_view(CONTACT)}), {_NORMALIZED} {sql}"


def contact_query(sql: str, whole: bool = False):
    """Register a query over the normalised contacts; sql follows their definition, or is whole."""

    def register(f):
        def run(spark, sf_dir):
            return f(core.normalize(view(spark, sf_dir, CONTACT)))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__], _SQL[f.__name__] = run, sql if whole else with_contact(sql)
        return f

    return register


@contact_query("select * from normalized")
def normalize_records(n):
    return n


@query(
    "select row_index, u.field as field, u.value as value, u.reason as reason from (select row_index, unnest(["
    + ", ".join(f"{{'field': '{n}', 'value': {duck.trimmed(n)}, 'reason': case when {duck.filled(n)} then {fault} end}}" for n, fault in (("phone", duck.phone_fault(duck.phone("phone"))), ("email", duck.email_fault(duck.email("email"))), ("contract_date", duck.date_fault(duck.date("contract_date")))))
    + "]) as u from contact) where u.reason is not null",
    contact=CONTACT,
)
def anomaly_report(c):
    return core.anomalies(c)


_THIN = "case when row_index % 23 = 0 then '' else {0} end"
_THINNED = ", thin as (select row_index, " + ", ".join(f"case when row_index % 23 = 0 or (row_index % 29 = 0 and '{k}' not in ('address', 'note', 'amount')) then '' else {k} end as {k}" for k in _NORMAL) + " from normalized)"
_ALL_EMPTY = " and ".join(f"{k} = ''" for k in _NORMAL)
_REASON = f"case when {_ALL_EMPTY} then 'ALL_COLUMNS_EMPTY' when phone = '' and email = '' and customer_name = '' and company_name = '' and store_name = '' then 'BUSINESS_KEY_EMPTY' else '' end"


def thinned(n):
    return n.select("row_index", *[F.when((F.col("row_index") % 23 == 0) | ((F.col("row_index") % 29 == 0) & F.lit(k not in ("address", "note", "amount"))), "").otherwise(F.col(k)).alias(k) for k in _NORMAL])


@contact_query(f"{_THINNED} select row_index, {_REASON} as reason from thin")
def business_quarantine(n):
    t = thinned(n)
    return t.select("row_index", core.quarantine_reason(t).alias("reason"))


def _lines(fields, source="{0}"):
    return " || chr(10) || ".join(f"'{f}=' || {source.format(f)}" for f in sorted(fields))


def _pairs(fields):
    return "array_to_string(list_filter([" + ", ".join(f"case when {f} <> '' then '{f}=' || {f} end" for f in fields) + "], lambda x: x is not null), '|')"


_MASTER = ("customer_name", "company_name", "phone", "email", "address")
_FIXED = _pairs(["customer_name", "company_name", "phone"])
_FULL, _MAIN = f"sha256({_lines(_NORMAL)})", f"sha256({_lines(_MASTER)})"
_ENTITY = _pairs(sorted(core.ENTITY))
_OWNER = "case when (customer_name <> '' or company_name <> '' or phone <> '' or email <> '') and (product <> '' or contract_date <> '' or amount <> '') then 'hybrid' when customer_name <> '' or company_name <> '' or phone <> '' or email <> '' then 'customer_like' when product <> '' or contract_date <> '' or amount <> '' then 'deal_like' else 'unknown' end"
_METHOD = f"case when {_FIXED} <> '' then 'deterministic' else 'fallback' end"
_KEY = f"case when {_FIXED} <> '' then sha256('deterministic' || chr(0) || 'customer_master_like' || chr(0) || {_FIXED}) else sha256('fallback' || chr(0) || 'customer_master_like' || chr(0) || {_FULL}) end"
_WHY = f"case when {_METHOD} = 'fallback' then 'fallback_key' when {_OWNER} = 'hybrid' then 'semantic_owner_hybrid' when {_OWNER} = 'unknown' then 'semantic_owner_unknown' else '' end"
_IDENTITY = f"{_THINNED}, identity as (select row_index, {_KEY} as source_record_key, {_METHOD} as method, case when {_ENTITY} <> '' then sha256('entity' || chr(0) || 'customer_master_like' || chr(0) || {_ENTITY}) else '' end as entity_key, {_FULL} as fp_full, {_MAIN} as fp, {_OWNER} as owner, {_WHY} as review_reason from thin)"
_STRATEGY = core.Strategy(family="customer_master_like")


def identified(n):
    return core.identify(thinned(n), _STRATEGY)


@contact_query(f"{_IDENTITY} select *, case when review_reason = '' then 'mainline_ready' else 'review' end as eligibility from identity")
def record_identity(n):
    names = {"_source_record_key": "source_record_key", "_source_record_key_method": "method", "_entity_match_key": "entity_key", "_structural_fingerprint_full": "fp_full", "_structural_fingerprint": "fp", "_semantic_owner": "owner", "_review_reason": "review_reason", "_merge_eligibility": "eligibility"}
    return identified(n).select("row_index", *[F.col(k).alias(v) for k, v in names.items()])


_COLLIDED = f"{_IDENTITY}, bad as (select source_record_key from identity where method = 'deterministic' group by 1 having count(distinct fp) > 1), demoted as (select i.*, case when b.source_record_key is not null then 'deterministic_collision' else review_reason end as final_reason from identity i left join bad b using (source_record_key))"


@contact_query(f"{_COLLIDED} select row_index, final_reason as review_reason, case when final_reason = '' then 'mainline_ready' else 'review' end as eligibility from demoted")
def deterministic_collisions(n):
    return core.demote_collisions(identified(n)).select("row_index", F.col("_review_reason").alias("review_reason"), F.col("_merge_eligibility").alias("eligibility"))


@contact_query(f"{_COLLIDED} select method, owner, final_reason as review_reason, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as share from demoted group by 1, 2, 3")
def identity_summary(n):
    d = core.demote_collisions(identified(n))
    counts = d.groupBy(F.col("_source_record_key_method").alias("method"), F.col("_semantic_owner").alias("owner"), F.col("_review_reason").alias("review_reason")).agg(F.count("*").alias("n"))
    return with_share(counts)


@contact_query(f"{_COLLIDED} select owner, count(*) filter (final_reason <> '') as review_rows, count(*) as n, round(count(*) filter (final_reason <> '') / count(*), 4) as review_ratio from demoted group by 1 order by 4 desc, 2 desc, 1 limit 1")
def review_ratio_top(n):
    d = core.demote_collisions(identified(n)).groupBy(F.col("_semantic_owner").alias("owner"))
    return d.agg(F.count_if(F.col("_review_reason") != "").alias("review_rows"), F.count("*").alias("n")).withColumn("review_ratio", F.round(F.col("review_rows") / F.col("n"), 4)).orderBy(F.desc("review_ratio"), F.desc("review_rows"), "owner").limit(1)


# --- parents and order -----------------------------------------------------------------------------------------------

_SAFE = "(customer_id <> '' or (customer_name <> '' and (phone <> '' or address <> '')) or cast(customer_id <> '' as int) + cast(customer_name <> '' as int) + cast(phone <> '' as int) + cast(address <> '' as int) >= 2)"
_NONE = "(customer_id = '' and customer_name = '' and phone = '' and address = '')"
_COLUMNS = "array_to_string(list_filter([" + ", ".join(f"case when {c} <> '' then '{c}' end" for c in ("customer_id", "customer_name", "phone", "address")) + "], lambda x: x is not null), '|')"


@query(f"select row_index, case when {_SAFE} then 'parent_candidate' when history <> '' and {_NONE} then 'child_continuation' else 'ambiguous_parent' end as parent, case when {_SAFE} then 'strong_parent_signals' when history <> '' and {_NONE} then 'child_columns_only' else 'insufficient_parent_signals' end as reason, {_COLUMNS} as used from mixed", mixed=MIXED)
def parent_extraction(m):
    return core.parent_extraction(m, ["history"]).select("row_index", F.col("_parent").alias("parent"), F.col("_parent_reason").alias("reason"), F.col("_parent_columns").alias("used"))


@query("select row_index, customer_id <> '' as is_master, last_value(nullif(customer_id, '') ignore nulls) over w as filled_id, last_value(case when customer_id <> '' then phone end ignore nulls) over w as filled_phone from mixed window w as (order by row_index rows between unbounded preceding and current row)", mixed=MIXED)
def fill_forward_master_portal(m):
    return core.fill_forward(m, "customer_id", ["phone"]).select("row_index", (F.col("customer_id") != "").alias("is_master"), F.col("_filled_customer_id").alias("filled_id"), F.col("_filled_phone").alias("filled_phone"))


@query("select o_orderkey, row_number() over (order by o_orderkey) as n, cast((row_number() over (order by o_orderkey) - 1) // 5000 + 1 as bigint) as part from orders")
def split_parts(spark, sf_dir):
    n = audit.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return n.withColumn("part", F.floor((F.col("n") - 1) / 5000) + 1)


# --- ledger ----------------------------------------------------------------------------------------------------------

_LEDGER_ROWS = "select o_orderkey as row_index, concat('k', cast(o_custkey as string)) as ledger_key, concat(o_orderstatus, cast(o_orderkey % 3 as string)) as fp from {orders}"
_LEDGER = "select concat('k', cast(o_custkey as string)) as ledger_key, max_by(concat(o_orderstatus, cast(o_orderkey % 3 as string)), o_orderkey) as fp, case when o_custkey % 2 = 0 then 'b2' else 'b1' end as batch, 'r1' as last_run from {orders} where o_orderkey % 5 = 0 group by o_custkey"
_MERGED = """, joined as (select r.*, l.fp as lfp, l.batch as lbatch from incoming r left join ledger l using (ledger_key)),
prev as (select *, coalesce(lag(fp) over (partition by ledger_key order by row_index), lfp) as p from joined),
changed as (select *, p is null or p <> fp as c from prev),
batches as (select *, case when coalesce(max(cast(c as int)) over (partition by ledger_key order by row_index rows between unbounded preceding and 1 preceding), 0) = 1 then 'b2' else lbatch end as eb from changed),
merged as (select *, case when p is null then 'inserted' when p <> fp then 'updated' when eb = 'b2' then 'duplicate' else 'unchanged' end as disposition from batches)"""


@query(_MERGED + " select row_index, ledger_key, disposition, case disposition when 'inserted' then 'new_identity' when 'updated' then 'existing_changed_fingerprint' when 'duplicate' then 'same_batch_same_fingerprint' else 'existing_same_fingerprint' end as reason from merged", incoming=_LEDGER_ROWS, ledger=_LEDGER)
def ledger_merge_dispositions(r, ledger):
    return core.merge(r, ledger, "b2", "r2")[0].select("row_index", "ledger_key", "disposition", F.col("disposition_reason").alias("reason"))


@query(_MERGED + " select ledger_key, fp, batch, last_run from (select ledger_key, max_by(fp, row_index) as fp, case when max(cast(c as int)) = 1 then 'b2' else max(lbatch) end as batch, 'r2' as last_run from merged group by 1) union all select * from ledger where ledger_key not in (select ledger_key from incoming)", incoming=_LEDGER_ROWS, ledger=_LEDGER)
def ledger_after_merge(r, ledger):
    return core.merge(r, ledger, "b2", "r2")[1].select("ledger_key", "fp", "batch", "last_run")


@query(_MERGED + " select case when row_index % 50 = 0 then 'quarantine' when row_index % 20 = 0 then 'review' else 'mainline' end as pack, case when row_index % 50 = 0 then 'quarantine' when row_index % 20 = 0 then 'review' else disposition end as disposition, count(*) as n from merged group by 1, 2", incoming=_LEDGER_ROWS, ledger=_LEDGER)
def handoff_packs(r, ledger):
    m = core.merge(r, ledger, "b2", "r2")[0]
    final = m.withColumn("disposition", F.when(F.col("row_index") % 50 == 0, "quarantine").when(F.col("row_index") % 20 == 0, "review").otherwise(F.col("disposition")))
    return core.hand_off(final).groupBy("pack", "disposition").agg(F.count("*").alias("n"))


@query(_MERGED + " select disposition, substr(fp, 1, 1) as status, count(*) as n from merged group by 1, 2", incoming=_LEDGER_ROWS, ledger=_LEDGER)
def reconciliation_crosstab(r, ledger):
    return core.merge(r, ledger, "b2", "r2")[0].groupBy("disposition", F.left("fp", F.lit(1)).alias("status")).agg(F.count("*").alias("n"))


# --- candidates ------------------------------------------------------------------------------------------------------

_ORG = f"case when company_name <> '' then {duck.company_key('company_name')} when store_name <> '' then {duck.store_key('store_name')} end"
_KEYS = f""", keys as (select row_index, u.t as match_type, u.k as match_key from (select row_index, unnest([
 {{'t': 'phone', 'k': phone}}, {{'t': 'email', 'k': lower(email)}},
 {{'t': 'name_company', 'k': case when customer_name <> '' then lower(customer_name) || '|' || {_ORG} end}},
 {{'t': 'name_address', 'k': case when customer_name <> '' and address <> '' then lower(customer_name) || '|' || {duck.address_key('address')} end}}]) as u from normalized) where u.k is not null and u.k <> ''),
groups as (select match_type, match_key, min(row_index) as first_row, count(*) as size from keys group by 1, 2 having count(*) >= 2)"""


@contact_query(f"{_KEYS} select keys.match_type, keys.match_key, first_row, size, keys.row_index from keys join groups using (match_type, match_key)")
def dup_candidate_groups(n):
    return core.duplicate_members(n)


@contact_query(f"{_KEYS} select dense_rank() over (order by case match_type when 'phone' then 0 when 'email' then 1 when 'name_company' then 2 else 3 end, first_row, match_key) as group_id, match_type, first_row, size from groups")
def dup_group_numbers(n):
    order = F.array_position(F.array(*[F.lit(t) for t in core.MATCH_TYPES]), F.col("match_type")).alias("o")
    g = core.duplicate_groups(n).withColumn("o", order)
    return audit.numbered(g, ["o", "first_row", "match_key"], "group_id").select("group_id", "match_type", "first_row", "size")


def _score(fields):
    return " + ".join(f"cast({f} <> '' as int)" for f in fields)


_CLASSES = {"customer": (["customer_name", "phone", "email", "address", "company_name"], 5, 0), "deal": (["product", "contract_date", "amount"], 3, -1), "transaction": (["amount"], 3, -3), "activity": (["note"], 3, -2)}
_CLASSIFY = (
    ", scored as (select row_index, list_filter(["
    + ", ".join(f"{{'score': {_score(f)}, 'o': {o}, 'type': '{t}', 'total': {n}}}" for t, (f, n, o) in _CLASSES.items())
    + "], lambda s: s.score >= 2) as v from normalized), best as (select row_index, v, list_max(v) as b from scored), classified as (select row_index, case when len(v) = 0 then 'quarantine' else b.type end as candidate_type, "
    "case when len(v) = 0 then 'low' when b.score / b.total >= 0.6 and len(list_filter(v, lambda s: s.score = b.score)) = 1 then 'high' when b.score / b.total >= 0.4 then 'medium' else 'low' end as confidence, "
    "case when len(v) = 0 then 'insufficient fields for classification' else b.score || '/' || b.total || ' fields matched for ' || b.type end as reason from best)"
)


@contact_query(f"{_CLASSIFY} select * from classified")
def classify_records(n):
    return core.classify(n).select("row_index", "candidate_type", "confidence", "reason")


@contact_query(f"{_CLASSIFY} select t.value as value, count(row_index) as n from (select unnest(['customer', 'deal', 'transaction', 'activity', 'quarantine']) as value) t left join classified on candidate_type = t.value group by 1")
def classification_breakdown(n):
    return core.breakdown(core.classify(n), "candidate_type", ("customer", "deal", "transaction", "activity", "quarantine"))


_PROFILED = ["customer_name", "phone", "email", "company_name", "address", "product", "contract_date", "amount"]
_CELLS = ", cells as (select row_index, u.field, u.value from (select row_index, unnest([" + ", ".join(f"{{'field': '{c}', 'value': {c}}}" for c in _PROFILED) + "]) as u from normalized) where u.value <> ''), counted as (select field, value, count(*) as n, min(row_index) as first_row from cells group by 1, 2)"
_FIELDS = "(select unnest([" + ", ".join(f"'{c}'" for c in _PROFILED) + "]) as field)"


@contact_query(f"{_CELLS} select f.field, (select count(*) from normalized) as total, cast(coalesce(sum(n), 0) as bigint) as non_empty, round(1 - coalesce(sum(n), 0) / (select count(*) from normalized), 4) as missing_rate, least(count(n), 10000) as distinct_values, count(n) >= 10000 as capped, count(n) as exact_distinct, min(value) as smallest, max(value) as largest from {_FIELDS} f left join counted c on c.field = f.field group by 1")
def column_profile(n):
    return audit.column_profile(n, _PROFILED)


@contact_query(f"{_CELLS}, placed as (select *, cast(row_number() over (partition by field order by n desc, first_row, value) as int) as place from counted) select field, place, value, n from placed where place <= 10")
def top_values(n):
    return audit.top_values(n, _PROFILED)


_TYPE_CASE = " ".join(f"when regexp_matches(value, {duck.q(p)}) then '{t}'" for t, p in audit.TYPES)


@contact_query(f"{_CELLS}, kinds as (select field, case {_TYPE_CASE} else 'text' end as k from cells) select f.field, case when count(k) = 0 then 'empty' " + " ".join(f"when count(*) filter (k = '{t}') / count(*) > 0.6 then '{t}'" for t in ("date", "phone", "email", "number", "boolean")) + f" else 'text' end as type from {_FIELDS} f left join kinds c on c.field = f.field group by 1")
def infer_types(n):
    return audit.infer_types(n, _PROFILED)


@query("select doc_id, length(regexp_replace(coalesce(text, ''), '[^�]', '', 'g')) as replaced, length(regexp_replace(coalesce(text, ''), '[^À-ÿ]', '', 'g')) as latin, length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) as control, length(coalesce(text, '')) >= 4 and length(regexp_replace(coalesce(text, ''), '[^À-ÿ]', '', 'g')) >= 2 as suspect from documents")
def mojibake_scan(spark, sf_dir):
    return audit.mojibake(table(spark, sf_dir, "documents"), "text", "doc_id")


# --- audit -----------------------------------------------------------------------------------------------------------

_CUSTOMERS = CONTACT
_MATCHED = f""", longs as (select row_index as customer_id, {duck.trimmed('phone')} as raw from contact where {duck.filled('phone')}),
raws as (select raw, list_sort(list(distinct customer_id))[:{audit.CANDIDATES}] as ids, count(distinct customer_id) as c from longs group by 1),
norms as (select {duck.phone('raw')} as norm, list_sort(list(distinct customer_id))[:{audit.CANDIDATES}] as ids, count(distinct customer_id) as c from longs where {duck.phone('raw')} <> '' group by 1),
tried as (select c.*, {duck.trimmed('raw_phone')} as r, {duck.phone('raw_phone')} as n from calls c),
hits as (select t.*, raws.ids as rids, norms.ids as nids, coalesce(raws.c, 0) as nr, coalesce(norms.c, 0) as nn from tried t left join raws on raws.raw = t.r left join norms on norms.norm = t.n),
typed as (select *, case when r = '' then 'empty' when nr = 1 then 'exact' when length(n) < 10 then 'invalid' when nn = 1 then 'normalized' when greatest(nr, nn) > 1 then 'multi_match' else 'no_match' end as match_type, case when nr = 1 or nn = 0 then rids else nids end as ids, case when nr = 1 or nn = 0 then nr else nn end as found from hits),
matched as (select *, n as normalized_phone, match_type in ('exact', 'normalized', 'multi_match') as is_hit from typed)"""


def calls_matched(calls, contact):
    return audit.match_phones(calls, contact.select(F.col("row_index").alias("customer_id"), "phone"), ["phone"])


@query(_MATCHED + " select row_index, normalized_phone, match_type, case when is_hit then array_to_string(ids, ';') else '' end as candidates, case when is_hit then cast(found as int) else 0 end as candidate_count, case when match_type in ('exact', 'normalized') then ids[1] end as matched_customer_id from matched", calls=CALLS, contact=CONTACT)
def phone_match_join(calls, contact):
    return calls_matched(calls, contact).select("row_index", "normalized_phone", "match_type", "candidates", "candidate_count", "matched_customer_id")


@query(_MATCHED + " select norm as number, customer_id from (select distinct customer_id, " + duck.phone("raw") + " as norm from longs) where norm <> ''", calls=CALLS, contact=CONTACT)
def phone_candidates(calls, contact):
    return audit.phone_candidates(contact.select(F.col("row_index").alias("customer_id"), "phone"), ["phone"])


_QUEUE = _MATCHED + ", queue as (select *, case match_type when 'multi_match' then 'high' when 'no_match' then 'medium' else 'low' end as severity from matched where match_type in ('multi_match', 'no_match', 'invalid'))"


@query(_QUEUE + " select row_index, match_type, severity, case severity when 'high' then 1 when 'medium' then 2 else 3 end as priority from queue", calls=CALLS, contact=CONTACT)
def review_queue(calls, contact):
    return audit.review_queue(calls_matched(calls, contact)).select("row_index", "match_type", "severity", "priority")


@query(_QUEUE + ", numbers as (select normalized_phone, count(*) as calls, min(call_date) as first_date, max(call_date) as last_date, min(row_index) as first_row, max(severity) as severity from queue group by 1) select printf('HR-%06d', row_number() over (order by first_row)) as review_id, * from numbers", calls=CALLS, contact=CONTACT)
def review_packet(calls, contact):
    q = audit.review_queue(calls_matched(calls, contact))
    numbers = q.groupBy("normalized_phone").agg(F.count("*").alias("calls"), F.min("call_date").alias("first_date"), F.max("call_date").alias("last_date"), F.min("row_index").alias("first_row"), F.max("severity").alias("severity"))
    return audit.numbered(numbers, ["first_row"], "at").select(F.format_string("HR-%06d", "at").alias("review_id"), *numbers.columns)


@query(_MATCHED + " select match_type, count(*) as n, count(distinct normalized_phone) as phones, min(call_date) as first_date, max(call_date) as last_date, round(count(*) / sum(count(*)) over (), 4) as share from matched group by 1", calls=CALLS, contact=CONTACT)
def bucket_summary(calls, contact):
    by = calls_matched(calls, contact).groupBy("match_type", "normalized_phone").agg(F.count("*").alias("n"), F.min("call_date").alias("a"), F.max("call_date").alias("b"))
    out = by.groupBy("match_type").agg(F.sum("n").alias("n"), F.count("*").alias("phones"), F.min("a").alias("first_date"), F.max("b").alias("last_date"))
    return with_share(out)


_FP = "call_date || '|' || call_staff || '|' || left(content, 80) as fp"
_SIDES = f", a as (select *, {_FP} from calls where row_index % 2 = 0), b as (select *, {_FP} from calls where row_index % 2 = 1)"


def sides(calls):
    return calls.where("row_index % 2 = 0"), calls.where("row_index % 2 = 1")


@query(_SIDES + ", s as (select *, fp in (select fp from a) as strict_dup from b) select row_index, strict_dup, not strict_dup and exists (select 1 from a where a.call_date = s.call_date and a.call_staff = s.call_staff and a.fp <> s.fp) as loose_dup from s", calls=CALLS)
def cross_source_duplicates(calls):
    return audit.mark_cross_source(*sides(calls)).select("row_index", "strict_dup", "loose_dup")


@query(_SIDES + ", x as (select distinct fp from a), y as (select distinct fp from b), j as (select x.fp as p, y.fp as q from x full join y on x.fp = y.fp) select count(p) as a_keys, count(q) as b_keys, count(*) filter (p is not null and q is not null) as shared, count(*) filter (q is null) as a_only, count(*) filter (p is null) as b_only, round(count(*) filter (p is not null and q is not null) / count(*), 4) as shared_rate from j", calls=CALLS)
def cross_source_overlap(calls):
    return audit.overlap(*sides(calls), hashing.cross_source_key(F.col("call_date"), F.col("call_staff"), F.col("content")))


@query("select o.o_orderkey, o.o_custkey from orders o where not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_custkey % 10 <> 0)")
def orphan_check(spark, sf_dir):
    thin = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(thin, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


_CHECKS = """
select 'orders' as name, count(*) as n, case when count(*) = count(distinct o_orderkey) then 'OK' else 'MISMATCH' end as verdict from {orders}
union all select 'customer', count(*), case when count(*) = count(distinct c_custkey) then 'OK' else 'MISMATCH' end from {customer}
union all select 'lineitem_keys', count(*), case when count(*) = 0 then 'OK' else 'MISMATCH' end from (select l_orderkey, l_linenumber from {lineitem} group by l_orderkey, l_linenumber having count(*) > 1) d
union all select 'orders_without_customer', count(*), case when count(*) = 0 then 'OK' else 'MISMATCH' end from {orders} o where not exists (select 1 from {customer} c where c.c_custkey = o.o_custkey)
"""


@query("select * from checks", checks=_CHECKS)
def postcheck_suite(checks):
    return checks


def _postcheck_suite(spark, sf_dir):
    """The same checks as DataFrame operations."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    repeated = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    lost = o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    return checks_of.matched({"orders": (o, F.count_distinct("o_orderkey")), "customer": (c, F.count_distinct("c_custkey")), "lineitem_keys": (repeated, 0), "orders_without_customer": (lost, 0)})


_QUERIES["postcheck_suite"] = _postcheck_suite


_CHANGED = "select o_orderkey as row_index, o_custkey, o_orderstatus, case when o_orderkey % 9 = 0 then 'changed' else o_orderpriority end as o_orderpriority from {orders} where o_orderkey % 31 <> 0"
_PLAIN = "select o_orderkey as row_index, o_custkey, o_orderstatus, o_orderpriority from {orders}"


@query("select coalesce(x.o_custkey, y.o_custkey) as o_custkey, coalesce(a_rows, 0) as a_rows, coalesce(b_rows, 0) as b_rows from (select o_custkey, count(*) as a_rows from a group by 1) x full join (select o_custkey, count(*) as b_rows from b group by 1) y on x.o_custkey = y.o_custkey where coalesce(a_rows, 0) <> coalesce(b_rows, 0)", a=_PLAIN, b=_CHANGED)
def rows_per_key_diff(a, b):
    return audit.rows_per_key_diff(a, b, "o_custkey")


@query("select u.field as field, count(*) as rows, count(*) filter (u.same) as matches, round(avg(cast(u.same as int)), 4) as match_rate, min(case when not u.same then row_index end) as first_difference from (select row_index, unnest([{'field': 'o_custkey', 'same': a.o_custkey = b.o_custkey}, {'field': 'o_orderstatus', 'same': a.o_orderstatus = b.o_orderstatus}, {'field': 'o_orderpriority', 'same': a.o_orderpriority = b.o_orderpriority}]) as u from a join b using (row_index)) group by 1", a=_PLAIN, b=_CHANGED)
def positional_compare(a, b):
    return audit.positional_compare(a, b, ["o_custkey", "o_orderstatus", "o_orderpriority"])


_DICTIONARY = "dict as (select o_orderpriority as value, count(*) as n, array_to_string(list_slice(list_sort(list(o_orderkey)), 1, 3), ';') as sample_ids, round(count(*) / sum(count(*)) over (), 4) as share from orders group by 1)"


@query(f"with {_DICTIONARY} select * from dict")
def status_dictionary(spark, sf_dir):
    return audit.dictionary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey").select("value", "n", "sample_ids", "share")


_STAGES = {"1-URGENT": ("urgent", "high"), "2-HIGH": ("high", "high"), "3-MEDIUM": ("normal", "medium"), "5-LOW": ("low", "low")}
_WEIGHT = "case coalesce(s.c, 'low') when 'high' then 1 when 'medium' then 2 else 3 end"


@query(f"with {_DICTIONARY}, stages(v, g, c) as (values " + ", ".join(f"('{k}', '{g}', '{c}')" for k, (g, c) in _STAGES.items()) + f") select value, n, case when s.c = 'high' then s.g when s.c is not null then s.g || '?' else 'unresolved' end as stage, n * {_WEIGHT} as impact, cast(row_number() over (order by n * {_WEIGHT} desc, value) as int) as priority_rank from dict left join stages s on s.v = value")
def status_impact_rank(spark, sf_dir):
    d = audit.dictionary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")
    stages = d.sparkSession.createDataFrame([(k, *v) for k, v in _STAGES.items()], "value string, stage string, certainty string")
    return decisions.stage_impact(d, stages).select("value", "n", "stage", "impact", "priority_rank")


@query("select o_orderstatus, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as share from orders group by 1")
def share_of_total(spark, sf_dir):
    return with_share(table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))


@query("select row_index, customer_name, phone, '' as company_name, 'a' as _source_file from contact where row_index % 3 = 0 union all select row_index, customer_name, '', company_name, 'b' from contact where row_index % 3 = 1 union all select row_index, '', phone, company_name, 'c' from contact where row_index % 3 = 2", contact=CONTACT)
def multi_file_union(c):
    a = core.rename(c.where("row_index % 3 = 0").select("row_index", F.col("customer_name").alias("氏名"), F.col("phone").alias("TEL")), {"氏名": "customer_name", "TEL": "phone"})
    b = c.where("row_index % 3 = 1").select("row_index", "customer_name", "company_name")
    d = c.where("row_index % 3 = 2").select("row_index", "phone", "company_name")
    out = core.union_files(*[x.withColumn("_source_file", F.lit(n)) for x, n in ((a, "a"), (b, "b"), (d, "c"))])
    return out.select("row_index", "customer_name", "phone", "company_name", "_source_file")


_RUNS = "select o_orderkey as run_id, o_custkey as source, o_orderpriority as profile, o_orderdate as started_at, cast(floor(o_totalprice / 1000) as bigint) as row_count, o_orderstatus as schema_fp from {orders}"
_RUN_PAIRS = ", pairs as (select *, coalesce(last_value(run_id) over (partition by source, profile order by started_at, run_id rows between unbounded preceding and 1 preceding), last_value(run_id) over (partition by source order by started_at, run_id rows between unbounded preceding and 1 preceding)) as previous_run from runs)"


@query(_RUN_PAIRS + " select run_id, previous_run from pairs", runs=_RUNS)
def comparable_run(runs):
    return audit.latest_before(runs).select("run_id", "previous_run")


@query(_RUN_PAIRS + " select p.run_id, case when p.previous_run is null then 'first_import' when o.schema_fp <> p.schema_fp then 'schema_changed' when o.profile <> p.profile then 'profile_changed' when o.row_count <> p.row_count then 'row_count_changed' else 'same_content' end as change, p.row_count - o.row_count as row_delta from pairs p left join runs o on o.run_id = p.previous_run", runs=_RUNS)
def run_diff(runs):
    return decisions.run_diff(runs)


_FAMILY = "select page_id, lower(url) as name from {pages}"
_WEIGHTS = {"blog": ("news", 2.0), "example.com": ("shop", 1.5), "/en/": ("shop", 0.5), "example.net": ("news", 1.0), "/fr/": ("news", 0.5)}


@query("select page_id, coalesce(max_by(family, (score, family)), 'unknown') as family, cast(coalesce(max(score), 0) as double) as score from (select page_id, family, sum(weight) as score from names join (values " + ", ".join(f"('{k}', '{f}', {w})" for k, (f, w) in _WEIGHTS.items()) + ") w(word, family, weight) on contains(name, word) group by 1, 2 having sum(weight) >= 1.5) right join names using (page_id) group by 1", names=_FAMILY)
def family_detection(names):
    return decisions.detect_family(names, _WEIGHTS, 1.5).select("page_id", "family", "score")


_TEMPLATES = "select page_id, regexp_replace(url, '[?#].*', '') as url from {pages}"


@query("select page_id, len(parts) as n, round(len(list_intersect(parts, ['http:', 'en', 'blog'])) / len(list_distinct(list_concat(parts, ['http:', 'en', 'blog']))), 4) as jaccard, round(0.2 * len(list_intersect(parts, ['http:', 'en', 'blog'])) / len(list_distinct(list_concat(parts, ['http:', 'en', 'blog']))) + case when len(parts) = 3 then 0.1 else 0 end, 4) as score from (select page_id, list_distinct(list_filter(regexp_split_to_array(url, '[/.]'), lambda x: x <> '')) as parts from t)", t=_TEMPLATES)
def template_match(t):
    parts = F.array_distinct(F.filter(F.split("url", "[/.]"), lambda x: x != ""))
    return decisions.match_template(t.withColumn("parts", parts), ["http:", "en", "blog"])


_RES = "select c_custkey as id, concat('col', cast(c_custkey % 50 as string)) as context, case when c_custkey % 4 = 0 then 'global' else concat('f', cast(c_nationkey % 3 as string)) end as family, case when c_custkey % 3 = 0 then 'column_ignore' else 'column_canonical' end as kind, case when c_custkey % 5 = 0 then 'low' when c_custkey % 5 < 3 then 'high' else 'confirmed' end as certainty, c_custkey % 7 = 0 as deleted from {customer}"
_ASKS = "select s_suppkey as ask_id, concat('col', cast(s_suppkey % 60 as string)) as context, concat('f', cast(s_nationkey % 3 as string)) as family from {supplier}"


@query("select ask_id, arg_min(id, (case when r.kind = 'column_ignore' then 0 else 1 end, case when r.family = a.family then 0 else 1 end, id)) as decision, coalesce(arg_min(kind, (case when r.kind = 'column_ignore' then 0 else 1 end, case when r.family = a.family then 0 else 1 end, id)), 'unresolved') as kind from asks a left join (select * from memory where not deleted and certainty in ('confirmed', 'high')) r on r.context = a.context and r.family in (a.family, 'global') group by 1", memory=_RES, asks=_ASKS.replace("{supplier}", "(select c_custkey as s_suppkey, c_nationkey as s_nationkey from {customer}) x"))
def auto_apply_resolution(memory, asks):
    return decisions.auto_apply(asks, memory)


@query("select a.id as a, b.id as b, cast(levenshtein(a.name, b.name) as int) as distance from n a join n b on a.id < b.id and abs(length(a.name) - length(b.name)) <= 2 where levenshtein(a.name, b.name) <= 2", n="select min(c_custkey) as id, c_name as name from {customer} group by c_name")
def soft_dedupe_levenshtein(n):
    """All names are compared, not those alone that begin alike."""
    return audit.close_names(n, "id", "name")


_KNOWN = [
    decisions.Profile("blog", files=("blog*",), columns=(("blog", "weblog"), ("http:", "https:"), ("com",)), family="f1"),
    decisions.Profile("shop", files=("shop*", "*.example.net"), columns=(("shop",), ("https:",), ("item",), ("en",)), column_count=5, headerless_suitable=True),
    decisions.Profile("list", columns=(("https:",), ()), column_count=6, default_has_header=False, family="f2"),
]
_FILES = "select page_id, lower(url) as url, page_id % 4 = 0 as headerless, case when page_id % 9 = 0 then 'f1' when page_id % 9 = 1 then 'f2' end as family from {pages}"
_SPREAD = "case when {n} > 0 then case abs({n} - {e}) when 0 then 25 when 1 then 15 when 2 then 8 else 0 end else 0 end"
_HAS = "cast(list_has_any(parts, [{0}]) as int)"


@query(
    "select page_id, p.name as profile, coalesce(p.score, 0) as score, case when p.score >= 100 then 'high' when p.score >= 30 then 'medium' when p.score > 0 then 'low' else 'none' end as confidence from (select page_id, list_max(list_filter(["
    f"{{'score': cast(case when regexp_matches(host, '^blog') then 100 else 0 end + case when headerless then 0 else round(({_HAS.format("'blog', 'weblog'")} + {_HAS.format("'http:', 'https:'")} + {_HAS.format("'com'")}) / 3.0 * 50) end + {_SPREAD.format(n='len(parts)', e=3)} + case when family = 'f1' then 80 else 0 end as int), 'o': 0, 'name': 'blog'}}, "
    f"{{'score': cast(case when regexp_matches(host, '^shop|[.]example[.]net$') then 100 else 0 end + case when headerless then 20 else round(({_HAS.format("'shop'")} + {_HAS.format("'https:'")} + {_HAS.format("'item'")} + {_HAS.format("'en'")}) / 4.0 * 50) end + {_SPREAD.format(n='len(parts)', e=5)} as int), 'o': -1, 'name': 'shop'}}, "
    f"{{'score': cast(case when headerless then 10 else round({_HAS.format("'https:'")} / 2.0 * 50) end + {_SPREAD.format(n='len(parts)', e=6)} + case when family = 'f2' then 80 else 0 end as int), 'o': -2, 'name': 'list'}}"
    "], lambda s: s.score > 0)) as p from (select *, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) as host, list_filter(regexp_split_to_array(url, '[/.]'), lambda x: x <> '') as parts from files))",
    files=_FILES,
)
def profile_match(files):
    parts = F.filter(F.split("url", "[/.]"), lambda x: x != "")
    named = files.withColumns({"file": F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1), "columns": parts}).withColumn("column_count", F.size("columns"))
    return decisions.match_profile(named, _KNOWN).select("page_id", "profile", "score", "confidence")


_IMPORTS = "select o_orderkey as run_id, o_custkey as source, case when o_orderstatus = 'P' then 'failed' else 'completed' end as status, o_orderdate as started_at, case when o_orderkey % 3 = 0 then 'x' else o_orderpriority end as file_fp, o_orderstatus as schema_fp, cast(o_orderkey % 2 + 10 as int) as column_count from {orders}"


@query(
    ", placed as (select *, last_value(case when status = 'completed' then run_id end ignore nulls) over (partition by source order by started_at, run_id rows between unbounded preceding and 1 preceding) as previous_run from runs), "
    "seen as (select p.run_id, p.previous_run, p.column_count - o.column_count as column_delta, case when p.previous_run is null then 'first_import' when o.file_fp = p.file_fp then 'same_file' when o.column_count <> p.column_count or o.schema_fp <> p.schema_fp then 'column_changed' else 'row_changed' end as change from placed p left join runs o on o.run_id = p.previous_run) "
    "select *, change = 'same_file' as duplicate_warning, change = 'column_changed' as schema_drift from seen",
    runs=_IMPORTS,
)
def pre_run_diff(runs):
    return decisions.pre_run_diff(runs)


@query("select coalesce(x.k, y.k) as o_custkey, case when y.k is null then 'a' else 'b' end as side from (select distinct o_custkey as k from orders) x full join (select c_custkey as k from customer where c_custkey % 10 <> 0) y on x.k = y.k where x.k is null or y.k is null")
def id_set_difference(spark, sf_dir):
    thin = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return audit.id_differences(table(spark, sf_dir, "orders"), thin, "o_custkey")


@contact_query(
    f"{_CELLS}, kinds as (select field, case {_TYPE_CASE} else 'text' end as k from cells), types as (select f.field, case when count(k) = 0 then 'empty' " + " ".join(f"when count(*) filter (k = '{t}') / count(*) > 0.6 then '{t}'" for t in ("date", "phone", "email", "number", "boolean")) + f" else 'text' end as type from {_FIELDS} f left join kinds c on c.field = f.field group by 1), "
    f"rates as (select f.field, coalesce(sum(n), 0) / (select count(*) from normalized) as filled, coalesce(count(n) / nullif(sum(n), 0), 0) as uniq from {_FIELDS} f left join counted c on c.field = f.field group by 1) "
    "select field, round(filled, 4) as non_empty_rate, round(uniq, 4) as unique_rate, type, filled > 0.95 and uniq > 0.8 as key_candidate, type = 'date' as date_candidate, type = 'phone' as phone_candidate from rates join types using (field)"
)
def dataset_profile(n):
    return audit.dataset_profile(n, _PROFILED)


# --- review sheets ---------------------------------------------------------------------------------------------------


@query(
    _MATCHED + ", parts as (select ids, unnest(ids) as id from (select distinct ids from matched where is_hit)), named as (select ids, string_agg(coalesce(nullif(c.customer_name, ''), '?'), ' / ' order by id) as names from parts left join contact c on c.row_index = id group by 1) "
    "select m.row_index, n.names from matched m left join named n on m.is_hit and m.ids = n.ids",
    calls=CALLS,
    contact=CONTACT,
)
def candidate_enrichment(calls, contact):
    return reviews.enriched(calls_matched(calls, contact), "candidates", contact, "row_index", F.col("customer_name"), "names").select("row_index", "names")


_HIGH = _QUEUE + ", high as (select normalized_phone, count(*) as call_count, min(row_index) as first_row, array_to_string(arg_min(ids, row_index), ';') as candidates, cast(arg_min(found, row_index) as int) as candidate_count from queue where severity = 'high' group by 1)"


@query(_HIGH + " select printf('HR-%04d', row_number() over (order by first_row, normalized_phone)) as review_id, normalized_phone, candidates, candidate_count, call_count, '' as decision_status from high", calls=CALLS, contact=CONTACT)
def manual_resolution_template(calls, contact):
    return reviews.resolution_template(audit.review_queue(calls_matched(calls, contact))).drop("chosen_customer_id", "chosen_strategy", "note")


def answered(queue):
    """The high-severity numbers with answers that follow from their last digit."""
    digit = F.right("normalized_phone", F.lit(1))
    numbers = queue.where("severity = 'high'").groupBy("normalized_phone").agg(F.min("row_index").alias("review_id"), F.min("candidates").alias("candidates"))
    return numbers.select("normalized_phone", "review_id", F.when(digit < "6", "resolved").otherwise("defer").alias("decision_status"), F.when(digit.isin("0", "2", "4", "6", "8"), "assign_all").otherwise("split").alias("chosen_strategy"), F.split("candidates", ";")[0].alias("chosen_customer_id"))


_ANSWERED = _HIGH + ", answers as (select normalized_phone, split_part(candidates, ';', 1) as chosen from high where right(normalized_phone, 1) in ('0', '2', '4'))"


@query(
    _ANSWERED + " select row_index, case when chosen is not null then 'manual_resolved' else match_type end as match_type, case when chosen is not null then chosen when match_type in ('exact', 'normalized') then cast(ids[1] as varchar) end as matched_customer_id, case when chosen is not null then 1 when is_hit then cast(found as int) else 0 end as candidate_count "
    "from (select m.*, case when m.match_type = 'multi_match' and m.row_index % 2 = 0 then a.chosen end as chosen from matched m left join answers a using (normalized_phone))",
    calls=CALLS,
    contact=CONTACT,
)
def manual_resolution_applied(calls, contact):
    m = calls_matched(calls, contact)
    return reviews.apply_resolutions(m, answered(audit.review_queue(m)), F.col("row_index") % 2 == 0).select("row_index", "match_type", "matched_customer_id", "candidate_count")


_SHEET = """select concat('R', cast(c_custkey as string)) as review_id,
  case c_custkey % 6 when 1 then 'skip' when 2 then '' when 3 then 'done' else 'resolved' end as decision_status,
  case c_custkey % 5 when 0 then 'assign_all' when 1 then 'assign_by_date' when 2 then '' when 3 then 'merge' else 'split' end as chosen_strategy,
  case when c_custkey % 7 = 0 then ' ' else concat('C', cast(c_custkey % 3 as string)) end as chosen_customer_id,
  case when c_custkey % 11 = 0 then '' else 'C1; C2 ;' end as candidate_customer_ids,
  case when c_custkey % 4 = 0 then 'from 2024' else '' end as note,
  case when c_custkey % 8 = 0 then '' else 'yes' end as answer,
  case when c_custkey % 9 < 4 then '' else 'waiting' end as confirmed_stage,
  case when c_custkey % 10 < 5 then ' ' else 'staff' end as confirmed_by from {customer}"""


def _fault(when, severity, field, code):
    return f"case when {when} then {{'severity': '{severity}', 'field': '{field}', 'code': '{code}'}} end"


_UNKNOWN = _fault("decision_status not in ('resolved', 'skip', 'unclear', 'defer', '')", "error", "decision_status", "unknown_value")
_FAULTS = {
    "packet": [
        _UNKNOWN,
        _fault("decision_status = 'resolved' and trim(chosen_customer_id) = ''", "error", "chosen_customer_id", "resolved_without_customer"),
        _fault("decision_status = 'resolved' and trim(chosen_customer_id) <> '' and candidate_customer_ids <> '' and chosen_customer_id not in ('C1', 'C2')", "warning", "chosen_customer_id", "not_a_candidate"),
        _fault("decision_status = ''", "info", "decision_status", "open"),
    ],
    "template": [
        _UNKNOWN,
        _fault("chosen_strategy not in ('assign_all', 'assign_by_date', 'split', '')", "error", "chosen_strategy", "unknown_value"),
        _fault("decision_status = 'resolved' and chosen_strategy = ''", "warning", "chosen_strategy", "resolved_without_strategy"),
        _fault("chosen_strategy = 'assign_by_date' and note = ''", "warning", "note", "dates_missing"),
    ],
    "hearing": [
        _fault("answer <> '' and confirmed_stage = ''", "warning", "confirmed_stage", "answer_without_stage"),
        _fault("confirmed_stage <> '' and trim(confirmed_by) = ''", "warning", "confirmed_by", "stage_without_name"),
    ],
}


@query(" union all ".join(f"select '{name}' as file, review_id, u.severity as severity, u.field as field, u.code as code from (select review_id, unnest([{', '.join(rules)}]) as u from sheet) where u is not null" for name, rules in _FAULTS.items()), sheet=_SHEET)
def human_input_issues(sheet):
    found = {"packet": reviews.packet_issues(sheet), "template": reviews.template_issues(sheet), "hearing": reviews.hearing_issues(sheet.withColumnRenamed("review_id", "status_value")).withColumnRenamed("status_value", "review_id")}
    packet, template, hearing = (df.withColumn("file", F.lit(name)) for name, df in found.items())
    return packet.unionByName(template).unionByName(hearing)


@query(
    "select count(*) as packet_rows, count(*) as template_rows, count(*) filter (decision_status = 'resolved') as resolved, count(*) filter (confirmed_stage <> '') as confirmed, case when count(*) = 0 then 'NO-GO' else 'CONDITIONAL-GO' end as verdict, case when count(*) = 0 then 'input_missing' when count(*) filter (decision_status = 'resolved' or confirmed_stage <> '') = 0 then 'no_answers' else 'some_answers' end as reason from sheet",
    sheet=_SHEET,
)
def go_no_go(sheet):
    return reviews.verdict(sheet, sheet, sheet)


@query(
    "with d as (select o_orderpriority as value, count(*) as n, list_slice(list_sort(list(distinct o_custkey)), 1, 3) as ids from orders group by 1), "
    "s as (select *, case value when '1-URGENT' then 'waiting' when '3-MEDIUM' then 'on_hold?' when '5-LOW' then 'in_progress' else 'unresolved' end as stage from d where value <> '2-HIGH') "
    "select value, n, stage, (select string_agg(c.c_name, ' / ' order by c.c_custkey) from customer c where list_contains(s.ids, c.c_custkey)) as samples, case stage when 'waiting' then 'waiting_before_work' when 'on_hold?' then 'stopped' when 'in_progress' then 'under_way' else 'unknown' end as hypothesis from s"
)
def status_hearing_sheet(spark, sf_dir):
    known = {"1-URGENT": "waiting", "3-MEDIUM": "on_hold?", "5-LOW": "in_progress"}
    d = audit.dictionary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey").where("value <> '2-HIGH'")
    stage = F.element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]), F.col("value"))
    sheet = reviews.hearing_sheet(d.withColumn("stage", F.coalesce(stage, F.lit("unresolved"))), table(spark, sf_dir, "customer"), "c_custkey", F.col("c_name"))
    return sheet.select("value", "n", "stage", "samples", "hypothesis")


_LOADS = "select row_index, case when row_index % 13 = 0 then 'source_c' when row_index % 2 = 0 then 'source_a' else 'source_b' end as source_kind, case when row_index % 5 = 0 then '' else call_date end as call_date, case when row_index % 15 = 0 then ' ' else content end as content from (" + CALLS + ") k"


@query("select row_index, case when source_kind = 'source_c' then 'bad_source_kind' else 'no_date_and_content' end as reject_reason from calls where source_kind = 'source_c' or (call_date = '' and trim(content) = '')", calls=_LOADS)
def load_rejects(calls):
    return reviews.load_rejects(calls).select("row_index", "reject_reason")


from tallyloom.plans import flows, stores  # noqa: E402, F401  register their queries
