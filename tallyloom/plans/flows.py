"""Queries of the plan from files to packs, of routing, suggestions and checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import hashing, similarity, text
from tallyloom.operators import audit, checks, core, flow, reviews, routing, suggest
from tallyloom.operators.decisions import Profile
from tallyloom.operators.settle import settled
from tallyloom.plans import duck
from tallyloom.plans.catalogue import _CELLS, _FIELDS, _IDENTITY as _IDENTIFIED, _KEYS as _MATCH_KEYS, _MATCHED, _NONE, _PROFILED, _QUEUE, _RUNS, _SAFE, _SQL, CALLS, calls_matched, contact_query, identified, query, sides, table
from tallyloom.plans.views import CONTACT, FILES, FLOW, HEADERS

# --- from files to packs ---------------------------------------------------------------------------------------------

_CHILD = "履歴::内容"
_MAIN = flow.Source("in/mixed.csv", batch="b2", mainline=True, mixed=True, mapping={"memo": "note"}, strategy=core.Strategy(family="customer_master_like"))
_OLD = flow.Source("in/old.csv", key="old", batch="b0")

_LINES = " || chr(10) || ".join(f"'{c}=' || {c}" for c in ("address", "customer_id", "customer_name", "note", "phone")) + f" || chr(10) || '{_CHILD}=' || history"
_FIXED = "array_to_string(list_filter([case when customer_name <> '' then 'customer_name=' || customer_name end, case when phone <> '' then 'phone=' || phone end], lambda x: x is not null), '|')"
_ROWS = f""", filed as (select *, row_index % 7 <> 3 as main from flow),
kinds as (select *, case when not main then 'not_applicable' when {_SAFE} then 'parent_candidate' when history <> '' and {_NONE} then 'child_continuation' else 'ambiguous_parent' end as parent,
  case when not main then 'not_mixed' when {_SAFE} then 'strong_parent_signals' when history <> '' and {_NONE} then 'child_columns_only' else 'insufficient_parent_signals' end as parent_reason,
  main and history <> '' as has_child, case when main then 'in/mixed.csv' else 'in/old.csv' end as file, case when main then 'mixed.csv' else 'old' end as source_key, case when main then 'customer_master_like' else 'unknown' end as family,
  {_FIXED} as fixed, sha256({_LINES}) as full_fp, sha256('address=' || address || chr(10) || 'customer_name=' || customer_name || chr(10) || 'phone=' || phone) as main_fp,
  case when customer_name <> '' or phone <> '' then 'customer_like' else 'unknown' end as owner from filed),
named as (select *, case when main then main_fp else full_fp end as fp, case when fixed <> '' then 'deterministic' else 'fallback' end as method,
  case when fixed <> '' then sha256('deterministic' || chr(0) || family || chr(0) || fixed) else sha256('fallback' || chr(0) || family || chr(0) || full_fp) end as record_key,
  case when parent = 'child_continuation' then 'CHILD_CONTINUATION' when parent = 'ambiguous_parent' then '' when customer_id = '' and customer_name = '' and phone = '' and address = '' and history = '' and note = '' then 'ALL_COLUMNS_EMPTY' when customer_name = '' and phone = '' then 'BUSINESS_KEY_EMPTY' else '' end as gone from kinds),
judged as (select *, case when not main then 'archive_mode' when parent = 'ambiguous_parent' then 'mixed_parent_child_ambiguous' when parent <> 'parent_candidate' then 'mixed_parent_child_export' when method = 'fallback' then 'fallback_key' when owner = 'unknown' then 'semantic_owner_unknown' else '' end as why from named),
bad as (select record_key from judged where gone = '' and method = 'deterministic' group by 1 having count(distinct fp) > 1),
done as (select j.* exclude (why), case when b.record_key is not null and gone = '' then 'deterministic_collision' else why end as why from judged j left join bad b using (record_key)),
rows as (select *, case when why = '' then 'mainline_ready' when why = 'archive_mode' then 'archive_only' else 'review' end as eligibility from done),
ready as (select *, sha256(source_key || chr(0) || record_key) as ledger_key from rows where gone = '' and main and eligibility = 'mainline_ready'),
ledger as (select ledger_key, max_by(fp, row_index) as fp, case when max(row_index) % 2 = 0 then 'b2' else 'b1' end as batch, 'r1' as last_run from ready where row_index % 5 = 0 group by 1),
before as (select r.*, l.fp as lfp, l.batch as lbatch from ready r left join ledger l using (ledger_key)),
prev as (select *, coalesce(lag(fp) over (partition by ledger_key order by row_index), lfp) as p from before),
changed as (select *, p is null or p <> fp as c from prev),
batches as (select *, case when coalesce(max(cast(c as int)) over (partition by ledger_key order by row_index rows between unbounded preceding and 1 preceding), 0) = 1 then 'b2' else lbatch end as eb from changed),
merged as (select *, case when p is null then 'inserted' when p <> fp then 'updated' when eb = 'b2' then 'duplicate' else 'unchanged' end as d from batches),
final as (select r.*, case when gone <> '' then 'quarantine' when not r.main then 'archive_only' else coalesce(m.d, 'review') end as disposition,
  case when gone <> '' then gone when not r.main then 'archive_mode' when m.d is null then case when r.why <> '' then r.why else 'review_hold' end else case m.d when 'inserted' then 'new_identity' when 'updated' then 'existing_changed_fingerprint' when 'duplicate' then 'same_batch_same_fingerprint' else 'existing_same_fingerprint' end end as disposition_reason
  from rows r left join (select row_index, d from merged) m using (row_index))"""


def normalized(f):
    """The rows of two files, a mixed export that is merged and an old one that is archived."""
    f = f.withColumnsRenamed({"history": _CHILD, "note": "memo"})
    old = f.where("row_index % 7 = 3").withColumnRenamed("memo", "note")
    return flow.normalize_files([(f.where("row_index % 7 <> 3"), _MAIN), (old, _OLD)], "r2")


def run(f):
    rows = normalized(f)
    ready = rows.where(flow.gate() & (F.col("row_index") % 5 == 0)).withColumn("ledger_key", flow.ledger_key(F.col("_source_key"), F.col("_source_record_key")))
    ledger = ready.groupBy("ledger_key").agg(F.max_by("_structural_fingerprint", "row_index").alias("fp"), F.when(F.max("row_index") % 2 == 0, "b2").otherwise("b1").alias("batch"), F.lit("r1").alias("last_run"))
    return flow.merged(rows, ledger, "r2")


_OUT = {"_source_key": "source_key", "_parent": "parent", "_source_record_key": "record_key", "_source_record_key_method": "method", "_structural_fingerprint": "fp", "_merge_eligibility": "eligibility", "_quarantine_reason": "gone", "_review_reason": "why", "_final_disposition": "disposition", "_final_disposition_reason": "disposition_reason"}


@query(_ROWS + " select row_index, " + ", ".join(_OUT.values()) + " from final", flow=FLOW)
def normalize_files(f):
    return run(f)[0].select("row_index", *[F.col(k).alias(v) for k, v in _OUT.items()])


@query(_ROWS + " select ledger_key, fp, batch, last_run from (select ledger_key, max_by(fp, row_index) as fp, case when max(cast(c as int)) = 1 then 'b2' else max(lbatch) end as batch, 'r2' as last_run from merged group by 1) union all select * from ledger where ledger_key not in (select ledger_key from ready)", flow=FLOW)
def files_ledger(f):
    return run(f)[1]


@query(_ROWS + " select file as _source_file, count(*) as input_rows, count(*) filter (gone = '') as normalized_rows, count(*) filter (gone <> '') as quarantine_rows, count(*) filter (has_child) as rows_with_child_data, count(*) filter (parent = 'parent_candidate') as parent_candidates, count(*) filter (parent = 'ambiguous_parent') as ambiguous_parents, count(*) filter (parent = 'child_continuation') as child_continuations, count(*) filter (has_child and parent <> 'child_continuation') as mixed_rows from final group by 1", flow=FLOW)
def row_flow(f):
    return flow.row_flow(normalized(f))


@query(_ROWS + " select parent as kind, parent_reason as reason, count(*) as n from final group by 1, 2", flow=FLOW)
def parent_summary(f):
    return flow.parent_summary(normalized(f))


def _zeros():
    one = lambda name, values: [f"('{name}', '{v}', '')" for v in values]
    two = lambda name, x, y: [f"('{name}', '{a}', '{b}')" for a in x for b in y]
    every = one("parent", flow.PARENTS) + one("eligibility", flow.STAGES) + one("disposition", flow.DISPOSITIONS)
    return ", ".join(every + two("parent_eligibility", flow.PARENTS, flow.STAGES) + two("parent_disposition", flow.PARENTS, flow.DISPOSITIONS) + two("eligibility_disposition", flow.STAGES, flow.DISPOSITIONS))


_STAGE = "case when gone <> '' then 'quarantine' else eligibility end"
_COUNTS = [("parent", "parent", "''"), ("eligibility", _STAGE, "''"), ("disposition", "disposition", "''"), ("reason", "disposition_reason", "''"), ("parent_eligibility", "parent", _STAGE), ("parent_disposition", "parent", "disposition"), ("eligibility_disposition", _STAGE, "disposition"), ("disposition_reason", "disposition", "disposition_reason")]


@query(_ROWS + f", zeros(name, a, b) as (values {_zeros()}), counted as (" + " union all ".join(f"select '{n}' as name, {a} as a, {b} as b, count(*) as n from final group by 2, 3" for n, a, b in _COUNTS) + ") select coalesce(z.name, c.name) as name, coalesce(z.a, c.a) as a, coalesce(z.b, c.b) as b, coalesce(n, 0) as n from zeros z full join counted c on z.name = c.name and z.a = c.a and z.b = c.b", flow=FLOW)
def count_reconciliation(f):
    return flow.reconciliation(run(f)[0])


_IDENTITY = _ROWS + ", counts as (select u.name as name, u.value as value, count(*) as n from (select unnest([{'name': 'reason', 'value': nullif(why, '')}, {'name': 'eligibility', 'value': eligibility}, {'name': 'owner', 'value': owner}, {'name': 'method', 'value': method}, {'name': 'family', 'value': family}, {'name': 'review_method', 'value': case when eligibility = 'review' then method end}, {'name': 'review_family', 'value': case when eligibility = 'review' then family end}, {'name': 'review_owner', 'value': case when eligibility = 'review' then owner end}]) as u from final where gone = '') where u.value is not null group by 1, 2)"
_TOPS = ", both_ as (select 'reasons' as name, value, n from counts where name = 'reason' union all select 'indicators', value, n from counts where name = 'reason' union all select 'indicators', 'fallback_method_review', n from counts where name = 'review_method' and value = 'fallback'), tops as (select name, cast(row_number() over (partition by name order by n desc, value) as int) as place, value, n from both_)"
_RATIOS = ", ratios as (select t.name, t.value, coalesce(r.n, 0) as review_rows, t.n, round(coalesce(r.n, 0) / t.n, 4) as review_ratio, cast(row_number() over (partition by t.name order by coalesce(r.n, 0) / t.n desc, coalesce(r.n, 0) desc, t.value) as int) as place from counts t left join counts r on r.name = 'review_' || t.name and r.value = t.value where t.name in ('family', 'method'))"


@query(_IDENTITY + " select * from counts", flow=FLOW)
def identity_breakdowns(f):
    return flow.identity_counts(normalized(f))


@query(_IDENTITY + _TOPS + " select * from tops where place <= 5", flow=FLOW)
def identity_tops(f):
    return flow.identity_tops(normalized(f))


@query(_IDENTITY + _RATIOS + " select * from ratios", flow=FLOW)
def review_ratios(f):
    return flow.review_ratios(normalized(f))


@query(_IDENTITY + _TOPS + _RATIOS + ", targets(reason, target) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in flow.TARGETS.items()) + ") select distinct 'target' as kind, target as value from tops join targets on reason = value where name = 'reasons' and place <= 3 union all select 'review_heavy_' || name, value from ratios where place = 1 and review_ratio >= 0.5", flow=FLOW)
def tuning_hints(f):
    return flow.tuning_hints(normalized(f))


@query(_ROWS + ", names(d, value) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in flow.MERGE_COUNTS.items()) + ") select value, count(row_index) as n from names left join final on disposition = d group by 1", flow=FLOW)
def merge_summary(f):
    return flow.merge_summary(run(f)[0])


@query(_ROWS + " select regexp_extract(file, '[^/]*$') || ': merge eligibility=' || eligibility || ' reason=' || why as warning, count(*) as n from final where main and disposition = 'review' group by 1", flow=FLOW)
def merge_warnings(f):
    return flow.merge_warnings(run(f)[0])


@query(_ROWS + ", packed as (select *, case when disposition in ('review', 'pending') then 'review' when disposition = 'quarantine' then 'quarantine' else 'mainline' end as pack from final) select row_index, pack, row_number() over (partition by pack order by disposition, disposition_reason, parent, file, source_key, record_key, full_fp, cast(row_index as varchar)) as place from packed", flow=FLOW)
def pack_order(f):
    return flow.pack_rows(run(f)[0], ["row_index"]).select("row_index", "pack", "place")


_RULE = flow.DiffRule(record_id="customer_id", updated_at="note", natural=("customer_name", "phone"), fingerprint=("address", "history"))


@query("select row_index, case when customer_id <> '' then 'rid:' || customer_id when customer_name <> '' and phone <> '' then 'natural:customer_name=' || customer_name || '|phone=' || phone else 'fp:' || sha256('address=' || address || chr(10) || 'history=' || history) end as identity_key, case when customer_id <> '' and note <> '' then 'rid+updated:' || customer_id || '|' || note when customer_id <> '' then 'rid:' || customer_id when customer_name <> '' and phone <> '' then 'natural:customer_name=' || customer_name || '|phone=' || phone else 'fp:' || sha256('address=' || address || chr(10) || 'history=' || history) end as diff_key, case when customer_id = '' and (customer_name = '' or phone = '') then 'record id/natural key unavailable; fingerprint fallback' else '' end as warning from flow", flow=FLOW)
def diff_identity(f):
    return flow.diff_identity(f, _RULE).select("row_index", F.col("_identity_key").alias("identity_key"), F.col("_diff_key").alias("diff_key"), F.col("_warning").alias("warning"))


# --- columns and files -----------------------------------------------------------------------------------------------

_MAPPINGS = [("*_list*", {"項目1": "phone", "状況": "progress_status"})]
_ALIASES = {"phone": ["TEL番号"], "customer_name": ["お名前"]}


def _duck_rules(rows, *names):
    return "[" + ", ".join("{" + ", ".join(f"'{n}': {duck.q(v)}" for n, v in zip(names, r)) + "}" for r in rows) + "]"


_RULES = _duck_rules(suggest.RULES, "field", "family", "confidence", "pattern")
_HIT = "list_filter({0}, lambda r: regexp_matches({1}, '(?i)' || r.pattern))[1]"
_SUGGESTED = f""", mapped as (select *, case when regexp_matches(file, '(?i)^.*_list.*$') then case name when '項目1' then 'phone' when '状況' then 'progress_status' end end as m, case when lower(name) = 'tel番号' then 'phone' when name = 'お名前' then 'customer_name' end as a, list_filter([v1, v2], lambda x: x <> '') as sample from headers),
hits as (select *, {_HIT.format(_RULES, "trim(name)")} as r, {_HIT.format(_RULES, "coalesce(m, a, '')")} as o, len(sample) > 0 and len(list_filter(sample, lambda x: regexp_matches(trim(x), {duck.q(suggest.PHONE_LIKE)}))) * 2 >= len(sample) as phones, len(sample) > 0 and len(list_filter(sample, lambda x: contains(x, '@'))) * 2 >= len(sample) as mails from mapped),
based as (select *, case when m is not null then 'mapping' when a is not null then 'alias' when r is not null then 'name' when phones then 'phone_values' when mails then 'email_values' else 'none' end as basis from hits),
suggested as (select column_id, file, name, basis, coalesce(m, a, r.field, case basis when 'phone_values' then 'phone' when 'email_values' then 'email' end, name) as field, case when basis in ('mapping', 'alias') then coalesce(o.family, 'raw_extra') when basis = 'name' then r.family when basis in ('phone_values', 'email_values') then 'contact' else 'raw_extra' end as family, case when basis in ('mapping', 'alias') then 'high' when basis = 'name' then r.confidence when basis in ('phone_values', 'email_values') then 'medium' else 'low' end as confidence from based)"""


def suggested(h):
    sample = F.filter(F.array("v1", "v2"), lambda x: x != "")
    return suggest.suggestions(h.withColumn("sample", sample), _MAPPINGS, _ALIASES)


@query(_SUGGESTED + " select s.*, x.s as section from suggested s join (values " + ", ".join(f"('{k}', '{v}')" for k, v in suggest.SECTIONS.items()) + ") x(f, s) on x.f = s.family", headers=HEADERS)
def column_suggestions(h):
    return suggested(h).select("column_id", "file", "name", "basis", "field", "family", "confidence", "section")


@query(_SUGGESTED + ", n as (select file, count(*) filter (family = 'sales_activity') as s, count(*) filter (family = 'contact') as c, count(*) filter (family = 'identity') as i, count(*) filter (family = 'visit_schedule') as v, count(*) filter (family = 'progress') as p, count(*) filter (family in ('estimate', 'product')) as e, count(*) filter (family = 'finance_review') as f, count(*) filter (family = 'documents') as d from suggested group by 1), kinds as (select file, case when s >= 2 and c >= 2 then 'apo_list' when c >= 2 and i >= 1 and s < 2 then 'customer_master' when v > 0 then 'visit_history' when p > 0 then 'progress_management' when e > 0 then 'estimate_product' when f > 0 and d > 0 then 'document_review' else 'mixed_unknown' end as file_type from n) select *, case when file_type in ('apo_list', 'customer_master') then 'medium' else 'low' end as confidence from kinds", headers=HEADERS)
def file_types(h):
    return suggest.file_types(suggested(h))


@query(f", hits as (select column_id, {_HIT.format(_duck_rules(suggest.QUICK, 'field', 'pattern', 'certainty'), 'name')} as h from headers) select column_id, h.field as suggested, h.certainty as certainty from hits", headers=HEADERS)
def mapping_suggestions(h):
    return suggest.quick_suggestions(h).select("column_id", "suggested", "certainty")


@query("select column_id, case " + " ".join(f"when len(list_filter([{', '.join(duck.q(w) for w in words)}], lambda w: contains(name, w))) > 0 then '{kind}'" for kind, words in suggest.ENTITIES) + " else 'deal' end as entity from headers", headers=HEADERS)
def column_entities(h):
    return h.select("column_id", suggest.entity_of(F.col("name")).alias("entity"))


# a profile of one file: its keys by place, with the names that each goes by
_PROFILE = [(0, "phone", "電話番号", "TEL"), (1, "customer_name", "氏名", "顧客名"), (2, "notes", "メモ", "備考"), (3, "result", "結果", ""), (4, "contract_date", "契約日", "contract_date")]
_REVIEWS = "select column_id, concat('run', cast(column_id % 9 as string)) as run, position, name as header, case column_id % 5 when 0 then 'phone' when 1 then 'customer_name' when 2 then '' when 3 then 'own_key' else 'notes' end as proposed, case column_id % 3 when 0 then '電話' when 1 then '備考' else '' end as meaning, case column_id % 4 when 0 then 'no' when 1 then 'unknown' else 'yes' end as in_use from (" + HEADERS + ") h"
_KIND_CASE = "case proposed " + " ".join(f"when '{k}' then '{v}'" for k, v in suggest.KIND_OF.items()) + " end"
_EXACT = "case lower(trim(header)) " + " ".join(f"when {duck.q(n.lower())} then '{k}'" for _, k, *names in _PROFILE for n in names if n) + " end"
_HERE = "case position " + " ".join(f"when {p} then [{', '.join(duck.q(n.lower()) for n in names)}]" for p, _, *names in _PROFILE) + " end"


@query(
    f", hinted as (select *, {_EXACT} as exact, {_HERE} as here, {_HIT.format(_duck_rules(suggest.KINDS, 'kind', 'pattern'), 'trim(header)')}.kind as kind, {_HIT.format(_duck_rules(suggest.HINTS, 'key', 'pattern'), 'trim(header)')}.key as hint, {_HIT.format(_duck_rules(suggest.HINTS, 'key', 'pattern'), 'meaning')}.key as meant, {_KIND_CASE} as allowed from reviews), "
    f"safe as (select *, case when regexp_matches(trim(header), {duck.q('(?i)' + suggest.SUSPICIOUS)}) then null else coalesce(exact, case when proposed <> '' and proposed <> header and not coalesce(kind <> allowed, false) and (coalesce(kind = allowed, false) or coalesce(meant = proposed, false) or coalesce(list_contains(here, lower(trim(header))), false) or kind is null or allowed is null) then proposed end, hint) end as safe_key from hinted), "
    "used as (select *, coalesce(safe_key, header) as key, case when safe_key is not null and in_use = 'yes' then 'yes' when in_use = 'no' then 'no' else 'unknown' end as used from safe) "
    "select run, position, header, key, case when used = 'no' then 'unused' when used = 'yes' and row_number() over (partition by run, key, used order by position) = 1 then 'active' else 'pending' end as status from used",
    reviews=_REVIEWS,
)
def effective_mapping(r):
    profile = r.sparkSession.createDataFrame([(p, k, list(names)) for p, k, *names in _PROFILE], "position int, key string, names array<string>")
    return suggest.effective_mapping(r, profile)


_FILES = "select page_id, regexp_replace(url, '[?#].*', '') as url, page_id % 4 = 0 as headerless, case when page_id % 9 = 0 then 'f1' end as family from {pages}"
_CUSTOMER = Profile("customer-list", files=("*顧客*",), columns=(("blog",), ("en", "de"), ("com",)), column_count=5)
_OTHER = Profile("other", files=("shop*",), columns=(("fr",), ("com",)), column_count=6)


@query(
    "select page_id, why, mode, mixed, cast(n as int) as children from (select *, n > 0 and why = 'profile_inference' as mixed from (select *, case when regexp_matches(base, '(?i)^.*1$') then 'archive' when regexp_matches(base, '(?i)^.*[.]html$') then 'mainline' end as rule, case when page_id % 10 = 0 then 'mainline' end as own, "
    "case when page_id % 10 = 0 then 'input_mode' when regexp_matches(base, '(?i)^.*1$|^.*[.]html$') then 'diff_key_mode' when c > 0 and c >= o then 'profile_inference' else 'default_archive' end as why, case when page_id % 10 = 0 then 'mainline' when regexp_matches(base, '(?i)^.*1$') then 'archive' when regexp_matches(base, '(?i)^.*[.]html$') then 'mainline' when c > 0 and c >= o then 'mainline' else 'archive' end as mode from "
    "(select *, regexp_extract(url, '[^/]*$') as base, len(list_filter(cols, lambda x: contains(x, '::'))) as n, "
    "case when headerless then 0 else round((cast(list_contains(cols, 'blog') as int) + cast(list_has_any(cols, ['en', 'de']) as int) + cast(list_contains(cols, 'com') as int)) / 3.0 * 50) end + case when len(cols) > 0 then case abs(len(cols) - 5) when 0 then 25 when 1 then 15 when 2 then 8 else 0 end else 0 end as c, "
    "case when headerless then 0 else round((cast(list_contains(cols, 'fr') as int) + cast(list_contains(cols, 'com') as int)) / 2.0 * 50) end + case when len(cols) > 0 then case abs(len(cols) - 6) when 0 then 25 when 1 then 15 when 2 then 8 else 0 end else 0 end + case when regexp_matches(regexp_extract(url, '[^/]*$'), '(?i)^shop.*$') then 100 else 0 end as o "
    "from (select *, list_concat(list_filter(regexp_split_to_array(url, '[/.]'), lambda x: x <> ''), case when page_id % 3 = 0 then ['t::x'] else [] end) as cols from files))))",
    files=_FILES,
)
def source_routing(files):
    parts = F.filter(F.split("url", "[/.]"), lambda x: x != "")
    columns = F.concat(parts, F.when(F.col("page_id") % 3 == 0, F.array(F.lit("t::x"))).otherwise(F.array().cast("array<string>")))
    known = files.withColumns({"file": routing.base_name(F.col("url")), "columns": columns}).withColumn("column_count", F.size("columns"))
    named = known.withColumn("file", F.when(F.col("page_id") % 10 == 0, "given").otherwise(F.col("file")))
    out = routing.route(named, {"given": "mainline"}, [("*1", "archive"), ("*.html", "mainline")], [_CUSTOMER, _OTHER])
    return out.select("page_id", "why", "mode", "mixed", F.size("children").alias("children"))


@query(
    "select page_id, case when schema = sha256('a|b') then 'by_schema' when regexp_matches(base, '(?i)^.*1$') then 'by_name' when regexp_matches(base, '(?i)^.*2.*$') then 'by_index' end as mapping from (select page_id, regexp_extract(url, '[^/]*$') as base, case when page_id % 6 = 0 then sha256('a|b') else sha256('b|c') end as schema from files)",
    files=_FILES,
)
def best_mapping(files):
    schema = routing.schema_key(F.when(F.col("page_id") % 6 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("c"), F.lit("b"))))
    import hashlib

    known = {hashlib.sha256(b"a|b").hexdigest(): "by_schema"}
    return files.select("page_id", routing.best_mapping(F.col("url"), schema, known, [("*1", "by_name")], [("*2*", "by_index")]).alias("mapping"))


_FILED = "select c_custkey as file_id, concat('list', cast(c_custkey % 40 as string)) as stem, concat('c', cast(c_custkey % 5 as string)) as x, concat('c', cast(c_custkey % 3 + 4 as string)) as y, concat('d', cast(c_custkey % 11 as string)) as z, case when c_custkey % 2 = 0 then 'utf8' else 'cp932' end as encoding, c_custkey % 7 <> 0 as has_header from {customer}"
_KEPT = "select s_suppkey as template_id, concat('list', cast(s_suppkey as string)) as stem, concat('c', cast(s_suppkey % 5 as string)) as x, concat('c', cast(s_suppkey % 3 + 4 as string)) as y, concat('d', cast(s_suppkey % 13 as string)) as z, case when s_suppkey % 2 = 0 then 'utf8' else 'cp932' end as encoding, true as has_header from (select c_custkey as s_suppkey from {customer} where c_custkey <= 60) s"
_GRAMS = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"
_DICE = "case when f.stem = t.stem then 1.0 else 2.0 * list_sum(list_transform(list_distinct(f.g), lambda g: least(len(list_filter(f.g, lambda h: h = g)), len(list_filter(t.g, lambda h: h = g))))) / (len(f.g) + len(t.g)) end"


@query(
    f", ff as (select *, list_distinct([x, y, z]) as cols, {_GRAMS.format('stem')} as g from f), tt as (select *, list_distinct([x, y, z]) as cols, {_GRAMS.format('stem')} as g from t), "
    f"scored as (select file_id, template_id, round(0.5 * cast(list_sort(f.cols) = list_sort(t.cols) as int) + 0.2 * len(list_intersect(f.cols, t.cols)) / len(list_distinct(list_concat(f.cols, t.cols))) + 0.15 * {_DICE} + 0.1 * case abs(len(f.cols) - len(t.cols)) when 0 then 1.0 when 1 then 0.5 else greatest(0, 1 - abs(len(f.cols) - len(t.cols)) / 5) end + 0.03 * cast(f.encoding = t.encoding as int) + 0.02 * cast(f.has_header = t.has_header as int), 6) as score from ff f cross join tt t), "
    "placed as (select *, cast(row_number() over (partition by file_id order by score desc, template_id) as int) as place from scored where score >= 0.3) select * from placed where place <= 3",
    f=_FILED,
    t=_KEPT,
)
def template_matches(f, t):
    shaped = lambda df: df.withColumn("columns", F.array_distinct(F.array("x", "y", "z"))).withColumn("schema", routing.schema_key(F.col("columns")))
    return suggest.template_matches(shaped(f), shaped(t).withColumn("stems", F.array("stem")))


_ASKED = "select c_custkey as ask_id, concat('s', cast(c_custkey % 20 as string)) as schema, concat('n', cast(c_custkey % 30 as string)) as name, concat('f', cast(c_custkey % 3 as string)) as family from {customer}"
_DECIDED = "select distinct concat('s', cast(c_custkey % 10 as string)) as schema, 'f1' as family, concat('n', cast(c_custkey % 12 as string)) as name, case when c_custkey % 12 % 5 = 0 then null else concat('field', cast(c_custkey % 12 as string)) end as field, case when c_custkey % 12 % 4 = 1 then 'low' else 'high' end as certainty from {customer}"
_REMEMBERED = "select c_custkey as id, concat('column:n', cast(c_custkey % 25 as string)) as context, case when c_custkey % 4 = 0 then 'global' else concat('f', cast(c_custkey % 3 as string)) end as family, case when c_custkey % 6 = 0 then 'column_ignore' else 'column_canonical' end as kind, case when c_custkey % 5 = 0 then 'low' else 'high' end as certainty, c_custkey % 7 = 0 as deleted from {customer}"


@query(
    ", sure as (select schema, name, min(coalesce(field, '')) as field from decided where certainty <> 'low' group by 1, 2), fam as (select schema, min(family) as family from decided group by 1), o as (select a.ask_id, 'column:' || a.name as context, coalesce(fam.family, a.family) as family, sure.field from asked a left join sure using (schema, name) left join fam using (schema)) "
    "select ask_id, nullif(field, '') as decision, 'template' as basis from o where field is not null union all "
    "select ask_id, cast(arg_min(id, (case when r.kind = 'column_ignore' then 0 else 1 end, case when r.family = o.family then 0 else 1 end, id)) as varchar), coalesce(arg_min(kind, (case when r.kind = 'column_ignore' then 0 else 1 end, case when r.family = o.family then 0 else 1 end, id)), 'unresolved') from o left join (select * from memory where not deleted and certainty in ('confirmed', 'high')) r on r.context = o.context and r.family in (o.family, 'global') where field is null group by 1",
    asked=_ASKED,
    decided=_DECIDED,
    memory=_REMEMBERED,
)
def auto_apply_preview(asked, decided, memory):
    return suggest.auto_apply(asked, decided, memory)


# --- audit -----------------------------------------------------------------------------------------------------------


_DRIFT = "select *, case when row_count % 2 = 0 then 'a' else 'b' end as x, case when row_count % 3 = 0 then 'c' else 'd' end as y from (" + _RUNS + ") r"


@query(", pairs as (select *, coalesce(last_value(run_id) over (partition by source, profile order by started_at, run_id rows between unbounded preceding and 1 preceding), last_value(run_id) over (partition by source order by started_at, run_id rows between unbounded preceding and 1 preceding)) as previous_run from runs) select p.run_id, p.previous_run, array_to_string(list_filter([p.x, p.y], lambda c: c not in (o.x, o.y)), ',') as added, array_to_string(list_filter([o.x, o.y], lambda c: c not in (p.x, p.y)), ',') as removed from pairs p join runs o on o.run_id = p.previous_run", runs=_DRIFT)
def columns_drift(runs):
    out = audit.columns_drift(runs.withColumn("columns", F.array("x", "y")))
    return out.select("run_id", "previous_run", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


_KEYS = {"strict": "call_date || '|' || call_staff || '|' || left(content, 80)", "loose": "call_date || '|' || trim(call_staff)"}


@query("".join(f", {k}_x as (select distinct {e} as k from calls where row_index % 2 = 0), {k}_y as (select distinct {e} as k from calls where row_index % 2 = 1), {k} as (select count(x.k) as a, count(y.k) as b, count(*) filter (x.k is not null and y.k is not null) as s, count(*) filter (y.k is null) as ao, count(*) filter (x.k is null) as bo from {k}_x x full join {k}_y y on x.k = y.k)" for k, e in _KEYS.items()) + " select " + ", ".join(f"{k}.a as {k}_a_keys, {k}.b as {k}_b_keys, {k}.s as {k}_shared, {k}.ao as {k}_a_only, {k}.bo as {k}_b_only, round({k}.s / {k}.a, 4) as {k}_rate" for k in _KEYS) + ", case when strict.s / strict.a > 0.9 then 'same_export' when strict.s / strict.a > 0.3 or loose.s / loose.a > 0.5 then 'partial_overlap' else 'separate_systems' end as conclusion from strict, loose", calls=CALLS)
def overlap_conclusion(calls):
    return audit.overlap_conclusion(*sides(calls))


_FP = "call_date || '|' || call_staff || '|' || left(content, 80) as fp"


@query(f", a as (select *, {_FP} from calls where row_index % 2 = 0), b as (select *, {_FP} from calls where row_index % 2 = 1), s as (select *, fp in (select fp from a) as strict_dup from b), m as (select strict_dup, not strict_dup and exists (select 1 from a where a.call_date = s.call_date and a.call_staff = s.call_staff and a.fp <> s.fp) as loose_dup from s), c as (select (select count(*) from a) as a, count(*) as b, count(*) filter (strict_dup) as s, count(*) filter (loose_dup) as l from m) select 'keep_all' as policy, a + b as total_rows, a as a_rows, b as b_rows, 0 as handled, 0 as review_rows from c union all select 'soft_dedupe', a + b - s, a, b - s, s, l from c union all select 'a_primary', a + b - s, a, b - s, s, 0 from c", calls=CALLS)
def merge_policies(calls):
    a, b = sides(calls)
    return audit.merge_policies(audit.mark_cross_source(a, b), a)


_STAGED = {"call_date": "call_date", "call_staff": "call_staff", "content": "content", "fax": "fax"}


@query(_MATCHED + " select m.call_date, m.call_staff, m.content, '' as fax, 'calls.xlsx' as raw_source_file, cast(row_index + 2 as varchar) as raw_row_origin, 'calls.xlsx:row_' || cast(row_index + 2 as varchar) as source_fingerprint, cast(case when match_type in ('exact', 'normalized') then ids[1] end as varchar) as matched_customer_id, cast(case when is_hit then found else 0 end as varchar) as candidate_count, match_type, 'source_a' as source_kind from matched m", calls=CALLS, contact=CONTACT)
def staging_calls(calls, contact):
    return audit.staging_calls(calls_matched(calls, contact), "calls.xlsx", _STAGED, matched=True)


@query("select * from (select *, case when strict then 'duplicate' when loose then 'needs_review' else 'active' end as review_status from (select row_index, call_date, row_index % 4 = 0 as strict, row_index % 4 = 1 as loose from calls)) where review_status = 'active'", calls=CALLS)
def active_calls(calls):
    marks = calls.select("row_index", "call_date", (F.col("row_index") % 4 == 0).alias("strict"), (F.col("row_index") % 4 == 1).alias("loose"))
    return audit.active(marks.withColumn("review_status", F.when(F.col("strict"), "duplicate").when(F.col("loose"), "needs_review").otherwise("active")))


_NAMED = {"契約日": "contract_date", "電話": "phone", "月額": "amount", "回数": "amount", "kw": "amount", "備考": "email", "時刻": "note", "作業時間": "note", "計上月": "amount", "空": "none"}
_V = "(select u.f as field, u.v as value from (select unnest([" + ", ".join(f"{{'f': '{f}', 'v': {duck.trimmed(c) if c != 'none' else duck.q('')}}}" for f, c in _NAMED.items()) + "]) as u from contact) where u.v <> '')"
_D, _P, _N = (duck.q(x) for x in (audit.DATE_VALUE, audit.PHONE_VALUE, audit.NUMBER_VALUE))


@query(
    f", v as {_V}, one as (select field, count(*) as n, count(*) filter (regexp_matches(value, {_D}) or regexp_matches(value, {duck.q(audit.TIMED_VALUE)})) / count(*) as dated, count(*) filter (regexp_matches(value, '^[0-9]{{4,6}}\\z')) / count(*) as period, count(*) filter (regexp_matches(value, '^[0-9]+\\z')) / count(*) as whole, count(*) filter (regexp_matches(value, '^[0-9.]+\\z')) / count(*) as dec, count(*) filter (regexp_matches(value, {_N})) / count(*) as num, "
    f"count(*) filter (k = 'date') / count(*) as d, count(*) filter (k = 'phone') / count(*) as p, count(*) filter (k = 'email') / count(*) as e, count(*) filter (k = 'number') / count(*) as a from (select *, case when regexp_matches(value, {_D}) then 'date' when regexp_matches(value, {_P}) and length(regexp_replace(value, '[^0-9]', '', 'g')) between 10 and 11 then 'phone' when contains(value, '@') then 'email' when regexp_matches(value, {_N}) then 'number' end as k from v) group by 1), "
    f"names as (select unnest([{', '.join(duck.q(f) for f in _NAMED)}]) as field), has as (select *, len(list_filter([{', '.join(duck.q(w) for w in audit.DATE_NAMES)}], lambda w: contains(field, w))) > 0 as is_date from names left join one using (field)) "
    f"select field, case when n is null then 'empty' when is_date and contains(field, '時刻') then 'time' when is_date and contains(field, '時間') then 'duration' when is_date and dated > 0.3 then 'date' when field in ('計上月') and not is_date and period > 0.5 then 'period' when field in ('月額', '計上月') and not is_date and num > 0.5 then 'amount' when field = '回数' and whole > 0.5 then 'count' when field = 'kw' and dec > 0.5 then 'quantity' when d > 0.6 then 'date' when p > 0.6 then 'phone' when e > 0.6 then 'email' when a > 0.6 then 'number' else 'text' end as type from has",
    contact=CONTACT,
)
def infer_types_by_name(c):
    return audit.infer_types_by_name(c.select(*[(F.col(v) if v != "none" else F.lit("")).alias(k) for k, v in _NAMED.items()]), list(_NAMED))


@query("select count(*) as rows, count(*) filter (customer_id <> '') as master_rows, count(*) filter (history <> '') as child_rows, count(*) filter (customer_id <> '' and history <> '') as master_and_child, count(*) filter (customer_id = '' and history = '') as unaccounted, count(*) filter (customer_id = '' and customer_name = '' and phone = '' and history = '') as empty_rows, count(distinct case when customer_id <> '' then customer_id end) as masters from flow", flow=FLOW)
def row_diagnosis(f):
    return audit.row_diagnosis(f, "customer_id", ["history"], ["customer_id", "customer_name", "phone", "history"])


_STATUS = "dict as (select o_orderpriority as value, case o_orderpriority when '1-URGENT' then 'urgent' when '2-HIGH' then 'urgent' when '3-MEDIUM' then 'normal' else '' end as stage, case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'medium' when '3-MEDIUM' then 'high' else 'low' end as certainty from orders group by 1)"
_SAID = {"2-HIGH": (" high ", "s1"), "3-MEDIUM": ("normal", ""), "5-LOW": (" ", "s2")}


@query(f"with {_STATUS}, said(value, s, b) as (values " + ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in _SAID.items()) + ") select value, stage as stage_before, coalesce(nullif(trim(s), ''), case when certainty = 'high' then coalesce(nullif(stage, ''), 'unresolved') end, 'unresolved') as stage, case when trim(s) <> '' or certainty = 'high' then 'high' else certainty end as certainty, coalesce(trim(s) <> '' and trim(s) <> stage, false) as revised, case when trim(s) <> '' then 'hearing:' || coalesce(nullif(trim(b), ''), '?') when certainty = 'high' then 'inherited' else 'provisional' end as basis from dict left join said using (value)")
def status_final(spark, sf_dir):
    stages = {"1-URGENT": ("urgent", "high"), "2-HIGH": ("urgent", "medium"), "3-MEDIUM": ("normal", "high")}
    pick = lambda i, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in stages.items() for x in (k, v[i])]), F.col("value")), F.lit(other))
    dictionary = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value")).distinct().withColumns({"stage": pick(0, ""), "certainty": pick(1, "low")})
    answers = spark.createDataFrame([(k, *v) for k, v in _SAID.items()], "value string, confirmed_stage string, confirmed_by string")
    return audit.status_final(dictionary, answers)


# --- checks ----------------------------------------------------------------------------------------------------------

_LOOSE = "select o_orderkey, case when o_orderkey % 97 = 0 then null else o_orderkey - o_orderkey % 2 * (o_orderkey % 50 // 49) end as k, o_orderstatus, case when o_orderkey % 11 = 0 then null else o_orderpriority end as p, case when o_orderkey % 13 = 0 then '' when o_orderkey % 3 = 0 then cast(o_custkey + 100000 as string) else cast(o_custkey as string) end as c from {orders}"
_LOOSE = _LOOSE.replace("o_orderkey % 50 // 49", "cast(floor(o_orderkey % 50 / 49) as bigint)")


@query("select 'unique(k)' as rule, cast(k as varchar) as value, count(*) as n from t where k is not null group by 2 having count(*) > 1 union all select 'required(k)', '', count(*) from t where k is null having count(*) > 0 union all select 'required(p)', '', count(*) from t where p is null having count(*) > 0 union all select 'allowed(o_orderstatus)', o_orderstatus, count(*) from t where o_orderstatus not in ('F', 'O') group by 2", t=_LOOSE)
def constraint_violations(t):
    return checks.violations(t, key=["k"], required=["p"], allowed={"o_orderstatus": ["F", "O"]})


@query("select o_orderkey, c from t where trim(c) <> '' and c not in (select cast(c_custkey as varchar) from customers)", t=_LOOSE, customers="select c_custkey from {customer}")
def orphan_matches(t, customers):
    return checks.orphans(t, "c", customers, "c_custkey").select("o_orderkey", "c")


@query("select u.f as field, count(*) as n, count(*) filter (trim(u.v) = '') as nulls, round(count(*) filter (trim(u.v) = '') / count(*), 4) as rate from (select unnest([{'f': 'k', 'v': coalesce(cast(k as varchar), '')}, {'f': 'p', 'v': coalesce(p, '')}, {'f': 'c', 'v': coalesce(c, '')}]) as u from t) group by 1", t=_LOOSE)
def null_rates(t):
    return checks.null_rates(t, ["k", "p", "c"])


@query("select o_orderstatus, p, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as share from t group by 1, 2 order by n desc, o_orderstatus, p nulls first limit 30", t=_LOOSE)
def status_distribution(t):
    return checks.distribution(t, "o_orderstatus", "p", most=30)


@query("select 'orders' as name, count(*) as n, case when count(*) = count(distinct o_orderkey) then 'OK' else 'MISMATCH' end as verdict from orders union all select 'customer', count(*), case when count(*) = count(distinct c_custkey) then 'OK' else 'MISMATCH' end from customer union all select 'rejected', count(*), case when count(*) = 0 then 'OK' else 'MISMATCH' end from orders where o_orderstatus = 'P'")
def load_postcheck(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return checks.matched({"orders": (o, F.count_distinct("o_orderkey")), "customer": (c, F.count_distinct("c_custkey")), "rejected": (o.where("o_orderstatus = 'P'"), 0)})


@contact_query("with profile as (" + _SQL["dataset_profile"] + ") select field, type, case when date_candidate then 'date' when phone_candidate then 'phone' when type = 'email' then 'email' when contains(field, 'address') then 'address' end as rule from profile where rule is not null", whole=True)
def normalization_candidates(n):
    return audit.normalization_candidates(audit.dataset_profile(n, _PROFILED))


@query(_MATCHED + " select 'invalid_phones' as code, 'medium' as severity, 'phone' as subject, count(*) as n from matched where match_type = 'invalid' having count(*) > 0", calls=CALLS, contact=CONTACT)
def review_issues(calls, contact):
    return audit.review_issues(audit.dataset_profile(contact, ["product", "customer_name"]), calls_matched(calls, contact))


@contact_query(f"{_CELLS}, placed as (select *, row_number() over (partition by field order by n desc, first_row, value) as place from counted), s as (select field, array_to_string(list(value order by place), '|') as sample from placed where place <= 5 group by 1), p as (select f.field, round(1 - coalesce(sum(n), 0) / (select count(*) from normalized), 4) as missing_rate, least(count(n), 10000) as distinct_values from {_FIELDS} f left join counted c on c.field = f.field group by 1) select field as name, missing_rate, distinct_values, coalesce(sample, '') as sample, 'unknown' as decision from p left join s using (field)")
def columns_report(n):
    counts = settled(audit.value_counts(n, _PROFILED))
    r = suggest.columns_report(audit.column_profile(n, _PROFILED, counts=counts), audit.top_values(n, _PROFILED, counts=counts))
    return r.withColumn("sample", F.array_join("sample", "|"))


# --- names, fingerprints, queues -------------------------------------------------------------------------------------

_BARE = "regexp_replace(regexp_replace(regexp_replace(name, '(?i)[.](csv|xlsx|tsv|xls)$', ''), '^[0-9]{6,8}[_\\-\\s]?', ''), '[_\\-\\s]?[0-9]{4,8}$', '')"
_PARTS = f"list_filter(regexp_split_to_array(lower({duck.narrow(_BARE)}), '[-_\\s.]+'), lambda p: p <> '' and p not in ({', '.join(duck.q(w) for w in similarity.NOISE)}) and not regexp_matches(p, '^(rev[0-9]*|v[0-9]+)$'))"
_PLACED = f"list_filter(range(1, len(p) + 1), lambda i: p[i] not in ({', '.join(duck.q(w) for w in similarity.PLACES)}))"


@query(f", cut as (select file_id, name, {_PARTS} as p from files), kept as (select *, coalesce(list_max({_PLACED}), 0) as n from cut) select file_id, coalesce(nullif(regexp_replace(array_to_string(p[1:n], '_'), '^_+|_+$', '', 'g'), ''), lower(name)) as stem from kept", files=FILES)
def filename_stems(files):
    return files.select("file_id", similarity.filename_stem(F.col("name")).alias("stem"))


@query("select row_index, sha256('filehash' || chr(0) || cast(row_index as varchar) || chr(0) || customer_id || '|' || customer_name || '|' || phone) as row_fp, 'mixed.csv:row_' || cast(row_index + 2 as varchar) as source_fp from flow", flow=FLOW)
def row_fingerprints(f):
    cells = F.array("customer_id", "customer_name", "phone")
    return f.select("row_index", hashing.row_fingerprint(F.lit("filehash"), F.col("row_index"), cells).alias("row_fp"), audit.row_source("mixed.csv", F.col("row_index")).alias("source_fp"))


_COLS = "list_filter(regexp_split_to_array(url, '[/.]'), lambda x: x <> '')"


@query(f"select page_id, sha256(array_to_string(list_sort(c), '|')) as schema_fp, sha256(array_to_string(list_sort(list_transform(c, lambda x: trim(lower(x)))), chr(0))) as review_fp, sha256(array_to_string(list_sort(c), ',') || '|' || len(c) || '|utf8|' || case when headerless then '0' else '1' end) as shape from (select page_id, headerless, {_COLS} as c from files)", files=_FILES)
def file_fingerprints(files):
    c = F.filter(F.split("url", "[/.]"), lambda x: x != "")
    return files.select("page_id", routing.schema_key(c).alias("schema_fp"), routing.review_schema_key(c).alias("review_fp"), routing.file_shape(c, F.lit("utf8"), ~F.col("headerless")).alias("shape"))


_WORDS = {"blog": ("news", 2.0), "en": ("shop", 1.0), "com": ("shop", 1.0), "fr": ("news", 0.5)}


@query(
    f", shaped as (select page_id, {_COLS} as c, case when page_id % 8 = 0 then 'known' else 'new' end as shape from files), scored as (select page_id, shape, " + ", ".join(f"list_sum(list_transform(c, lambda x: case x {' '.join(f'when {duck.q(k)} then {w}' for k, (g, w) in _WORDS.items() if g == f)} else 0.0 end)) as {f}" for f in ("news", "shop")) + " from shaped) select page_id, case when shape = 'known' then 'old' when greatest(coalesce(news, 0), coalesce(shop, 0)) < 1.5 then 'unknown' when shop >= news then 'shop' else 'news' end as family, case when shape = 'known' then 'confirmed' when greatest(coalesce(news, 0), coalesce(shop, 0)) < 1.5 then 'unknown' else 'low' end as certainty from scored",
    files=_FILES,
)
def family_by_shape(files):
    shaped = files.withColumns({"columns": F.filter(F.split("url", "[/.]"), lambda x: x != ""), "shape": F.when(F.col("page_id") % 8 == 0, "known").otherwise("new")})
    known = files.sparkSession.createDataFrame([("known", "old", "confirmed")], "shape string, family string, certainty string")
    return routing.family_of(shaped.drop("family"), known, _WORDS, 1.5).select("page_id", "family", "certainty")


@contact_query(_IDENTIFIED + ", found as (select 'entity_match' as match_type, entity_key as match_key, row_index from identity where entity_key <> '' union all select 'source_record', source_record_key, row_index from identity where method <> 'fallback') select match_type, match_key, min(row_index) as first_row, count(*) as size from found group by 1, 2 having count(*) >= 2")
def dup_identity_groups(n):
    return core.duplicate_groups(identified(n)).where("match_type in ('entity_match', 'source_record')")


@query(_QUEUE + ", ranked as (select row_index, case severity when 'high' then 1 when 'medium' then 2 else 3 end as priority from queue) select *, row_number() over (order by priority, row_index) as place from ranked", calls=CALLS, contact=CONTACT)
def prioritized_queue(calls, contact):
    return reviews.prioritized(audit.review_queue(calls_matched(calls, contact))).select("row_index", "priority", "place")


@query(_QUEUE + ", placed as (select *, row_number() over (partition by normalized_phone order by row_index) as k from queue) select normalized_phone, count(*) as calls, min(call_date) as first_date, max(call_date) as last_date, string_agg(case when k <= 3 then content end, ' | ' order by row_index) as contents from placed group by 1", calls=CALLS, contact=CONTACT)
def review_packet_contents(calls, contact):
    return reviews.packet(audit.review_queue(calls_matched(calls, contact)))


@query(_MATCHED + ", spelt as (select match_type, raw_phone, count(*) as c, min(row_index) as r from matched group by 1, 2), placed as (select *, row_number() over (partition by match_type order by r) as k from spelt) select match_type, cast(sum(c) as bigint) as n, count(*) as numbers, string_agg(case when k <= 10 then raw_phone end, ';' order by r) as samples from placed group by 1", calls=CALLS, contact=CONTACT)
def bucket_samples(calls, contact):
    return reviews.bucket_samples(calls_matched(calls, contact))


@query(_MATCHED + ", c as (select match_type, normalized_phone, count(*) as n from matched where normalized_phone <> '' group by 1, 2), placed as (select match_type, cast(row_number() over (partition by match_type order by n desc, normalized_phone) as int) as place, normalized_phone, n from c) select * from placed where place <= 5", calls=CALLS, contact=CONTACT)
def bucket_top_phones(calls, contact):
    return reviews.top_phones(calls_matched(calls, contact))


@query("select row_index, 'no_customer_id' as reject_reason from flow where customer_id = ''", flow=FLOW)
def rejected_records(f):
    return reviews.rejected_records(f).select("row_index", "reject_reason")


@query(_MATCHED + ", filled as (select *, last_value(nullif(customer_id, '') ignore nulls) over (order by row_index rows between unbounded preceding and current row) as filled from flow) select 'source_b' as source_kind, '' as call_date, history as content, 'mixed.csv' as raw_source_file, cast(row_index + 2 as varchar) as raw_row_origin, coalesce(filled, '') as matched_customer_id, case when filled is not null then '1' else '0' end as candidate_count, case when filled is not null then 'fill_forward' else 'no_match' end as match_type from filled where history <> '' union all select 'source_a', call_date, content, 'calls.xlsx', cast(row_index + 2 as varchar), cast(case when match_type in ('exact', 'normalized') then ids[1] end as varchar), cast(case when is_hit then found else 0 end as varchar), match_type from matched", flow=FLOW, calls=CALLS, contact=CONTACT)
def staging_union(f, calls, contact):
    children = core.fill_forward(f, "customer_id", ["phone"]).where("history <> ''")
    b = audit.staging_calls(children, "mixed.csv", {"call_date": "date", "content": "history"}, matched=False)
    a = audit.staging_calls(calls_matched(calls, contact), "calls.xlsx", {"call_date": "call_date", "content": "content"}, matched=True)
    return audit.activities(b, a).select("source_kind", "call_date", "content", "raw_source_file", "raw_row_origin", "matched_customer_id", "candidate_count", "match_type")


@query("select doc_id, regexp_replace(coalesce(text, ''), '[\\x00-\\x1F\\x7F]', '', 'g') as shown, case when length(text) > 30 then left(text, 27) || '...' else text end as short from documents")
def report_texts(spark, sf_dir):
    t = table(spark, sf_dir, "documents")
    return t.select("doc_id", text.printable(F.col("text")).alias("shown"), text.shortened(F.col("text")).alias("short"))


_SHEETS = "select o_orderkey as row_index, cast(datediff('day', date '1899-12-30', cast(o_orderdate as date)) as double) as n, strftime(cast(o_orderdate as date), '%Y/%m/%d') as spelt, case when o_orderkey % 5 = 0 then '' when o_orderkey % 5 = 1 then '8時間 5分' else '  x ' end as lasted from orders"


@query(f"select row_index, replace(spelt, '/', '-') as from_file, replace(spelt, '/', '-') as from_sheet, case when lasted = '' then '' when lasted = '  x ' then 'x' else '08:05:00' end as duration, cast(n as varchar) as amount from ({_SHEETS})")
def comparable_cells(spark, sf_dir):
    o, key, day = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("double")
    lasted = F.when(key % 5 == 0, "").when(key % 5 == 1, "8時間 5分").otherwise("  x ")
    spelt = F.date_format(day, "yyyy/MM/dd")
    return o.select(key.alias("row_index"), audit.comparable(spelt, "契約日").alias("from_file"), audit.comparable(serial.cast("string"), "契約日", serial).alias("from_sheet"), audit.comparable(lasted, "時刻").alias("duration"), audit.comparable(serial.cast("string"), "金額", serial).alias("amount"))


_LONG = "select c_custkey, concat(c_mktsegment, cast(c_nationkey as string)) as block, concat('customer of ', c_mktsegment, case when c_custkey % 2 = 0 then ' with a long note ' else ' ' end, c_name, case when c_custkey % 3 = 0 then ' and more of it' else '' end) as text from {customer}"


@query(", t as (select block, text, min(c_custkey) as id from notes group by 1, 2) select a.id as a, b.id as b, cast(levenshtein(a.text, b.text) as int) as distance from t a join t b on a.block = b.block and a.id < b.id where levenshtein(a.text, b.text) <= 10", notes=_LONG)
def soft_dedupe_texts(notes):
    return audit.close_texts(notes, "c_custkey", "text", F.col("block"))
