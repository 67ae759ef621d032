"""URL filters: block decisions spread to a page's redirect and canonical-link aliases; allow rules come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table, written
from tallyloom.llm.graph import connected_components

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z lower-cased; empty where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule = F.coalesce(*[F.when(fits(h, p), F.lit(h + p)) for h, p, _ in ordered])
    verdict = F.coalesce(*[F.when(fits(h, p), F.lit(v)) for h, p, v in ordered])
    return rule, verdict


# Parameters that tell where a visitor came from and name no other page.
TRACKING = r"^(utm_[a-z_]*|gclid|fbclid|msclkid)(=|$)"


def canonical(url: Column) -> Column:
    """The address that a server's own redirects lead to: http, no fragment, no slash, /index or .html at the path's end. The
    query stays, since it may name another page, but for the parameters that can't."""
    query = F.filter(F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    rest = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(F.lit("http://"), host_of(url), F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*\z", ""), rest))


def resolved(target: Column, url: Column) -> Column:
    """A link's target as an address, taken from the page's url where it is relative; null where it leads to no page."""
    c = F.replace(target, F.lit("&amp;"), F.lit("&"))
    site = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    plain = F.concat(site, path_of(url))
    rooted = F.when(c.startswith("/"), c).otherwise(F.concat(F.regexp_replace(path_of(url), r"[^/]*\z", ""), c))
    rooted = F.when(rooted.startswith("/"), rooted).otherwise(F.concat(F.lit("/"), rooted))
    path, tail = F.regexp_extract(rooted, r"(?s)^[^?#]*", 0), F.regexp_extract(rooted, r"(?s)[?#].*", 0)
    up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
    steps = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda kept, x: F.when(x == "..", up(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x))),
    )
    return (
        F.when(c == "", None)
        .when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), c)
        .when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(c.startswith("//"), F.concat(F.lit("http:"), c))
        .when(c.startswith("?") | c.startswith("#"), F.concat(plain, c))
        .otherwise(F.concat(site, F.array_join(steps, "/"), tail))
    )


# Where a page names another address of its own.
LINK_TAG, META_TAG = r"<link\b[^>]*>", r"<meta\b[^>]*>"
IS_CANONICAL, IS_REFRESH = r"""\srel\s*=\s*["']?canonical["'\s/>]""", r"""\shttp-equiv\s*=\s*["']?refresh["'\s/>]"""
LINK_TARGET, META_TARGET = r"""\shref\s*=\s*["']?([^"'\s>]+)""", r"""url\s*=\s*["']?([^"'\s>]+)"""
COMMENT = "<!--.*?-->"


def links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between urls: each page's url with its canonical form, and with the targets of all its canonical links
    and refresh redirects outside comments, which have canonical forms of their own.

    Targets resolve as a browser resolves them. Pages without :// have no edges.
    """
    html = F.regexp_replace(F.coalesce("html", F.lit("")), f"(?s){COMMENT}", "")
    tags = lambda tag, kind: F.filter(F.regexp_extract_all(html, F.lit(f"(?is){tag}"), F.lit(0)), lambda t: t.rlike(f"(?is){kind}"))
    target = lambda found, pattern: F.transform(found, lambda t: F.regexp_extract(t, f"(?is){pattern}", 1))
    every = F.concat(target(tags(LINK_TAG, IS_CANONICAL), LINK_TARGET), target(tags(META_TAG, IS_REFRESH), META_TARGET))
    found = pages.where(F.col("url").contains("://")).select(F.col("url").alias("a"), every.alias("targets"))
    out = found.select("a", F.explode("targets").alias("t")).select("a", resolved(F.col("t"), F.col("a")).alias("b")).where(F.col("b").contains("://"))
    own = found.select("a").union(out.select("b")).distinct()
    return out.union(own.select("a", canonical(F.col("a")).alias("b"))).where("a <> b").distinct()


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each page.

    A url, the canonical form that its server redirects it to, and what its page redirects or links to as canonical are
    aliases: they are one component of the graph of these edges. A page that a rule fits takes its verdict, so allow rules
    hold even among blocked aliases. Any other page is blocked if a rule blocks an alias of its url, else allowed. Null
    urls and urls without :// have empty host and path and are allowed. Repeated rows each give a row, very long pages are
    read whole, other columns are left behind whatever their names; an empty table gives an empty table.
    """
    base = pages.select("page_id", "url", F.col("html"))
    edges = written(links(base), "links")
    verdict_of = lambda url: rule_of(host_of(url), path_of(url), rules)
    rule, verdict = verdict_of(F.col("url"))
    judged = base.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), rule.alias("rule"), verdict.alias("verdict"))
    components = connected_components(edges)
    blocked = components.where(verdict_of(F.col("node"))[1] == "block").select("component").distinct()
    # a page that has no alias has only its own rules
    spread = components.join(blocked, "component", "left_semi").select(F.col("node").alias("url"), F.lit("block").alias("aliases"))
    out = judged.join(spread, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "aliases", F.lit("allow")).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_HOST = "translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
_FIT = "(p.host = r.rhost or suffix(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)"


def op6_sql() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    tags = lambda tag, kind, target: f"list_transform(list_filter(regexp_extract_all(text, {q(tag)}, 0, 'is'), lambda t: regexp_matches(t, {q(kind)}, 'is')), lambda t: regexp_extract(t, {q(target)}, 1, 'is'))"
    query = f"list_filter(string_split(regexp_extract(url, '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '&'), lambda p: p <> '' and not regexp_matches(p, {q(TRACKING)}))"
    form = f"'http://' || {_HOST} || regexp_replace({_PATH}, '(/index)?(\\.html?)?/*\\z', '') || case when len({query}) > 0 then '?' || array_to_string({query}, '&') else '' end"
    scheme = "'^[A-Za-z][A-Za-z0-9+.\\-]*:"
    return f"""
with recursive rules(rhost, rpath, rverdict) as (values {values}),
p as (select page_id, url, {_HOST} as host, {_PATH} as path, regexp_replace(coalesce(html, ''), '{COMMENT}', '', 'gs') as text from pages),
t as (select url, path, regexp_extract(url, '^.*?://[^/?#]*', 0, 's') as site, replace(unnest(list_concat({tags(LINK_TAG, IS_CANONICAL, LINK_TARGET)}, {tags(META_TAG, IS_REFRESH, META_TARGET)})), '&amp;', '&') as c from p where contains(url, '://')),
r as (select *, case when starts_with(c, '/') then c else regexp_replace(path, '[^/]*\\z', '') || c end as r from t),
rooted as (select *, case when starts_with(r, '/') then r else '/' || r end as full_path from r),
steps as (select *, list_reduce(list_transform(string_split(regexp_extract(full_path, '^[^?#]*', 0, 's'), '/'), lambda x: [x]), lambda kept, x: case when x[1] = '..' then kept[:greatest(len(kept) - 1, 1)] when x[1] = '.' then kept else list_concat(kept, x) end) as kept from rooted),
targets as (select url as a, case when c = '' then null when regexp_matches(c, {scheme}//') then c when regexp_matches(c, {scheme}') then null when starts_with(c, '//') then 'http:' || c when starts_with(c, '?') or starts_with(c, '#') then site || path || c else site || array_to_string(kept, '/') || regexp_extract(full_path, '[?#].*', 0, 's') end as b from steps),
found as (select a, b from targets where contains(b, '://')),
own as (select url from p where contains(url, '://') union select b from found),
e as (select a, b from found where a <> b union select url, {form} from own where url <> {form}),
both_ways as (select a, b from e union select b, a from e),
reach(node, other) as (select a, a from both_ways union select r.node, x.b from reach r join both_ways x on r.other = x.a),
entries as (select node, min(other) as entry from reach group by node),
ruled as (select p.page_id, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) as rule, max_by(r.rverdict, length(r.rhost || r.rpath)) as rverdict
          from p join rules r on {_FIT} group by p.page_id),
nodes as (select node, entry, {_HOST.replace('url', 'node')} as host, {_PATH.replace('url', 'node')} as path from entries),
bad as (select distinct entry from (select p.node, p.entry, max_by(r.rverdict, length(r.rhost || r.rpath)) as v from nodes p join rules r on {_FIT} group by 1, 2) where v = 'block')
select p.page_id, p.host, p.path, ruled.rule as rule,
       coalesce(ruled.rverdict, case when entries.entry in (select entry from bad) then 'block' else 'allow' end) as verdict
from p left join ruled using (page_id) left join entries on entries.node = p.url
"""
