"""The operators' expressions in DuckDB's SQL, for comparison."""

from __future__ import annotations

from tallyloom.functions import dates
from tallyloom.functions import text as t


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def trimmed(x: str) -> str:
    return sub(f"coalesce(cast({x} as varchar), '')", f"^[{t.SPACES}]+|[{t.SPACES}]+\\z")


def narrow(x: str) -> str:
    return f"translate(coalesce({x}, ''), {q(t.FULL_ASCII)}, {q(t.HALF_ASCII)})"


def normal_text(x: str) -> str:
    x = narrow(x)
    for marks, mark in ((t.VOICED, "ﾞ"), (t.HALF_VOICED, "ﾟ")):
        for half, full in marks.items():
            x = f"replace({x}, {q(half + mark)}, {q(full)})"
    x = f"translate({x}, {q(t.HALF_KANA)}, {q(t.FULL_KANA)})"
    x = sub(sub(x, "[\\r\\n\\t]+", " "), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")
    return trimmed(sub(f"replace({x}, '　', ' ')", " {2,}", " "))


def company(x: str) -> str:
    x = normal_text(x)
    for short, sign, full in t.LEGAL_FORMS:
        for p in [f"^[(（]{short}[)）]", f"[(（]{short}[)）]\\z", *([f"^{sign}", f"{sign}\\z"] if sign else [])]:
            x = sub(x, p, full)
    return trimmed(x)


def company_key(x: str) -> str:
    return trimmed(f"lower({sub(sub(company(x), f'^({t.LEGAL_PREFIXES})[{t.SPACES}]*'), f'[{t.SPACES}]*({t.LEGAL_SUFFIXES})\\z')})")


def address(x: str) -> str:
    return trimmed(sub(normal_text(x), f"^[〒{t.SPACES}]*([0-9]{{3}})-?([0-9]{{4}})[{t.SPACES}]*", "\\1-\\2 "))


def address_key(x: str) -> str:
    return f"lower({sub(sub(address(x), f'^[0-9]{{3}}-?[0-9]{{4}}[{t.SPACES}]*'), f'[{t.SPACES}]+')})"


def store_key(x: str) -> str:
    return trimmed(f"lower({sub(normal_text(x), f'({t.STORE_SUFFIXES})\\z')})")


def email(x: str) -> str:
    return f"lower({narrow(trimmed(x))})"


def email_fault(x: str) -> str:
    part = f"[^@{t.SPACES}]+"
    return f"case when {x} <> '' and not regexp_matches({x}, {q(f'^{part}@{part}\\.{part}\\z')}) then 'invalid email format' end"


def phone(x: str) -> str:
    v = narrow(trimmed(x))
    d = sub(v, "[^0-9]")
    return f"case when starts_with({v}, '+') and starts_with({d}, '81') then '0' || substr({d}, 3) when starts_with({v}, '+') then '+' || {d} when starts_with({d}, '81') and length({d}) >= 12 then '0' || substr({d}, 3) else {d} end"


def phone_fault(x: str) -> str:
    return f"case when {x} = '' then null when not regexp_matches({x}, '^[0-9]+\\z') then 'contains non-digit characters' when length({x}) < 10 then 'too short (' || length({x}) || ' digits)' when length({x}) > 11 then 'too long (' || length({x}) || ' digits)' when not starts_with({x}, '0') then 'does not start with 0' end"


def date(x: str) -> str:
    v = sub(narrow(trimmed(x)), f"[{t.SPACES}]+")
    part = lambda p, i: f"regexp_extract({v}, {q(p)}, {i})"
    two = lambda s: f"lpad({s}, 2, '0')"
    era = "case " + part(dates.ERA_DATE, 1) + " " + " ".join(f"when {q(k)} then {y}" for k, y in dates.ERAS.items()) + " end"
    return (
        f"case when regexp_matches({v}, {q(dates.ERA_DATE)}) then ({era} + try_cast({part(dates.ERA_DATE, 2)} as int) - 1) || '-' || {two(part(dates.ERA_DATE, 3))} || '-' || {two(part(dates.ERA_DATE, 4))}"
        f" when regexp_matches({v}, {q(dates.PLAIN_DATE)}) then {part(dates.PLAIN_DATE, 1)} || '-' || {two(part(dates.PLAIN_DATE, 2))} || '-' || {two(part(dates.PLAIN_DATE, 3))}"
        f" when regexp_matches({v}, {q(dates.COMPACT_DATE)}) then {part(dates.COMPACT_DATE, 1)} || '-' || {part(dates.COMPACT_DATE, 2)} || '-' || {part(dates.COMPACT_DATE, 3)} else {trimmed(x)} end"
    )


def date_fault(x: str) -> str:
    y, m, d = (f"try_cast(substr({x}, {a}, {n}) as int)" for a, n in ((1, 4), (6, 2), (9, 2)))
    return f"case when {x} = '' then null when not regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\z') then 'not in YYYY-MM-DD format' when not {m} between 1 and 12 or not {d} between 1 and 31 then 'invalid date' when not {y} between 1900 and 2100 then 'year ' || {y} || ' out of range' end"


def filled(x: str) -> str:
    return f"({trimmed(x)} <> '')"
