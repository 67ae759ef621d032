"""Fingerprints and keys. Field names sort by code point; nulls read as blank."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import text, trimmed

NUL = "\0"


def sha(*parts: Column | str) -> Column:
    """Never null, so that joins on it need no test for nulls."""
    return F.coalesce(F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), 256), F.lit(""))


def row_fingerprint(file_hash: Column, row_index: Column, cells: Column) -> Column:
    return F.sha2(F.concat_ws(NUL, file_hash, row_index.cast("string"), F.array_join(cells, "|", "")), 256)


def cell(name: str) -> Column:
    return trimmed(F.col(f"`{name}`"))


def raw_cell(name: str) -> Column:
    return text(F.col(f"`{name}`"))


def structural_fingerprint(fields: list[str], value: Callable[[str], Column] = cell) -> Column:
    """Of name=value lines of the business fields, in the order of their names. value gives a field's text: trimmed, as it
    is (raw_cell), or a column that holds it already."""
    named = [F.concat(F.lit(f"{f}="), value(f)) for f in sorted(fields) if not f.startswith("_")]
    return F.sha2(F.concat_ws("\n", *named), 256)


def pairs(fields: list[str], present: list[str], ordered: bool = False, value: Callable[[str], Column] = cell) -> Column:
    """name=value of the fields that are there and not blank, joined by a bar."""
    known = [f for f in fields if f in present]
    if not known:
        return F.lit("")
    items = F.filter(F.array(*[F.concat(F.lit(f"{f}="), value(f)) for f in known]), lambda x: F.instr(x, "=") < F.length(x))
    return F.array_join(F.array_sort(items) if ordered else items, "|")


def schema_fingerprint(columns: list[str]) -> str:
    """Of a file's column names, whatever their order."""
    return hashlib.sha256("|".join(sorted(columns)).encode()).hexdigest()


def short_hash(*parts: str) -> str:
    return hashlib.sha256(NUL.join(parts).encode()).hexdigest()[:16]


def cross_source_key(date: Column, staff: Column, content: Column) -> Column:
    """date|staff|first 80 characters, with blanks for what is missing."""
    return F.concat_ws("|", text(date), text(staff), F.left(text(content), F.lit(80)))


def packed(c: Column) -> Column:
    """A fingerprint as its bytes, half as many as its letters; any other text behind more bytes than one has."""
    return F.when(c.rlike(r"^[0-9a-f]{64}\z"), F.unhex(c)).when(c == "", F.lit(b"")).otherwise(F.concat(F.lit(b"\0" * 33), F.encode(c, "utf-8")))


def unpacked(c: Column) -> Column:
    """What packed was made of."""
    return F.when(F.length(c) == 32, F.lower(F.hex(c))).otherwise(F.decode(F.substring(c, 34, (1 << 31) - 1), "utf-8"))
