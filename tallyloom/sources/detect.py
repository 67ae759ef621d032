"""What a file is like, from its first bytes: encoding, delimiter, header."""

from __future__ import annotations

import re
from statistics import pvariance

SAMPLE = 8192


def encoding(sample: bytes) -> str:
    """utf8 for a BOM or sound UTF-8 (a character cut at the end is no fault), cp932 if byte pairs say so, else utf8."""
    if sample.startswith(b"\xef\xbb\xbf"):
        return "utf8"
    try:
        sample.decode("utf-8")
        return "utf8"
    except UnicodeDecodeError as e:
        if e.start >= len(sample) - 3 and e.reason == "unexpected end of data":
            return "utf8"
    pairs, at = 0, 0
    while at < len(sample) - 1:
        a, b = sample[at], sample[at + 1]
        if (0x81 <= a <= 0x9F or 0xE0 <= a <= 0xFC) and (0x40 <= b <= 0x7E or 0x80 <= b <= 0xFC):
            pairs, at = pairs + 1, at + 2
        else:
            at += 1
    return "cp932" if pairs else "utf8"


def delimiter(text: str) -> str:
    """Of comma, tab and semicolon the one that cuts the first lines most evenly into more than one part; else comma."""
    lines = [x for x in text[:2048].splitlines() if x.strip()][:5]
    counts = {d: [len(x.split(d)) for x in lines] for d in ",\t;"}
    fit = [(pvariance(n), -sum(n), d) for d, n in counts.items() if n and sum(n) / len(n) > 1]
    return min(fit)[2] if fit else ","


# Cells that are data rather than names: an address on the web, a date, a time, a number with hyphens as
# telephone numbers have, a control character, digits.
DATA = re.compile(r"(?i:https?://)|^\d{4}[./-]\d{1,2}[./-]\d{1,2}$|^\d{1,2}:\d{2}(:\d{2})?$|^\d{2,4}-\d{2,4}-\d{3,4}$|[\x00-\x1f]|^[0-9０-９]+$")


def data_like(cell: str) -> bool:
    return bool(DATA.search(cell.strip()))


def has_header(rows: list[list[str]]) -> bool:
    """False if the first row holds three data-like cells, or two and shares two filled columns with later rows."""
    if not rows:
        return False
    like = sum(map(data_like, rows[0]))
    shared = sum(bool(c.strip()) and any(i < len(r) and r[i].strip() for r in rows[1:5]) for i, c in enumerate(rows[0]))
    return not (like >= 3 or like >= 2 and shared >= 2)


# What a cell of a first row can be that is data, the first that fits.
EVIDENCE = (
    ("number", r"^\d+$"),
    ("phone", r"^0\d{1,4}[-ー]?\d{1,4}[-ー]?\d{3,4}$|^\+81"),
    ("date", r"^\d{4}[/\-]\d{1,2}[/\-]\d{1,2}$|^(令和|平成|昭和|大正|明治)\d"),
    ("number", r"^\d+[,.]\d+$"),
    ("email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
    ("address", "^(北海道|青森|岩手|宮城|秋田|山形|福島|茨城|栃木|群馬|埼玉|千葉|東京|神奈川|新潟|富山|石川|福井|山梨|長野|岐阜|静岡|愛知|三重|滋賀|京都|大阪|兵庫|奈良|和歌山|鳥取|島根|岡山|広島|山口|徳島|香川|愛媛|高知|福岡|佐賀|長崎|熊本|大分|宮崎|鹿児島|沖縄)"),
)


def header_evidence(row: list[str]) -> list[str | None]:
    """For each cell of a first row what kind of data it is, or None for what may be a name."""
    return [next((kind for kind, pattern in EVIDENCE if re.search(pattern, c)), None) for c in row]


def header_likelihood(row: list[str]) -> str:
    """high, medium, low or none, by the share of cells that look like names."""
    cells = [c for c in row if c.strip()]
    ratio = sum(not data_like(c) for c in cells) / len(cells) if cells else 0
    return "high" if ratio >= 0.6 else "medium" if ratio >= 0.3 else "low" if ratio > 0 else "none"


def header_verdict(row: list[str]) -> tuple[bool, str]:
    """Whether a first row is a header, and how sure that is: high without data in it or with more than 0.6 of it, medium
    above 0.3, else low."""
    found = [kind for c, kind in zip(row, header_evidence(row)) if c]
    if not found:
        return True, "low"
    data = sum(kind is not None for kind in found) / len(found)
    if data > 0.3:
        return False, "high" if data > 0.6 else "medium"
    return True, "low" if data else "high"
