"""What the readers of delimited files share: options, reasons, names of columns."""

from __future__ import annotations

import csv
import sys
from dataclasses import dataclass

MISALIGNED, UNDECODABLE, BROKEN = "COLUMN_MISALIGNMENT", "DECODE_FAILED", "PARSE_ERROR"
STRICT, RELAXED, LITERAL = "strict", "relaxed", "literal"

#: columns that every read has besides those of the file
OWN = ("row_index", "_source_file")


@dataclass(frozen=True)
class Options:
    """None means: find out from the file."""

    encoding: str | None = None
    delimiter: str | None = None
    quote_mode: str | None = None
    header: bool | None = None
    skip_rows: int = 0
    preview_rows: int | None = None


def parsed(lines, delimiter: str, mode: str):
    """Records of lines (which keep their ends) as lists of cells."""
    csv.field_size_limit(sys.maxsize)  # a cell may be as large as its file
    kind = {"quoting": csv.QUOTE_NONE} if mode == LITERAL else {"strict": mode == STRICT}
    return csv.reader(lines, delimiter=delimiter, **kind)


def unique(names: list[str]) -> list[str]:
    """Header names with a number behind those that repeat, or that are a reader's own."""
    seen: dict[str, int] = dict.fromkeys(OWN, 1)
    out: list[str] = []
    for n in names:
        name = n
        while name in seen or name in out:
            seen[n] = seen.get(n, 1) + 1
            name = f"{n}_{seen[n]}"
        seen.setdefault(n, 1)
        out.append(name)
    return out
