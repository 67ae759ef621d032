"""Licence scans: an automaton finds identifier tags and notice phrases; licence expressions behind tags are evaluated."""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text, small_batches, table

# Phrases that count as notices by the query's contract, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wordings of further notices, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}

#: words of the tags that a licence expression follows, to the end of the line
TAGS = ("spdx license identifier", "license expression")

# How identifiers begin, the first that fits, and their labels.
FAMILIES = (("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("cc-by-sa", "cc-by-sa"), ("cc-by-nc", "cc-by-nc"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("mit", "mit"), ("bsd", "bsd"), ("isc", "isc"), ("mpl", "mpl"), ("epl", "epl"), ("bsl", "bsl"), ("unlicense", "public-domain"))

#: how freely a text under a label may be passed on; other labels are as unknown
FREEDOM = {"public-domain": 1.0, "cc0": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "bsl": 0.9, "apache": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.4, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "reserved": 0.0}
UNKNOWN = 0.1

#: A to Z lower-cased, and a blank for each ASCII character that no word holds; the bytes of all other characters stay
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"\s*([()]|[a-z0-9][a-z0-9.+\-:]*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    return next((label for start, label in FAMILIES if re.match(rf"{start}(?![a-z])", identifier)), identifier)


def freedom_of(label: str) -> float:
    return FREEDOM.get(label, UNKNOWN)


def postfix(expression: str) -> list[str]:
    """A lower-case licence expression in postfix order, by the shunting-yard method.

    It ends before the first token that can't go on with it (a comment's end, prose). ValueError if what was read so far is
    no expression: nothing, an operator without an operand, a parenthesis that isn't closed.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether one is due
    at = 0
    while m := _TOKEN.match(expression, at):
        token = m[1]
        if token == "(" or (token not in PRECEDENCE and token != ")"):
            if not operand:
                break
            if token == "(":
                waiting.append(token)
            else:
                out.append(token)
                operand = False
        elif operand:
            raise ValueError(f"operand expected before {token!r}")
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                break
            waiting.pop()
        else:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        at = m.end()
    if operand or "(" in waiting:
        raise ValueError("the expression isn't complete")
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[list[str], float]:
    """The labels of a lower-case expression, and its freedom: of an `or` the freer side, of an `and` the less free one; an
    exception behind `with` takes away half of what is missing. A fault gives no labels and 0."""
    try:
        stack: list[tuple[set[str], float]] = []
        for token in postfix(expression):
            if token in PRECEDENCE:
                (b, y), (a, x) = stack.pop(), stack.pop()
                stack.append((a, (1 + x) / 2) if token == "with" else (a | b, max(x, y) if token == "or" else min(x, y)))
            else:
                stack.append(({label_of(token)}, freedom_of(label_of(token))))
        return sorted(stack[0][0]), stack[0][1]
    except ValueError:
        return [], 0.0


@functools.lru_cache(maxsize=4)
def automaton(phrases: tuple[tuple[str, str, str], ...]) -> ahocorasick.Automaton:
    """Of (kind, words, label), each between blanks so that words are met whole."""
    out = ahocorasick.Automaton()
    by_words: dict[str, list] = {}
    for kind, words, label in phrases:
        by_words.setdefault(words, []).append((kind, label, words.count(" ") + 1))
    for words, found in by_words.items():
        out.add_word(f" {words} ", (words, found))
    out.make_automaton()
    return out


def phrase_table(base: dict[str, str] = BASE) -> tuple[tuple[str, str, str], ...]:
    return (*(("base", w, label) for w, label in base.items()), *(("notice", w, label) for w, label in NOTICES.items()), *(("tag", w, "") for w in TAGS))


def findings(text: str, machine: ahocorasick.Automaton) -> tuple[int, list[tuple]]:
    """The number of a text's words, and (kind, start in words, words, what was found, labels, freedom) of all places."""
    raw = text.encode()
    words = raw.translate(_WORDS).split()
    if not words:
        return 0, []
    joined = " " + b" ".join(words).decode() + " "
    out, at, last = [], 0, -1  # last: the word that ends before the blank at `at`
    starts = None
    for end, (name, found) in machine.iter(joined):
        last += joined.count(" ", at + 1, end + 1) + (at == 0)
        at = end
        for kind, label, n in found:
            if kind != "tag":
                out.append((kind, last - n, n, name, [label], freedom_of(label)))
                continue
            if starts is None:
                starts = [m.end() for m in _WORD.finditer(raw.translate(_WORDS))]
            rest = raw[starts[last - 1] :].split(b"\n", 1)[0].decode(errors="replace").lstrip(" \t:=\"'").lower()
            labels, freedom = evaluate(rest)
            out.append((kind, last - n, n, rest.strip(), labels, freedom))
    return len(words), out


FOUND = "doc_id long, n_words long, found array<struct<kind: string, start: long, words: long, what: string, labels: array<string>, freedom: double>>"


def scan(docs: DataFrame, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words and found (kind, start, words, what, labels, freedom) for each row of docs: one narrow pass.

    Words are runs of letters and digits, and of all characters beyond ASCII, with A to Z lower-cased. One automaton finds
    the base phrases, further notices and identifier tags, wherever their words stand one after another; places may overlap.
    Behind a tag, the rest of its line is read as a licence expression. A null text is an empty one and has no words; texts
    are read whole however long; repeated rows each give a row, null ids stay, an empty table gives an empty table, other
    columns are left behind.
    """
    small_batches(docs.sparkSession)
    phrases = phrase_table(base)
    place = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("what", pa.string()), ("labels", pa.list_(pa.string())), ("freedom", pa.float64())])

    def batches(it):
        machine = automaton(phrases)
        for b in it:
            counts, found = [], []
            for t in b.column("text"):
                n, places = findings(t.as_py(), machine)
                counts.append(n)
                found.append([dict(zip(("kind", "start", "words", "what", "labels", "freedom"), p)) for p in places])
            yield pa.record_batch([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(place))], names=["doc_id", "n_words", "found"])

    return id_and_text(docs).mapInArrow(batches, FOUND)


def digests(found: DataFrame) -> DataFrame:
    """Of scan: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base and the two places are those of base phrases; base_labels and labels are distinct, sorted and joined by commas,
    empty where there are none. score is the least freedom of anything found, 0 where nothing is: unlicensed text may not
    be passed on.
    """
    base = F.filter("found", lambda x: x["kind"] == "base")
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda x: x["labels"])))), ",")
    starts = F.transform(base, lambda x: x["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_min(F.transform("found", lambda x: x["freedom"])), F.lit(0.0)).alias("score"),
    )


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(table(spark, sf_dir, "documents")))
