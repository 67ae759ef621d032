"""Similarity of names and of sets of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import bound, narrow

# Parts of a file name that say nothing about its content.
NOISE = ("最新版", "最新", "修正版", "修正", "確定版", "確定", "コピー", "copy", "backup", "bak", "final")
PLACES = ("福岡", "東京", "大阪", "本社", "支店", "沖縄", "名古屋", "横浜", "札幌", "仙台", "京都", "神戸")


def filename_stem(c: Column) -> Column:
    """A file name without extension, date, noise words and trailing places; lower case, parts joined by _."""
    name = F.regexp_replace(c, r"(?i)\.(csv|xlsx|tsv|xls)\z", "")
    name = F.regexp_replace(F.regexp_replace(name, r"^[0-9]{6,8}[_\-\s]?", ""), r"[_\-\s]?[0-9]{4,8}\z", "")
    parts = F.split(F.lower(narrow(name)), r"[-_\s.]+")
    useful = F.filter(parts, lambda p: (p != "") & ~p.isin(*NOISE) & ~p.rlike(r"^(rev[0-9]*|v[0-9]+)\z"))

    def kept(useful: Column) -> Column:
        last = F.aggregate(F.transform(useful, lambda p, i: F.when(~p.isin(*PLACES), i + 1).otherwise(F.lit(0))), F.lit(0), lambda a, x: F.greatest(a, x))
        return F.regexp_replace(F.array_join(F.slice(useful, F.lit(1), last), "_"), r"^_+|_+\z", "")

    return bound(bound(useful, kept), lambda stem: F.when(stem == "", F.lower(c)).otherwise(stem))


def bigrams(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared bigrams, counted as often as both have them, over all bigrams of two strings."""
    count = lambda items, g: F.size(F.filter(items, lambda h: h == g))

    def score(a: Column, b: Column, x: Column, y: Column) -> Column:
        shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, g: n + F.least(count(x, g), count(y, g)))
        return F.when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0)).otherwise(2.0 * shared / (F.size(x) + F.size(y)))

    # the strings are worked out once, and so are their bigrams, which are looked through for each bigram
    grams = lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), bigrams(s["a"]).alias("x"), bigrams(s["b"]).alias("y"))
    return bound(bound(F.struct(a.alias("a"), b.alias("b")), grams), lambda s: score(s["a"], s["b"], s["x"], s["y"]))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
