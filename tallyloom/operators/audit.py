"""Relational audit operators: matching, cross-source duplicates, comparisons, dictionaries and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import dates, similarity, text
from tallyloom.functions.hashing import cross_source_key
from tallyloom.operators import pairing
from tallyloom.operators.settle import parted, previous, settled, spread, together, with_share


CANDIDATES = 50  # customers that a matched call lists; phone_candidates has them all


def phone_candidates(customers: DataFrame, phones: list[str], normalized: bool = True) -> DataFrame:
    """number, customer_id: each customer of each number once, as written or normalised. All of them, however many."""
    long = customers.select("customer_id", F.explode(F.array(*[text.trimmed(F.col(p)) for p in phones])).alias("number"))
    return long.withColumn("number", text.phone(F.col("number")) if normalized else F.col("number")).where("number <> ''").distinct()


def match_phones(calls: DataFrame, customers: DataFrame, phones: list[str], call_phone: str = "raw_phone") -> DataFrame:
    """calls with matched_customer_id, candidate_count, candidates and match_type.

    A call's number is looked up as written, then normalised: exact, normalized, multi_match, no_match, invalid or
    empty. A unique number as written wins even if its normalised form is shared. Candidates are counted per number
    before the join, and only the CANDIDATES smallest ids go with a call, so a number that very many customers share
    costs no more than any other. Calls without a number have keys of their own in the joins, so they don't meet in one task;
    a number with very many calls is split by Spark's handling of skewed joins, since calls are the outer side.
    """

    def index(normalized: bool, name: str) -> DataFrame:
        found = phone_candidates(customers, phones, normalized)
        counts = found.groupBy("number").agg(F.count("*").alias(f"{name}_n"))
        first = smallest(found, "number", "customer_id", CANDIDATES)
        ids = first.groupBy("number").agg(F.array_sort(F.collect_list("customer_id")).alias(f"{name}_ids"))
        return counts.join(ids, "number").withColumnRenamed("number", name)

    out = calls.withColumns({"_raw": text.trimmed(F.col(call_phone)), "_norm": text.phone(F.col(call_phone))})
    own = lambda c: F.when(F.col(c) == "", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col(c))
    out = out.withColumns({"_raw_key": own("_raw"), "_norm_key": own("_norm")})
    out = out.join(index(False, "_raw_key").withColumnsRenamed({"_raw_key_n": "_raw_n", "_raw_key_ids": "_raw_ids"}), "_raw_key", "left").join(index(True, "_norm_key").withColumnsRenamed({"_norm_key_n": "_norm_n", "_norm_key_ids": "_norm_ids"}), "_norm_key", "left")
    by_raw, by_norm = F.coalesce("_raw_n", F.lit(0)), F.coalesce("_norm_n", F.lit(0))
    kind = (
        F.when(F.col("_raw") == "", "empty")
        .when(by_raw == 1, "exact")
        .when(F.length("_norm") < 10, "invalid")
        .when(by_norm == 1, "normalized")
        .when(F.greatest(by_raw, by_norm) > 1, "multi_match")
        .otherwise("no_match")
    )
    of_raw = (by_raw == 1) | (by_norm == 0)
    ids, number = F.when(of_raw, F.col("_raw_ids")).otherwise(F.col("_norm_ids")), F.when(of_raw, by_raw).otherwise(by_norm)
    out = out.withColumns({"normalized_phone": F.col("_norm"), "match_type": kind, "_ids": ids, "_number": number.cast("int")})
    some = F.col("match_type").isin("exact", "normalized", "multi_match")
    out = out.withColumn("candidates", F.when(some, F.array_join(F.col("_ids").cast("array<string>"), ";")).otherwise(""))
    out = out.withColumn("candidate_count", F.when(some, F.col("_number")).otherwise(0))
    out = out.withColumn("matched_customer_id", F.when(F.col("match_type").isin("exact", "normalized"), F.get("_ids", F.lit(0))))
    return out.drop("_raw", "_norm", "_raw_key", "_norm_key", "_raw_n", "_raw_ids", "_norm_n", "_norm_ids", "_ids", "_number")


def smallest(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The rows with the k smallest values of each group. Spark keeps k of a group at most in each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(value))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


SEVERITY = {"multi_match": "high", "no_match": "medium", "invalid": "low"}


def review_queue(matched: DataFrame) -> DataFrame:
    """The calls that nobody or several customers answer to, with severity and priority."""
    severity = F.element_at(F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p]), F.col("match_type"))
    queue = matched.where(F.col("match_type").isin(*SEVERITY)).withColumn("severity", severity)
    return queue.withColumn("priority", F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3))


def mark_cross_source(a: DataFrame, b: DataFrame) -> DataFrame:
    """b with fp, strict_dup (its date, staff and content are in a) and loose_dup (date and staff are, with other content).

    a and b: call_date, call_staff, content.
    """
    with_key = lambda df: df.withColumn("fp", cross_source_key(F.col("call_date"), F.col("call_staff"), F.col("content")))
    keys = with_key(a).groupBy("call_date", "call_staff", "fp").agg(F.count("*").alias("n"))
    strict = keys.select("fp").distinct().withColumn("_strict", F.lit(True))
    loose = keys.groupBy("call_date", "call_staff").agg(F.min("fp").alias("_least"), F.max("fp").alias("_most"))
    out = with_key(b).join(strict, "fp", "left").join(loose, ["call_date", "call_staff"], "left")
    is_strict = F.coalesce("_strict", F.lit(False))
    other = F.coalesce((F.col("_least") != F.col("fp")) | (F.col("_most") != F.col("fp")), F.lit(False))
    return out.withColumns({"strict_dup": is_strict, "loose_dup": ~is_strict & other}).drop("_strict", "_least", "_most")


def overlap(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
    """One row: distinct keys on each side, in both, and on one side only, with the shared share of all."""
    left, right = (df.select(key.alias("k")).distinct().withColumn(n, F.lit(1)) for df, n in ((a, "a"), (b, "b")))
    both = left.join(right, "k", "full_outer")
    out = both.agg(F.count("a").alias("a_keys"), F.count("b").alias("b_keys"), F.count_if(F.expr("a = 1 and b = 1")).alias("shared"), F.count_if(F.expr("b is null")).alias("a_only"), F.count_if(F.expr("a is null")).alias("b_only"), F.count("*").alias("n"))
    return out.select("a_keys", "b_keys", "shared", "a_only", "b_only", F.round(F.col("shared") / F.greatest("n", F.lit(1)), 4).alias("shared_rate"))


def rows_per_key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, a_rows, b_rows where the two have different numbers of rows."""
    x, y = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((a, "a_rows"), (b, "b_rows")))
    out = x.join(y, key, "full_outer").select(key, F.coalesce("a_rows", F.lit(0)).alias("a_rows"), F.coalesce("b_rows", F.lit(0)).alias("b_rows"))
    return out.where("a_rows <> b_rows")


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: the distinct ids that only one of the two has, with its name, a or b."""
    both = a.select(key, F.lit("a").alias("side")).unionByName(b.select(key, F.lit("b").alias("side")))
    sides = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("side").alias("side"), F.max("side").alias("_other"))
    return sides.where("side = _other").drop("_other")


def positional_compare(a: DataFrame, b: DataFrame, columns: list[str], order: str = "row_index") -> DataFrame:
    """field, rows, matches, match_rate, first_difference of rows with the same place in two files."""
    joined = a.select(order, F.struct(*columns).alias("x")).join(b.select(order, F.struct(*columns).alias("y")), order)
    cells = F.array(*[F.struct(F.lit(c).alias("field"), (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))).alias("same")) for c in columns])
    return joined.select(order, F.inline(cells)).groupBy("field").agg(F.count("*").alias("rows"), F.count_if("same").alias("matches"), F.round(F.avg(F.col("same").cast("int")), 4).alias("match_rate"), F.min(F.when(~F.col("same"), F.col(order))).alias("first_difference"))


def dictionary(df: DataFrame, column: str, key: str, samples: int = 3) -> DataFrame:
    """value, n, share and the smallest ids of each value. No value's ids are gathered: at every step `samples` are kept."""
    rows = df.select(F.col(column).alias("value"), F.col(key).alias("_id"))
    counts = rows.groupBy("value").agg(F.count("*").alias("n"))
    first = smallest(rows.where("_id is not null").distinct(), "value", "_id", samples)
    ids = first.groupBy(F.col("value").alias("_value")).agg(F.array_join(F.array_sort(F.collect_list("_id")).cast("array<string>"), ";").alias("sample_ids"))
    out = counts.join(ids, F.col("value").eqNullSafe(F.col("_value")), "left").drop("_value")
    return with_share(out.withColumn("sample_ids", F.coalesce("sample_ids", F.lit(""))))


def column_profile(df: DataFrame, columns: list[str], order: str = "row_index", most: int = 10_000, counts: DataFrame | None = None) -> DataFrame:
    """field, total, non_empty, missing_rate, distinct_values (at most `most`), capped, exact_distinct, smallest, largest.
    counts: df's value_counts, where they are kept for more than this."""
    total = df.agg(F.count("*").alias("total"))
    counts = value_counts(df, columns, order) if counts is None else counts
    stats = counts.groupBy("field").agg(F.sum("n").alias("non_empty"), F.count("*").alias("d"), F.min("value").alias("smallest"), F.max("value").alias("largest"))
    fields = df.sparkSession.createDataFrame([(c,) for c in columns], "field string")
    out = fields.join(stats, "field", "left").join(F.broadcast(total))  # one row
    n = F.coalesce("non_empty", F.lit(0))
    return out.select("field", "total", n.alias("non_empty"), F.round(1 - n / F.greatest("total", F.lit(1)), 4).alias("missing_rate"), F.least(F.coalesce("d", F.lit(0)), F.lit(most)).alias("distinct_values"), (F.coalesce("d", F.lit(0)) >= most).alias("capped"), F.coalesce("d", F.lit(0)).alias("exact_distinct"), "smallest", "largest")


def value_counts(df: DataFrame, columns: list[str], order: str = "row_index") -> DataFrame:
    """field, value, n, first_row of values that are not blank. One pass; equal values are added up before the shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), text.trimmed(F.col(c)).alias("value")) for c in columns])
    return df.select(F.col(order), F.inline(cells)).where("value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"), F.min(order).alias("first_row"))


def top_values(df: DataFrame, columns: list[str], k: int = 10, order: str = "row_index", counts: DataFrame | None = None) -> DataFrame:
    """The k most frequent values of each column; of equals the one seen first. counts as in column_profile."""
    counts = value_counts(df, columns, order) if counts is None else counts
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "first_row", "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k).select("field", "place", "value", "n")


# Patterns that tell a column's type, the first that fits.
TYPES = (
    ("date", r"^([0-9]{4}[/\-][0-9]{1,2}[/\-][0-9]{1,2}|(明治|大正|昭和|平成|令和)[0-9]{1,2}年[0-9]{1,2}月[0-9]{1,2}日)\z"),
    ("phone", r"^0[0-9\-]{9,12}\z"),
    ("email", "@"),
    ("boolean", r"^(○|×|◯|✓|✗|true|false|TRUE|FALSE|はい|いいえ|1|0)\z"),
    ("number", r"^-?[0-9,.]+\z"),
)


def infer_types(df: DataFrame, columns: list[str], threshold: float = 0.6) -> DataFrame:
    """field, type: the first type that more than the threshold of a column's values have, else text; empty for none."""
    value = F.col("value")
    kind = reduce(lambda w, t: w.when(value.rlike(t[1]), t[0]), TYPES[1:], F.when(value.rlike(TYPES[0][1]), TYPES[0][0])).otherwise("text")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), text.trimmed(F.col(c)).alias("value")) for c in columns])
    kinds = df.select(F.inline(cells)).where("value <> ''").select("field", kind.alias("kind"))  # worked out once, not once a type
    seen = kinds.groupBy("field").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == t).alias(t) for t, _ in TYPES])
    fits = reduce(lambda w, t: w.when(F.col(t) / F.col("n") > threshold, t), [t for t in ("phone", "email", "number", "boolean")], F.when(F.col("date") / F.col("n") > threshold, "date")).otherwise("text")
    fields = df.sparkSession.createDataFrame([(c,) for c in columns], "field string")
    return fields.join(seen, "field", "left").select("field", F.when(F.col("n").isNull(), "empty").otherwise(fits).alias("type"))


def dataset_profile(df: DataFrame, columns: list[str], order: str = "row_index") -> DataFrame:
    """field, non_empty_rate, unique_rate, type, and whether a column may be a key, a date or a phone number."""
    p = column_profile(df, columns, order, most=(1 << 62)).join(infer_types(df, columns), "field")
    filled = F.col("non_empty") / F.greatest("total", F.lit(1))
    unique = F.coalesce(F.col("distinct_values") / F.nullif("non_empty", F.lit(0)), F.lit(0.0))
    named = F.col("field").rlike("電話|TEL|FAX")
    return p.select(
        "field",
        F.round(filled, 4).alias("non_empty_rate"),
        F.round(unique, 4).alias("unique_rate"),
        "type",
        ((filled > 0.95) & (unique > 0.8)).alias("key_candidate"),
        (F.col("type") == "date").alias("date_candidate"),
        ((F.col("type") == "phone") | named).alias("phone_candidate"),
    )


def mojibake(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, replaced, latin, control: signs of text that was decoded wrongly."""
    c = text.text(F.col(column))
    count = lambda kept: F.length(F.regexp_replace(c, f"[^{kept}]", "")).cast("long")
    latin = count("À-ÿ")
    return df.select(key, count("�").alias("replaced"), latin.alias("latin"), count(r"\x00-\x08\x0B\x0C\x0E-\x1F").alias("control"), ((F.length(c) >= 4) & (latin >= 2)).alias("suspect"))


def deletions(c: Column, most: int) -> Column:
    """A string and all that is left of it with up to `most` characters taken out, each once."""
    out = last = F.array(c)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.left(s, i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>")))))
        out = F.array_union(out, last)
    return out


SHORT_NAME = pairing.SHORT  # letters of a name that is still compared by what is left of it


def close_names(df: DataFrame, key: str, name: str, block: Column | None = None, most: int = 2) -> DataFrame:
    """a, b, distance: rows of a block (of all, where none is given) whose distinct names are within `most` edits. Equal names
    meet once, by their first row.

    Strings within so many edits have a string in common that is left of both when as many characters are taken out, so
    only names that share one are compared, and a large block of unlike names costs rows in proportion to its size. Of names
    that all of a block begin or end alike only the rest is taken apart. Names of one length, of which numbered ones are
    nearly all, meet where the same letters are taken out, which only results do, and each is given once where it is found
    (pairing.one_length, for two edits): no pair is shuffled. Spark takes exploded rows for as few as they come from and would
    send them to all tasks through the driver, so the sides are merged, here and in what follows. Names beyond SHORT_NAME
    letters, of which there would be too many such strings, meet by their segments (close_texts).
    """
    block = F.lit(0) if block is None else block
    names = settled(_inner(df.groupBy(block.alias("block"), F.col(name).alias("text")).agg(F.min(key).alias("id")).where("text is not null and id is not null")))
    short, length = names.where(F.length("text") <= SHORT_NAME), F.length("text")
    bulk = most == 2  # whether names of one length are met by themselves
    # the lengths that a block has, since only names that have others somewhat longer or shorter are taken apart here
    kinds = names.groupBy("block").agg(F.collect_set(F.least(length, F.lit(SHORT_NAME + most + 1))).alias("lengths"))
    others = F.exists(F.sequence(F.lit(-most), F.lit(most)), lambda d: (d != 0) & F.array_contains("lengths", length + d))
    apart = short.join(kinds, "block").where(others) if bulk else short
    parts = apart.select("block", "id", length.alias("n"), F.explode(deletions(F.col("text"), most)).alias("part"))
    left, right = (parts.select(F.xxhash64("block", "part").alias("key"), F.col("n").alias(f"n{i}"), F.col("id").alias(i)) for i in ("a", "b"))
    met = left.join(right.hint("merge"), "key").where("na < nb and a <> b" if bulk else "a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    long = segment_pairs(names.where(length > SHORT_NAME - most), most)
    found = _within(met.unionByName(long).distinct(), names, most, (lambda x, y: (F.length(x) != F.length(y)) | (F.length(x) > SHORT_NAME)) if bulk else None)
    return found.unionByName(_of_one_length(short)) if bulk else found


def _of_one_length(names: DataFrame) -> DataFrame:
    """a, b, distance of names (block, id, text) of one length, SHORT_NAME letters at most, that are within two edits."""
    kind = dict(names.dtypes)["id"]
    left = spread(names.select(F.xxhash64("block").alias("block"), "id", "text"), "id").mapInArrow(pairing.left_of_names, f"key long, at int, id {kind}, text string")
    return spread(left, "key").sortWithinPartitions("key").mapInArrow(pairing.one_length, f"a {kind}, b {kind}, distance int")


CELL = 4_000  # texts that meet so many others at most in one piece of work


def close_texts(df: DataFrame, key: str, column: str, block: Column, most: int = 10) -> DataFrame:
    """a, b, distance: rows of a block whose distinct texts are within `most` edits, where that are many (close_names for few).

    Texts without what all of a block share at their ends (_inner) have a form, in which every digit is 0. Texts of one form
    with at most `most` digits are all within `most` edits and are paired straight away (_alike), however many. Distances of
    forms are no greater than those of texts, so of different forms only texts whose forms are close are compared; forms meet
    by their segments, and so do texts with more digits.
    """
    texts = settled(_inner(df.groupBy(block.alias("block"), F.col(column).alias("text")).agg(F.min(key).alias("id")).where("text is not null and id is not null")))
    many = _digits(F.col("text"), most)
    few = texts.where(~many).withColumn("form", F.regexp_replace("text", "[0-9]", "0"))
    # a form is known by its first id, and by a hash, since ids may repeat
    forms = settled(few.groupBy("block", "form").agg(F.struct(F.min("id").alias("id"), F.xxhash64("block", "form").alias("hash")).alias("of"), F.count("*").alias("n")))
    members = few.join(forms.hint("merge"), ["block", "form"])
    as_texts = forms.select("block", F.col("of").alias("id"), F.col("form").alias("text"))
    side = lambda f, i, t: members.select(F.col("of").alias(f), F.col("id").alias(i), F.col("text").alias(t))
    near = _within(segment_pairs(as_texts, most).distinct(), as_texts, most).select(F.col("a").alias("f"), F.col("b").alias("g"))
    met = near.join(side("f", "i", "x").hint("merge"), "f").join(side("g", "j", "y").hint("merge"), "g").where("i <> j")
    out = _alike(members, most).unionByName(_measured(met, most))
    if texts.where(many).limit(1).count() == 0:
        return out
    rest = segment_pairs(texts.withColumn("some", many), most, "some").distinct()
    some = lambda x, y: _digits(x, most) | _digits(y, most)
    return out.unionByName(_within(rest, texts, most, some))


def _alike(members: DataFrame, most: int) -> DataFrame:
    """a, b, distance of all pairs of texts (of, n, id, text) of one form (of), of which there are n.

    A form's texts are dealt into cells of about CELL, and each pair of cells is a piece of work, with its texts, so no task
    holds a form and no pair is shuffled. Distances are worked out in bulk (pairing.alike), of texts that differ over more than
    pairing.WHOLE letters one by one. There are as many parts as the session has for shuffles: by bytes, of which texts are few
    and pairs many, adaptive execution would make fewer.
    """
    several = members.where("n > 1")
    sizes = several.groupBy("of").agg(F.max("n").alias("n")).withColumnRenamed("of", "block")
    texts = _inner(several.select(F.col("of").alias("block"), "id", "text"), "merge").join(sizes.hint("merge"), "block")
    cells = F.ceil(F.col("n") / CELL).cast("int")
    cut = texts.withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("text"), F.col("cells")).cast("int"))
    left = cut.select("block", F.col("cell").alias("p"), F.explode(F.sequence("cell", F.col("cells") - 1)).alias("q"), F.lit(0).alias("side"), "id", "text")
    right = cut.where("cell > 0").select("block", F.explode(F.sequence(F.lit(0), F.col("cell") - 1)).alias("p"), F.col("cell").alias("q"), F.lit(1).alias("side"), "id", "text")
    at, kind = ["block", "p", "q"], dict(texts.dtypes)["id"]
    whole = F.length("text") <= pairing.WHOLE
    pieces = left.where(whole).unionByName(right.where(whole)).withColumn("block", F.xxhash64("block"))
    out = spread(pieces, *at).sortWithinPartitions(*at, "side").mapInArrow(pairing.alike, f"a {kind}, b {kind}, distance int")
    x = left.where(~whole).select(*at, F.col("id").alias("i"), F.col("text").alias("x"))
    y = left.where("p = q").unionByName(right).where(~whole).select(*at, F.col("id").alias("j"), F.col("text").alias("y"))
    long = spread(x, *at).join(spread(y, *at).hint("merge"), at).where("i <> j and (p < q or x < y)")
    return out.unionByName(_measured(long, most))


def _digits(x: Column, most: int) -> Column:
    """Whether a text has more than so many digits."""
    return F.length(x) - F.length(F.regexp_replace(x, "[0-9]", "")) > most


def _measured(met: DataFrame, most: int) -> DataFrame:
    """a, b, distance of texts x and y, with the ids i and j, that are within `most` edits."""
    near = met.withColumn("distance", F.levenshtein("x", "y", most)).where("distance >= 0")
    return near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")


def _inner(texts: DataFrame, blocks: str = "none") -> DataFrame:
    """texts (block, text, id) without what all of a block begin and end with, which makes no difference to distances.
    blocks: a hint for joining what they share, where there may be as many blocks as texts."""
    ends = F.array(F.col("text"), F.reverse("text"))
    same = texts.groupBy("block").agg(*[f(ends[i]).alias(f"_{n}{i}") for i in (0, 1) for n, f in (("low", F.min), ("high", F.max))], F.min(F.length("text")).alias("_short"))
    # what the first and the last in order share, all between them do
    letters = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    differ = lambda x, y: F.array_position(F.zip_with(letters(x), letters(y), lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int")
    shared = lambda x, y: F.when(x == y, F.length(x)).otherwise(differ(x, y) - 1)
    same = same.select("block", shared(F.col("_low0"), F.col("_high0")).alias("_front"), shared(F.col("_low1"), F.col("_high1")).alias("_back"), "_short")
    cut = texts.join(same if blocks == "none" else same.hint(blocks), "block")
    rest = F.length("text") - F.col("_front") - F.when(F.col("_front") + F.col("_back") <= F.col("_short"), F.col("_back")).otherwise(0)
    return cut.select("block", "id", F.substring("text", F.col("_front") + 1, F.greatest(rest, F.lit(0))).alias("text"))


def _within(pairs: DataFrame, texts: DataFrame, most: int, kept=None) -> DataFrame:
    """a, b, distance of those pairs of ids whose texts are of one block and within so many edits. kept: a condition on both
    texts, where others are not asked for."""
    side = lambda i, t: texts.select(F.col("id").alias(i), F.col("block").alias(f"_{i}"), F.col("text").alias(t))
    met = pairs.join(side("a", "x").hint("merge"), "a").join(side("b", "y").hint("merge"), "b").where(F.col("_a").eqNullSafe(F.col("_b")))
    met = met.where(kept(F.col("x"), F.col("y"))) if kept else met
    return met.withColumn("distance", F.levenshtein("x", "y", most)).where("distance >= 0").select("a", "b", "distance")


def segment_pairs(texts: DataFrame, most: int, some: str | None = None) -> DataFrame:
    """a, b, of a < b: pairs of texts (block, id, text) that may be within `most` edits, some of them repeatedly. some: a
    column that is true for at least one text of each pair asked for.

    Each text is cut into most + 1 segments of even length. Of two texts within so many edits, one segment of the shorter
    stands unchanged in the longer one, moved by no more places than edits before and behind it allow. So a text is indexed
    by its segments and asks, for each length up to `most` shorter than its own, for the segments that it holds in these
    windows. Keys are hashes of block, length, segment and letters; what they bring together is compared by the caller.
    Texts of at most `most` letters have no such segments and meet all of a like length.
    """
    k = F.lit(most)
    n = most + 1
    x, length = F.col("text"), F.length("text")

    def segment(size: Column, i: Column) -> tuple[Column, Column]:
        base, long = F.floor(size / n).cast("int"), n - size % n
        return i * base + F.greatest(i - long, F.lit(0)), base + (i >= long).cast("int")

    texts = texts.withColumn("some", F.col(some) if some else F.lit(True))
    numbered_ = F.explode(F.sequence(F.lit(0), k)).alias("i")
    mine = texts.where(length > k).select("block", "id", "text", "some", length.alias("size"), numbered_)
    start, size = segment(F.col("size"), F.col("i"))
    index = mine.select(F.xxhash64("block", "size", "i", F.substring(x, start + 1, size)).alias("key"), F.col("id").alias("of"), F.col("some").alias("of_some"))
    asks = texts.where(length > k).select("block", "id", "text", "some", length.alias("own"), F.explode(F.sequence(F.lit(0), k)).alias("d")).where(F.col("own") - F.col("d") > k)
    asks = asks.withColumn("size", F.col("own") - F.col("d")).select("*", numbered_)
    start, size = segment(F.col("size"), F.col("i"))
    i, d = F.col("i"), F.col("d")
    low = F.greatest(start - i, start + d - (k - i), F.lit(0))
    high = F.least(start + i, start + d + (k - i), F.col("own") - size)
    asks = asks.withColumns({"low": low, "high": high, "long": size}).where("low <= high")
    asks = asks.select("*", F.explode(F.sequence("low", "high")).alias("at"))
    asks = asks.select(F.xxhash64("block", "size", "i", F.substring(x, F.col("at") + 1, F.col("long"))).alias("key"), "id", "some", "d").distinct()
    met = asks.where("some").join(index.hint("merge"), "key")
    if some:
        met = met.unionByName(asks.where("not some").join(index.where("of_some").hint("merge"), "key"))
    met = met.where((F.col("id") != F.col("of")) & ((F.col("d") > 0) | (F.col("id") > F.col("of"))))
    pair = lambda df, p, q: df.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    brief = texts.where(length <= k).select("block", F.col("id").alias("of"), F.col("some").alias("of_some"), length.alias("size"))
    near = texts.where(length <= 2 * k).select("block", "id", "some", length.alias("own"))
    little = near.join(brief.hint("merge"), "block").where("(some or of_some) and id <> of").where((F.col("own") - F.col("size") <= k) & ((F.col("own") > F.col("size")) | ((F.col("own") == F.col("size")) & (F.col("id") > F.col("of")))))
    return pair(met, "id", "of").unionByName(pair(little, "id", "of"))


def latest_before(runs: DataFrame) -> DataFrame:
    """Each run with the latest earlier run of its key, one of the same profile first.

    runs: run_id, source, profile, started_at. Two running values over each key's runs, also where one source has very many
    (settle.parted); no run is joined to another.
    """
    order, parts = ["started_at", "run_id"], []
    for part in parted(runs, ["source"], order):
        part = previous(part, ["source", "profile"], order, {"_same": F.col("run_id")})
        parts.append(previous(part, ["source"], order, {"_any": F.col("run_id")}))
    return together(parts).withColumn("previous_run", F.coalesce("_same", "_any")).drop("_same", "_any")


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """df with rows numbered from 1 in an order over all of it, without one task that holds all.

    Rows are cut into ranges and sorted there, once, and kept (settled); a row's number is its place in its range and the
    sizes of the ranges before, of which there is one row each.
    """
    at = F.monotonically_increasing_id()  # the range above bit 33, the place in it below
    spread = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    spread = spread.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are ranges
    sizes = spread.groupBy("_range").agg(F.count("*").alias("_size"))
    bases = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    out = spread.join(F.broadcast(bases), "_range")
    return out.withColumn(name, (F.col("_base") + F.col("_place") + 1).cast("long")).drop("_at", "_range", "_place", "_base")


# --- two sources of the same activities ------------------------------------------------------------------------------


def overlap_conclusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row on two sources' activities (call_date, call_staff, content): keys of each, shared ones, by content and by date
    and staff alone, both rates, and what follows: same_export, partial_overlap or separate_systems."""
    strict = overlap(a, b, cross_source_key(F.col("call_date"), F.col("call_staff"), F.col("content")))
    loose = overlap(a, b, F.concat_ws("|", text.text(F.col("call_date")), text.trimmed(text.narrow(F.col("call_staff")))))
    named = lambda df, prefix: df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("a_keys", "b_keys", "shared", "a_only", "b_only")])
    both = named(strict, "strict").join(F.broadcast(named(loose, "loose")))  # one row each
    rate = lambda p: F.coalesce(F.col(f"{p}_shared") / F.nullif(F.col(f"{p}_a_keys"), F.lit(0)), F.lit(0.0))
    conclusion = F.when(rate("strict") > 0.9, "same_export").when((rate("strict") > 0.3) | (rate("loose") > 0.5), "partial_overlap").otherwise("separate_systems")
    return both.withColumns({"strict_rate": F.round(rate("strict"), 4), "loose_rate": F.round(rate("loose"), 4), "conclusion": conclusion})


def merge_policies(marked: DataFrame, a: DataFrame) -> DataFrame:
    """policy, total_rows, a_rows, b_rows, handled, review_rows: what three ways of merging two sources would keep, from the
    marks of mark_cross_source."""
    n = a.agg(F.count("*").alias("a"))
    b = marked.agg(F.count("*").alias("b"), F.count_if("strict_dup").alias("s"), F.count_if("loose_dup").alias("l"))
    row = lambda name, kept, handled, review: F.struct(F.lit(name).alias("policy"), (F.col("a") + kept).alias("total_rows"), F.col("a").alias("a_rows"), kept.alias("b_rows"), handled.alias("handled"), review.alias("review_rows"))
    zero = F.lit(0).cast("long")
    rows = F.array(row("keep_all", F.col("b"), zero, zero), row("soft_dedupe", F.col("b") - F.col("s"), F.col("s"), F.col("l")), row("a_primary", F.col("b") - F.col("s"), F.col("s"), zero))
    return b.join(F.broadcast(n)).select(F.inline(rows))


def activities(*sources: DataFrame) -> DataFrame:
    """All sources' activities, one after the other, none taken for another's copy."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def active(calls: DataFrame) -> DataFrame:
    return calls.where("review_status = 'active'")


def row_source(file: str, row: Column) -> Column:
    """A row's place in its file, counted with the header."""
    return F.concat(F.lit(f"{file}:row_"), (row + 2).cast("string"))


def staging(df: DataFrame, file: str, fields: dict[str, str], row: str = "row_index", more: dict[str, Column] | None = None) -> DataFrame:
    """Columns under their staging names, blank where the file has none, with the file, row and source of each, and more
    columns made of the same row."""
    have = set(df.columns)
    named = [(text.trimmed(F.col(f"`{c}`")) if c in have else F.lit("")).alias(n) for n, c in fields.items()]
    return df.select(*named, F.lit(file).alias("raw_source_file"), (F.col(row) + 2).cast("string").alias("raw_row_origin"), row_source(file, F.col(row)).alias("source_fingerprint"), *[v.alias(n) for n, v in (more or {}).items()])


def staging_calls(df: DataFrame, file: str, fields: dict[str, str], matched: bool, row: str = "row_index") -> DataFrame:
    """Activities of a source of its own (matched: match_phones has been asked), or of a customer sheet whose rows carry the
    customer above them (_filled_customer_id). One row for each of df, also where rows of several files share a number."""
    if matched:
        more = {c: F.col(c).cast("string") for c in ("matched_customer_id", "candidate_count", "match_type")}
    else:
        customer = text.text(F.col("_filled_customer_id"))
        more = {"matched_customer_id": customer, "candidate_count": F.when(customer != "", "1").otherwise("0"), "match_type": F.when(customer != "", "fill_forward").otherwise("no_match")}
    out = staging(df, file, fields, row, more | {"source_kind": F.lit("source_a" if matched else "source_b")})
    return out.withColumn("call_date", dates.date(F.col("call_date")))


def status_final(dictionary: DataFrame, answers: DataFrame) -> DataFrame:
    """value, stage_before, stage, certainty, revised, basis: each status with the stage that somebody confirmed for it
    (value, confirmed_stage, confirmed_by), else its own where that is certain, else unresolved."""
    one = answers.where(~text.blank(F.col("confirmed_stage"))).groupBy("value").agg(F.min(F.struct(text.trimmed(F.col("confirmed_stage")).alias("s"), text.trimmed(F.col("confirmed_by")).alias("b"))).alias("_a"))
    out = dictionary.join(one, "value", "left")
    sure, said = F.col("certainty") == "high", F.col("_a.s")
    stage = F.coalesce(said, F.when(sure, F.coalesce(F.nullif(F.col("stage"), F.lit("")), F.lit("unresolved"))), F.lit("unresolved"))
    basis = F.when(said.isNotNull(), F.concat(F.lit("hearing:"), F.coalesce(F.nullif(F.col("_a.b"), F.lit("")), F.lit("?")))).when(sure, "inherited").otherwise("provisional")
    out = out.withColumns({"stage_before": F.col("stage"), "_stage": stage, "basis": basis, "_sure": F.when(said.isNotNull() | sure, "high").otherwise(F.coalesce("certainty", F.lit("low")))})
    return out.select("value", "stage_before", F.col("_stage").alias("stage"), F.col("_sure").alias("certainty"), (said.isNotNull() & (F.col("_stage") != F.coalesce("stage_before", F.lit("")))).alias("revised"), "basis")


# --- columns by name and values --------------------------------------------------------------------------------------

# Parts of column names that tell what a column holds.
DATE_NAMES = ("日", "時刻", "date", "time", "生年月日", "発送", "到着", "完了", "完工", "申請", "着日", "書着", "許可", "連系", "入金", "納品")
AMOUNT_NAMES = ("原価", "単価", "料金", "粗利", "金額", "月額", "price", "cost", "amount", "計上")
PERIOD_NAMES, COUNT_NAMES, QUANTITY_NAMES = ("計上月", "年月"), ("枚数", "品数", "回数"), ("kw",)
# Patterns of the values that names call for, and of those that tell a type alone.
DATE_VALUE = r"^([0-9]{4}[/\-][0-9]{1,2}[/\-][0-9]{1,2}|(明治|大正|昭和|平成|令和)[0-9]{1,2}年[0-9]{1,2}月[0-9]{1,2}日)\z"
TIMED_VALUE = r"^[0-9]+時間|^[0-9]{1,5}(\.[0-9]+)?\z"
PHONE_VALUE, NUMBER_VALUE = r"^[0-9][0-9\-]{8,12}\z", r"^-?[0-9,.]+\z"


def infer_types_by_name(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, type: what a column's name says, if enough of its values agree; else as most of the values are; empty for none.

    A name that speaks of a time or a duration is believed. Dates need 3 values in 10, other names half, values alone 6.
    """
    v = F.col("value")
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    tests = {
        "dated": v.rlike(DATE_VALUE) | v.rlike(TIMED_VALUE),
        "period": v.rlike(r"^[0-9]{4,6}\z"),
        "whole": v.rlike(r"^[0-9]+\z"),
        "decimal": v.rlike(r"^[0-9.]+\z"),
        "number": v.rlike(NUMBER_VALUE),
        "date": v.rlike(DATE_VALUE),
        "phone": v.rlike(PHONE_VALUE) & digits.between(10, 11),
        "email": v.contains("@"),
    }
    # of the value types a value counts for the first that it is
    alone = {"date": tests["date"], "phone": ~tests["date"] & tests["phone"], "email": ~tests["date"] & ~tests["phone"] & tests["email"]}
    alone["number"] = ~tests["date"] & ~tests["phone"] & ~tests["email"] & tests["number"]
    cells = F.array(*[F.struct(F.lit(c).alias("field"), text.trimmed(F.col(f"`{c}`")).alias("value")) for c in columns])
    seen = df.select(F.inline(cells)).where("value <> ''").groupBy("field").agg(F.count("*").alias("n"), *[F.count_if(t).alias(f"t_{k}") for k, t in tests.items()], *[F.count_if(t).alias(f"a_{k}") for k, t in alone.items()])
    out = df.sparkSession.createDataFrame([(c,) for c in columns], "field string").join(seen, "field", "left")
    name = F.lower(text.narrow(F.col("field")))
    has = lambda words: reduce(lambda a, w: a | F.contains(name, F.lit(w)), words, F.lit(False))
    share = lambda k: F.col(k) / F.col("n")
    dated, timed, lasting = has(DATE_NAMES), has(("時刻", "time")), has(("時間",))
    kind = (
        F.when(F.col("n").isNull(), "empty")
        .when(dated & timed & ~lasting, "time")
        .when(dated & lasting, "duration")
        .when(dated & (share("t_dated") > 0.3), "date")
        .when(has(PERIOD_NAMES) & ~dated & (share("t_period") > 0.5), "period")
        .when(has(AMOUNT_NAMES) & ~dated & (share("t_number") > 0.5), "amount")
        .when(has(COUNT_NAMES) & (share("t_whole") > 0.5), "count")
        .when(has(QUANTITY_NAMES) & (share("t_decimal") > 0.5), "quantity")
    )
    for k in ("date", "phone", "email", "number"):
        kind = kind.when(share(f"a_{k}") > 0.6, k)
    return out.select("field", kind.otherwise("text").alias("type"))


def comparable(value: Column, name: str, serial: Column | None = None) -> Column:
    """A cell of a sheet or a text file in one form, to compare them: dates as YYYY-MM-DD, durations as HH:MM:SS. serial is
    the sheet's number, where the cell held one."""
    dated = any(w in name.lower() for w in DATE_NAMES)
    v = text.trimmed(value)
    plain = F.when(v.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\z"), dates.date(v)).otherwise(dates.duration(v) if dated else v)
    if serial is None or not dated:
        return plain
    return F.when(serial >= 1, dates.excel_date(serial)).when(serial >= 0, dates.excel_time(serial)).otherwise(plain)


def row_diagnosis(df: DataFrame, key: str, children: list[str], columns: list[str]) -> DataFrame:
    """One row: how many rows of a sheet are a master's, a child's, both, neither, and empty."""
    master = ~text.blank(F.col(key))
    child = reduce(lambda a, c: a | ~text.blank(F.col(f"`{c}`")), children, F.lit(False))
    filled = reduce(lambda a, c: a | ~text.blank(F.col(f"`{c}`")), columns, F.lit(False))
    n = F.count_if
    return df.agg(F.count("*").alias("rows"), n(master).alias("master_rows"), n(child).alias("child_rows"), n(master & child).alias("master_and_child"), n(~master & ~child).alias("unaccounted"), n(~filled).alias("empty_rows"), F.count_distinct(F.when(master, F.col(key))).alias("masters"))


def normalization_candidates(profile: DataFrame) -> DataFrame:
    """field, type, rule of the columns of a dataset_profile that a normaliser should be used for."""
    has = lambda *words: reduce(lambda a, w: a | F.contains("field", F.lit(w)), words, F.lit(False))
    rule = (
        F.when(F.col("date_candidate"), "date")
        .when(F.col("phone_candidate"), "phone")
        .when(has("メール") | (F.col("type") == "email"), "email")
        .when(has("住所", "address"), "address")
        .when(has("ﾌﾘｶﾞﾅ", "フリガナ"), "kana")
        .when(F.col("field") == "時刻", "time")
        .when(F.col("field") == "日時", "datetime")
    )
    return profile.select("field", "type", rule.alias("rule")).where("rule is not null")


def review_issues(profile: DataFrame, match_types: DataFrame) -> DataFrame:
    """code, severity, subject, n: what a dataset's profile and its phone matches leave for people to look at."""
    rules = [("broken_column", "medium", F.col("field").contains("見つかりません")), ("child_columns", "high", F.col("field").contains("::")), ("serial_dates", "low", F.col("date_candidate") & (F.col("type") == "number")), ("empty_column", "info", F.col("non_empty_rate") == 0)]
    found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s, t in rules]))
    columns = profile.select(F.inline(found), F.col("field").alias("subject"), F.lit(1).cast("long").alias("n"))
    return columns.unionByName(match_types.where("match_type = 'invalid'").groupBy().agg(F.count("*").alias("n")).where("n > 0").select(F.lit("invalid_phones").alias("code"), F.lit("medium").alias("severity"), F.lit("phone").alias("subject"), "n"))


def columns_drift(runs: DataFrame) -> DataFrame:
    """run_id, previous_run, added, removed: the columns that a run has beyond the run before it, and those it lacks.

    runs: run_id, source, profile, started_at, columns (array). No previous run, no row.
    """
    pairs = latest_before(runs).where("previous_run is not null")
    old = runs.select(F.col("run_id").alias("previous_run"), F.col("columns").alias("_old"))
    out = pairs.join(old, "previous_run")
    return out.select("run_id", "previous_run", F.array_except("columns", "_old").alias("added"), F.array_except("_old", "columns").alias("removed"))


def mojibake_verdict(df: DataFrame, columns: list[str], sample: int = 50) -> DataFrame:
    """field, cells, garbled, ratio, verdict of a sample of a file's first rows: ok, suspect (0.02 of the cells or more) or
    broken (0.3 or more)."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), text.text(F.col(f"`{c}`")).alias("v")) for c in columns])
    v = F.col("v")
    latin = F.length(F.regexp_replace(v, "[^À-ÿ]", ""))
    bad = v.contains("\ufffd") | ((F.length(v) >= 4) & (latin >= 2)) | v.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    by = df.orderBy("row_index").limit(sample).select(F.inline(cells)).where("v <> ''").groupBy("field").agg(F.count("*").alias("cells"), F.count_if(bad).alias("garbled"))
    ratio = F.col("garbled") / F.col("cells")
    return by.withColumns({"ratio": F.round(ratio, 4), "verdict": F.when(ratio >= 0.3, "broken").when(ratio >= 0.02, "suspect").otherwise("ok")})
