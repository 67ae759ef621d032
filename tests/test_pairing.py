"""Pairs of names and texts within few edits, against every pair."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import audit, pairing
from tallyloom.plans import catalogue


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
    return d[-1]


def every(rows, most):
    """rows: (block, id, text), texts of a block once each."""
    return sorted((min(i, j), max(i, j), edits(a, b)) for n, (p, i, a) in enumerate(rows) for q, j, b in rows[n + 1 :] if p == q and None not in (i, j) and i != j and edits(a, b) <= most)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_customers_whose_names_begin_otherwise_are_compared(spark, tmp_path):
    names = ["Customer#000000010", "Customer#000000020", "Customer#000000011", "Customer#100000021", "Customer#00000010", "customer#000000010", "Customer#000009910", "Custumer#000009910"]
    rows = [(i, n, 1, 0.0, "X") for i, n in enumerate([*names, names[0]])] + [(99, None, 1, 0.0, "X")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    found = got(catalogue.queries()["soft_dedupe_levenshtein"](spark, str(tmp_path)))
    assert found == every([("", i, n) for i, n in enumerate(names)], 2) and (0, 1, 1) in found and (2, 3, 2) in found


def test_names_of_any_length_are_those_of_all_pairs(spark, monkeypatch):
    """Numbers and letters, of few and of many lengths, in blocks; all pairs of a bucket in pieces of few."""
    r = random.Random(4)
    monkeypatch.setattr(pairing, "CHUNK", 50)
    for letters, lengths, n in (("ab", range(7), 90), ("0123456789", (3,), 200), ("ab山😀", (0, 1, 2, 31, 32, 33), 90)):
        names = {"".join(r.choice(letters) for _ in range(r.choice(list(lengths)))) for _ in range(n)}
        for _ in range(60):
            t = list(r.choice(sorted(names)))
            for _ in range(2):
                at = r.randrange(len(t) + 1)
                t[at : at + 1] = r.choice([[], ["x"], ["b", "x"]])
            names.add("".join(t))
        for front, back in (("", ""), ("ab", "ba")):
            rows = [(str(i % 2), f"k{i:04d}", front + t + back) for i, t in enumerate(sorted(names))]
            assert got(audit.close_names(spark.createDataFrame(rows, "b string, id string, t string"), "id", "t", F.col("b"))) == every(rows, 2)


def test_what_a_block_begins_and_ends_with_may_overlap(spark):
    rows = [("", 1, "aba"), ("", 2, "ab0ba"), ("", 3, "abzba"), ("", 4, "abxxxba")]
    df = spark.createDataFrame(rows, "b string, id int, t string")
    assert got(audit.close_names(df, "id", "t")) == every(rows, 2)
    assert got(audit.close_texts(df, "id", "t", F.col("b"), 2)) == every(rows, 2)


def test_keys_that_repeat_or_are_null(spark):
    rows = [("", 1, "1234"), ("", 1, "1235"), ("", 2, "12345"), ("", 2, "1236"), ("", None, "1237"), ("", 3, "123")]
    df = spark.createDataFrame(rows, "b string, id int, t string")
    assert got(audit.close_names(df, "id", "t")) == every(rows, 2)


def test_texts_of_a_form_are_those_of_all_pairs(spark, monkeypatch):
    """Short and long forms, with letters between digits, in cells of few; ids that repeat in other forms and blocks."""
    r = random.Random(9)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    shapes = (lambda: digits(5), lambda: f"{digits(2)}ab{digits(3)}山a{digits(1)}", lambda: digits(1) + "long " * 13 + digits(4), lambda: "no", lambda: f"12{digits(11)}")
    texts = {(b, f()) for b in "xy" for f in shapes for _ in range(25)}
    rows = [(b, i % 90 + 1 if i % 17 else None, t) for i, (b, t) in enumerate(sorted(texts))]
    df = spark.createDataFrame(rows, "b string, id long, t string")
    for most, cell, chunk, block in ((10, 4_000, 1 << 16, 64), (10, 6, 40, 4), (4, 12, 40, 3)):
        monkeypatch.setattr(audit, "CELL", cell)
        monkeypatch.setattr(pairing, "CHUNK", chunk)
        monkeypatch.setattr(pairing, "BLOCK", block)
        assert got(audit.close_texts(df, "id", "t", F.col("b"), most)) == every(rows, most)
