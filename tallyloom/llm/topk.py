"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import table, written

WORD = 64  # bits of a code in one long


def sign_codes(vectors: DataFrame, bits: int) -> DataFrame:
    """vec_id, code: a struct of longs whose bits are set where the vector's elements are above 0, the first `bits` elements
    in order. Missing and null elements are not above 0. Rows without an id or vector have no code."""

    def word(first: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(min(WORD, bits - first)):
            bit = F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")
            out = out.bitwiseOR(F.when(F.get("embedding", F.lit(first + i)) > 0, bit).otherwise(F.lit(0).cast("long")))
        return out

    code = F.struct(*[word(at).alias(f"w{at // WORD}") for at in range(0, bits, WORD)])
    return vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), code.alias("code"))


def segments(bits: int, rows: int) -> list[tuple[int, int, int]]:
    """(word, shift, length) of the code's segments: about log2(rows) bits each, and 8 or more, so that a segment's value
    has a few rows however many there are. A segment lies in one word."""
    out = []
    for first in range(0, bits, WORD):
        own = min(WORD, bits - first)
        count = -(-own // max(8, rows.bit_length()))
        cuts = [own * i // count for i in range(count + 1)]
        out += [(first // WORD, a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def segment_rows(codes: DataFrame, parts: list[tuple[int, int, int]]) -> DataFrame:
    """Each code once per segment with the segment's value."""
    mask = lambda n: F.lit((1 << n) - 1 if n < 64 else -1).cast("long")
    value = lambda w, s, n: F.shiftrightunsigned(F.col(f"code.w{w}"), s).bitwiseAND(mask(n))
    rows = F.array(*[F.struct(F.lit(i).alias("segment"), F.lit(n).alias("bits"), value(w, s, n).alias("value")) for i, (w, s, n) in enumerate(parts)])
    return codes.select("*", F.inline(rows))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance: the k rows of vectors nearest to each query's code in Hamming distance.

    A code has `bits` bits, by default one for each element of the longest vector. A query is a row of vectors; it is not
    its own result. Ties go by vec_id. Rows with equal codes are one entry of the index with its k + 1 smallest ids, which
    is all that a top k can use, so a very common vector costs no more than any other. In round r the values at r flipped
    bits of each segment are probed; by then a code not yet seen differs by at least r + 1 in every segment, so a query is
    done once its (k + 1)th distance is below segments * (r + 1). The others go on, to the end of the segments if need be.
    Codes farther away than a query's (k + 1)th so far are dropped where they are met. With fewer rows than k all are
    given, and with none nothing. Vectors of null have no code and are neither queries nor results; repeated ids count
    once; other columns are left behind whatever their names.
    """
    if bits is None:
        bits = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    bits = max(bits, 1)
    coded = written(sign_codes(vectors, bits).distinct(), "codes")
    ranked = coded.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = written(ranked.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    rows, kept = entries.agg(F.count("*"), F.sum(F.size("ids"))).first()
    parts, kept = segments(bits, rows), kept or 0
    index = written(segment_rows(entries, parts).select("segment", "value", "code", "ids"), "index")
    asked = written(queries.select(F.col("vec_id").cast("long").alias("query_id")).join(coded.withColumnRenamed("vec_id", "query_id"), "query_id").distinct(), "queries")
    probes = segment_rows(asked.select("code").distinct(), parts).select(F.col("code").alias("q"), "segment", "bits", "value", F.lit(-1).alias("last"), F.lit(None).cast("int").alias("far"))
    distance = reduce(Column.__add__, [F.bit_count(F.col(f"q.w{w}").bitwiseXOR(F.col(f"code.w{w}"))) for w in range(-(-bits // WORD))]).cast("int")
    best, done = None, []
    widest = max(n for _, _, n in parts)
    for radius in range(widest + 1):
        if radius:  # one more bit flipped, behind the last one, in the segments that have such
            probes = probes.where("last + 1 < bits").withColumn("last", F.explode(F.sequence(F.col("last") + 1, F.col("bits") - 1)))
            probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, last)")))
        probes = written(probes, "probes")
        seen = probes.join(index, ["segment", "value"]).select("q", distance.alias("distance"), "code", "ids", "far")
        seen = seen.where("far is null or distance <= far").dropDuplicates(["q", "code"])
        found = seen.select("q", "distance", F.explode("ids").alias("vec_id"))
        found = found if best is None else found.union(best.join(left, "q", "left_semi")).distinct()
        place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id"))
        best = written(found.withColumn("place", place).where(F.col("place") <= k + 1).select("q", "distance", "vec_id"), "best")
        enough = min(k + 1, kept)
        state = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        covered = F.lit(radius == widest) | (F.col("n") >= enough) & ((F.col("far") < len(parts) * (radius + 1)) | F.lit(kept <= k + 1))
        state = written(state.select("q", F.when(F.col("n") >= enough, F.col("far")).alias("far"), covered.alias("ready")), "state")
        done.append(best.join(state.where("ready"), "q", "left_semi"))
        left = state.where("not ready").select("q", "far")
        if radius == widest or left.limit(1).count() == 0:
            break
        probes = probes.drop("far").join(left, "q")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    hits = asked.join(out, asked.code == out.q).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP4_SQL = """
with c as (select distinct vec_id, array_to_string(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end), '') as code
           from embeddings where vec_id is not null and embedding is not null),
d as (select q.vec_id as query_id, c.vec_id, cast(hamming(q.code, c.code) as integer) as distance from c q join c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, distance
from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d) where rank <= 10
"""
