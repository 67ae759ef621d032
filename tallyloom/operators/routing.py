"""How a file is taken: which mapping its columns get, whether it is merged or archived, and what names it has.

Rules are short lists given by the caller; files are a DataFrame (file, columns and what else is known of them), so any
number of them is decided in one projection.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.decisions import Profile, match_profile


def glob_pattern(pattern: str) -> str:
    """A regular expression for a file name pattern: * is anything, case does not matter, all of the name counts."""
    return "(?iu)^" + ".*".join(re.escape(x) for x in pattern.split("*")) + r"\z"


def base_name(file: Column) -> Column:
    return F.regexp_extract(file, r"[^/\\]*\z", 0)


def first_match(file: Column, rules: list[tuple[str, str]]) -> Column:
    """What the first rule (pattern, value) whose pattern fits a file's name says; null for none."""
    return F.coalesce(*[F.when(base_name(file).rlike(glob_pattern(p)), F.lit(v)) for p, v in rules], F.lit(None).cast("string"))


def best_mapping(file: Column, schema: Column, by_schema: dict[str, str], by_name: list[tuple[str, str]], by_index: list[tuple[str, str]]) -> Column:
    """The mapping for a file: that of its schema's fingerprint, else of its name, else of its columns' places."""
    known = F.coalesce(*[F.when(schema == k, F.lit(v)) for k, v in by_schema.items()], F.lit(None).cast("string"))
    return F.coalesce(known, first_match(file, by_name), first_match(file, by_index))


def renamed(names: list[str], mapping: dict[str, str]) -> list[str]:
    return [mapping.get(n, n) for n in names]


def schema_key(columns: Column) -> Column:
    """A file's column names, whatever their order, as one fingerprint."""
    return F.sha2(F.array_join(F.array_sort(columns), "|"), 256)


def review_schema_key(columns: Column) -> Column:
    """As schema_key, for column names that people retype: case and blanks around them don't count."""
    return F.sha2(F.array_join(F.array_sort(F.transform(columns, lambda c: F.trim(F.lower(c)))), "\0"), 256)


def file_shape(columns: Column, encoding: Column, header: Column) -> Column:
    """A fingerprint of what a file looks like: its column names, their number, encoding and whether it has a header."""
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(columns), ","), F.size(columns).cast("string"), encoding, F.when(header, "1").otherwise("0")), 256)


def combined_key(values: list[str]) -> str:
    """One key for several files or sources, whatever their order."""
    return hashlib.sha256("|".join(sorted(values)).encode()).hexdigest()


def file_batch_id(path: str, content_hash: str, mode: str, config_hash: str) -> str:
    return hashlib.sha256("\0".join((path, content_hash, mode, config_hash)).encode()).hexdigest()[:16]


def file_hashes(spark: SparkSession, path: str, head: int = 512 * 1024, whole: bool = True) -> DataFrame:
    """file, size, content_sha256, head_sha256 of the files at a path, each read in the task that hashes it.

    Spark lists the files (their content isn't read for that); a task opens them and reads blocks of 4 MB, so a file may be of
    any size. head_sha256 is of the first bytes and the size, for files too large to be hashed whole each time: without
    `whole` nothing else is read, and content_sha256 is null.
    """

    def batches(it):
        for b in it:
            rows = []
            for file, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                system, name = opened(file)
                content = hashlib.sha256()
                with system.open_input_stream(name) as f:
                    start = f.read(head)
                    content.update(start)
                    while whole and (block := f.read(BLOCK)):
                        content.update(block)
                rows.append((file, size, content.hexdigest() if whole else None, hashlib.sha256(start + str(size).encode()).hexdigest()))
            names = ["file", "size", "content_sha256", "head_sha256"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInArrow(batches, "file string, size long, content_sha256 string, head_sha256 string")


BLOCK = 4 << 20


def opened(file: str) -> tuple[FileSystem, str]:
    """The file system of a file that Spark lists, and its name there."""
    if file.startswith("file:"):
        return LocalFileSystem(), file.removeprefix("file:").replace("///", "/", 1)
    return FileSystem.from_uri(file)


# Parts of column names that speak for a table of customers.
CUSTOMER_SIGNS = ("顧客", "お客様ID", "契約者", "申込者", "電話番号", "メール", "住所", "設置住所", "設置電話番号", "営業担当")
CONFIDENCES = ("none", "low", "medium", "high")


def route(files: DataFrame, inputs: dict[str, str], modes: list[tuple[str, str]], profiles: list[Profile], customer: str = "customer-list", least: str = "low") -> DataFrame:
    """files with mode, why, children, mixed and routed_family: whether each is merged (mainline) or only kept (archive).

    files: file, columns, column_count, headerless, family. What the caller says of an input comes first, then the first
    rule for its name; then a file that the customer profile fits best, with `least` confidence, or whose name and columns
    speak of customers, is mainline; all others are archived. A mainline file with columns of a related table (::) is mixed.
    """
    known = match_profile(files, profiles)
    children = F.filter("columns", lambda c: F.contains(c, F.lit("::")))
    own = F.coalesce(*[F.when(F.col("file") == k, F.lit(v)) for k, v in inputs.items()], F.lit(None).cast("string"))
    rule = first_match(F.col("file"), modes)
    enough = F.col("confidence").isin(*CONFIDENCES[CONFIDENCES.index(least) :])
    signs = F.exists("columns", lambda c: F.lower(c).rlike("|".join(map(str.lower, CUSTOMER_SIGNS))))
    like = (F.col("profile").eqNullSafe(F.lit(customer)) & enough) | (signs & base_name(F.col("file")).contains("顧客"))
    why = F.when(own.isNotNull(), "input_mode").when(rule.isNotNull(), "diff_key_mode").when(like, "profile_inference").otherwise("default_archive")
    out = known.withColumns({"children": children, "why": why, "mode": F.coalesce(own, rule, F.when(like, F.lit("mainline")), F.lit("archive"))})
    inferred = F.col("why") == "profile_inference"
    return out.withColumns({"mixed": inferred & (F.size("children") > 0), "routed_family": F.when(inferred, "customer_master_like")})


def family_of(files: DataFrame, known: DataFrame, weights: dict[str, tuple[str, float]], least: float) -> DataFrame:
    """files with family and certainty: what is remembered of a file's shape (known: shape, family, certainty), else the
    family whose words among the columns weigh `least` or more, with low certainty, else unknown."""
    families = sorted({f for f, _ in weights.values()}, reverse=True)
    weight = lambda f: F.create_map(*[F.lit(x) for k, (g, w) in weights.items() if g == f for x in (k, w)])
    score = lambda f: F.aggregate(F.transform("columns", lambda c: F.coalesce(F.element_at(weight(f), c), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    scores = F.filter(F.array(*[F.struct(score(f).alias("score"), F.lit(f).alias("family")) for f in families]), lambda s: s["score"] >= least)
    out = files.withColumn("_best", F.array_max(scores)).join(known.withColumnsRenamed({"family": "_family", "certainty": "_certainty"}), "shape", "left")
    family = F.coalesce("_family", "_best.family", F.lit("unknown"))
    certainty = F.coalesce("_certainty", F.when(F.col("_best").isNotNull(), F.lit("low")), F.lit("unknown"))
    return out.withColumns({"family": family, "certainty": certainty}).drop("_best", "_family", "_certainty")
