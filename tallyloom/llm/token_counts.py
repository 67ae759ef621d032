"""Token counts by heap-and-linked-list byte-pair merging, without making token ids."""

from __future__ import annotations

import functools

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe
from tallyloom.llm.common import Memo, id_and_text, small_batches, table


class Counter:
    """Counts tokens of whole texts; repeated words are looked up in bounded caches."""

    def __init__(self, path: str):
        vocabulary = bpe.vocabulary(path)
        self.parts = vocabulary.parts
        self.words = Memo(vocabulary.count, 1_000_000)
        of_chunk = lambda chunk: sum(map(self.words.__getitem__, bpe.words(chunk)))
        self.first = Memo(of_chunk, 100_000)
        # a chunk of letters alone is one pre-token
        self.later = Memo(lambda chunk: self.words[" " + chunk] if chunk.isalpha() else of_chunk(" " + chunk), 300_000)

    def count(self, text: str) -> int:
        total = 0
        for part, special in self.parts(text):
            if special is not None:
                total += 1
            elif (lines := bpe.plain_lines(part)) is not None:
                first, later = self.first, self.later.__getitem__
                total += len(lines) - 1
                for line in lines:
                    total += first[line[0]] + sum(map(later, line[1:]))
            else:
                total += sum(map(self.words.__getitem__, bpe.words(part)))
        return total


@functools.lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    One narrow pass, no shuffle. Null and empty texts have 0 tokens; very long texts are counted whole; a null doc_id stays
    null; repeated rows each give a row; other columns are left behind whatever their names; an empty table gives an empty
    table.
    """
    small_batches(docs.sparkSession)

    def batches(it):
        count = counter(tokenizer).count
        for b in it:
            texts = b.column("text")
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array([count(t.as_py()) for t in texts], pa.int64()),
                    pc.binary_length(texts.cast(pa.binary())).cast(pa.int64()),
                ],
                names=["doc_id", "n_tokens", "n_bytes"],
            )

    out = id_and_text(docs).mapInArrow(batches, "doc_id long, n_tokens long, n_bytes long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
