"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import Memo, id_and_text, small_batches, table, written

WORDS, SHAPES, SIZE = 8192, 1024, 64  # word classes, shape classes, dimensions of a vector
HIDDEN, SEED, PARTS = 32, 7, 8
SAMPLE = 20_000  # labelled rows that the model is fitted on at most

_RUNS = re.compile(r"(.)\1+", re.S)


def word_class(word: str) -> int:
    """Two classes of a word in one integer: its lower-case letters, and its shape, where upper-case letters are A, lower
    a, digits 0 and runs of a character one."""
    letters = "".join(c for c in word if c.isalnum()).lower()
    shape = _RUNS.sub(r"\1", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word))
    return zlib.crc32(letters.encode()) % WORDS * SHAPES + zlib.crc32(shape[:24].encode()) % SHAPES


_classes = Memo(word_class, 300_000)


def classes(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    both = np.fromiter(map(_classes.__getitem__, words), np.int32, len(words))
    return both // SHAPES, both % SHAPES


def index_vectors() -> np.ndarray:
    """Sparse random vectors: four entries of +1 or -1 for each class, the same everywhere."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((WORDS + SHAPES, SIZE), np.float32)
    for row in out:
        row[rng.choice(SIZE, 4, replace=False)] = rng.choice([-1.0, 1.0], 4)
    return out


def context_sums(texts, index: np.ndarray) -> np.ndarray:
    """For each class the sum of the index vectors of its words' neighbours, two on either side."""
    sums = np.zeros((WORDS + SHAPES, SIZE), np.float64)
    for text in texts:
        word, shape = classes(text)
        for at in range(0, len(word), 50_000):
            w, s = word[at : at + 50_000], shape[at : at + 50_000]
            own = index[w] + index[WORDS + s]
            near = np.zeros_like(own)
            for d in (1, 2):
                near[d:] += own[:-d]
                near[:-d] += own[d:]
            for ids in (w, WORDS + s):
                order = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.diff(ids[order], prepend=-1))
                sums[ids[order][first]] += np.add.reduceat(near[order], first, axis=0)
    return sums


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """Means of a whole text's word vectors and shape vectors, and its length; zeros for a text without words."""
    out = np.zeros(2 * SIZE + 1, np.float32)
    word, shape = classes(text)
    if len(word):
        total = np.zeros(SIZE, np.float64)
        for at in range(0, len(word), 50_000):
            total += vectors[word[at : at + 50_000]].sum(axis=0)
        out[:SIZE] = total / len(word)
        out[SIZE : 2 * SIZE] = np.bincount(shape, minlength=SHAPES) @ vectors[WORDS:] / len(word)
        out[-1] = np.log1p(len(word)) / 10
    return out


class Network:
    """x -> tanh -> logit, divided by a temperature that is fitted on rows kept out of the training."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(2 * SIZE + 1), np.ones(2 * SIZE + 1))
        self.rate = (y.sum() + 1) / (len(y) + 2)
        self.weights, self.temperature = None, 1.0
        if len(set(y.tolist())) < 2 or len(y) < 20:
            return
        x = (x - self.mean) / self.spread
        order = rng.permutation(len(y))
        check, learn = order[: len(y) // 6], order[len(y) // 6 :]
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(max(40, min(400, 400_000 // len(learn)))):
            rng.shuffle(learn)
            for at in range(0, len(learn), 256):
                rows = learn[at : at + 256]
                a = np.tanh(x[rows] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(a @ w[2] + w[3][0]))) - y[rows]) / len(rows)
                da = np.outer(d, w[2]) * (1 - a * a)
                grads = [x[rows].T @ da + 1e-4 * w[0], da.sum(axis=0), a.T @ d + 1e-4 * w[2], np.array([d.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        z, target = self._logits(x[check]), y[check]
        if len(check):
            loss = lambda t: np.mean(np.logaddexp(0, -np.where(target > 0, z, -z) / t))
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-self._logits((x - self.mean) / self.spread) / self.temperature))


def remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors and network from labelled rows whose remainder is not 2, at most about `most` of them.

    The sample goes by a hash of doc_id. What reaches the driver is bounded: PARTS tables of context sums and a feature
    row for each document of the sample.
    """
    spark = docs.sparkSession
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(remainder() != 2).dropDuplicates(["doc_id", "quality"])
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / n)))
    sample = written(id_and_text(docs).join(known, "doc_id").repartition(PARTS, F.xxhash64("doc_id", "text")).sortWithinPartitions("doc_id", "text", "quality"), "labelled")
    index = spark.sparkContext.broadcast(index_vectors())

    def sums(it):
        total = np.zeros((WORDS + SHAPES, SIZE))
        for b in it:
            total += context_sums((t.as_py() for t in b.column("text")), index.value)
        yield pa.record_batch([pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((WORDS + SHAPES, SIZE))
    for r in sample.select("text").coalesce(PARTS).mapInArrow(sums, "sums binary").toLocalIterator():
        total += np.frombuffer(r.sums, "<f4").reshape(total.shape)
    vectors = unit(total)
    shared = spark.sparkContext.broadcast(vectors)

    def rows(it):
        for b in it:
            x = [pooled(t.as_py(), shared.value).tobytes() for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array(x, pa.binary())], names=["doc_id", "quality", "x"])

    got = sorted((r.doc_id, r.quality, bytes(r.x)) for r in sample.select("doc_id", "quality", "text").mapInArrow(rows, "doc_id long, quality int, x binary").collect())
    x = np.array([np.frombuffer(r[2], np.float32) for r in got], np.float64).reshape(len(got), 2 * SIZE + 1)
    return vectors, Network(x, np.array([r[1] for r in got], np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts have no words and get the score of that. Without labels of both kinds each score is their rate.
    A null doc_id is held in, is never learnt from and stays null. Very long texts are scored whole. Repeated rows each give
    a row; other columns are left behind whatever their names; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def batches(it):
        vectors, network = model.value
        for b in it:
            x = np.array([pooled(t.as_py(), vectors) for t in b.column("text")], np.float64).reshape(b.num_rows, 2 * SIZE + 1)
            yield pa.record_batch([b.column("doc_id"), pa.array(network.scores(x), pa.float64())], names=["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(batches, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not reject. Scored in place, without a join.

    Where the labels don't suffice to fit it (fewer than 20, or of one kind), nothing is known against a row and all stay.
    """
    small_batches(docs.sparkSession)
    fitted = fit(docs, labels)
    if fitted[1].weights is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def batches(it):
        vectors, network = model.value
        for b in it:
            x = np.array([pooled(t.as_py() or "", vectors) for t in b.column("text")], np.float64).reshape(b.num_rows, 2 * SIZE + 1)
            yield b.filter(pa.array(network.scores(x) >= threshold))

    return docs.mapInArrow(batches, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
