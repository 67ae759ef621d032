"""Operators that SQL can't express, against plain programs over the whole of a small table, and awkward inputs of them."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import bpe, bpe_codec, common, graph, media, minhash, packing, quality, substring_dedup, suffix_dedup, token_counts, topk, url_filter
from tests.llm.test_corpus_operators import BASE, BYTE_BPE, DOCS, PASSAGE, SMALL, TEXTS, WORD_BPE, WORDS, covered, rows


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return sorted((r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect())


def bags(text):
    words = text.encode().split()
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def classes(links, ids):
    least = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def all_links(texts):
    sets = {i: bags(t) for i, t in texts}
    size = {i: sum(s.values()) for i, s in sets.items()}
    out = []
    for a, b in combinations(sets, 2):
        if min(size[a], size[b]) >= 0.8 * max(size[a], size[b]):
            both = sum((sets[a] & sets[b]).values())
            if both >= 0.8 * (size[a] + size[b] - both):
                out.append((a, b))
    return out


def test_near_duplicates_are_those_of_all_pairs(documents, texts):
    links = all_links(texts)
    assert len(links) >= 10
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert found == len(links)  # recall of the links, all of 0.8 or more
    assert got == classes(links, [i for i, _ in texts])


@pytest.mark.parametrize("wide", [3, 4096])
def test_large_bucket_of_near_and_far_texts(spark, monkeypatch, wide):
    """Texts below and above the similarity in one bucket, compared by sketches and then in blocks, as all pairs are."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "WIDE", wide)
    r = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(45):
        words = list(base)
        for at in r.choice(200, r.integers(2, 9), replace=False):
            words[at] = f"n{r.integers(0, 40)}"
        docs.append((i, " ".join(words)))
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = classes(all_links(docs), range(45))
    same = lambda c, i, j: c[i] == c[j]
    assert all(same(want, i, j) for i, j in combinations(range(45), 2) if same(got, i, j))  # no link that isn't one
    assert sum(same(got, i, j) for i, j in combinations(range(45), 2) if same(want, i, j)) >= 0.99 * sum(same(want, i, j) for i, j in combinations(range(45), 2))


def test_the_kept_row_is_the_same_however_rows_lie(spark):
    rows_ = [(1, "a b c d e f", f"l{i}") for i in range(6)] + [(2, "a b c d e f", "z"), (3, "other words than these", "y")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    kept = [rows(minhash.one_of_each(df.repartition(n))) for n in (1, 3, 5)]
    assert kept[0] == kept[1] == kept[2] and sum(kept[0].values()) == 2


def test_sketches_agree_as_texts_do():
    component = np.array([1, 2, 3, 3, 3])
    bits = np.zeros((5, minhash.SIZE), np.uint8)
    bits[0, : minhash.SIZE - minhash.AGREE + 1] = 1  # one place short of enough with the rest
    bits[1, : minhash.SIZE - minhash.AGREE] = 1
    who, low, high = minhash.near_in_sketch(component, bits, np.array([0, 1, 0, 1, 0]), np.arange(5))
    assert set(who.tolist()) == {0, 1, 2, 3, 4} and (low <= high).all()
    who, _, _ = minhash.near_in_sketch(component, bits, np.zeros(5, np.int64), np.array([0, 0, 0, 0, 0]))
    pairs = {(a, b) for a, b in [(0, 1), (1, 2), (1, 3), (1, 4)]}
    assert set(who.tolist()) == {x for p in pairs for x in p}


def spans(text, gone):
    return sum(1 for i in gone if i - 1 not in gone)


def test_repeated_bytes_and_their_spans(documents, texts, spark):
    first, want = {}, {}
    for i, t in texts:
        raw, gone = t.encode(), set()
        for at in range(len(raw) - 99):
            if first.setdefault(raw[at : at + 100], (i, at)) != (i, at):
                gone.update(range(at, at + 100))
        want[i] = (len(raw), len(gone), spans(raw, gone))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digests(documents).collect()}
    assert got == want
    lengths = {r.doc_id: len((r.text or "").encode()) for r in suffix_dedup.without_repeats(documents).collect()}
    assert all(want[i][0] - want[i][1] - 6 * want[i][2] <= n <= want[i][0] - want[i][1] for i, n in lengths.items())


def test_repeated_words(documents, texts):
    assert rows(substring_dedup.digests(documents)) == covered(texts, 50, lambda a, b: a[0] < b[0], lambda t: t.encode().split(), b" ".join)


def test_rows_of_one_id_with_other_texts(spark):
    """Texts of one id count in the order of a fixed hash; the spans of each are its own."""
    df = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in TEXTS if i == 15] + [(16, "tail " + PASSAGE, "en", "x", 0)], DOCS)
    found = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffix_dedup.digests(df).collect()}
    total = len(PASSAGE.encode())
    assert found[16, total + 5][0] >= total and sorted(n for (i, _), (n, _) in found.items() if i == 15)[0] == 0


def test_pieces_of_whole_documents(documents, texts):
    t = Tokenizer.from_file(WORD_BPE)
    got = packing.pack(documents, WORD_BPE).collect()
    want = Counter()
    for i, x in texts:
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) * 1.02 + 1


def test_scores_come_from_texts_alone(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    score = lambda d, known: {r.doc_id: r.score for r in quality.quality_scores(d, known).collect()}
    plain = score(docs, labels)
    assert score(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "n_chars": F.lit(1)}), labels) == plain
    held = quality.remainder() == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert score(docs, flipped) == plain
    copies = docs.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text")
    both = score(docs.select("doc_id", "text").unionByName(copies), labels)
    assert all(abs(both[i] - both[i + 10_000_000]) < 1e-12 for i in plain)


def test_pipeline_stages_are_their_operators(spark, documents):
    """Each stage on its predecessor's rows: scores, all pairs, repeated bytes and pieces by plain programs."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "repeats", "packing"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = common.written(stages["quality"](spark, documents, SMALL), "quality")
    good = {r.doc_id for r in quality.quality_scores(documents, labels).where("score >= 0.7").collect()}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == documents.columns
    single = common.written(stages["near_dedup"](spark, kept, SMALL), "near")
    ordered = sorted((r.doc_id, r.text or "") for r in kept.collect())
    least = classes(all_links(ordered), [i for i, _ in ordered])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(least.values()))
    cut = common.written(stages["repeats"](spark, single, SMALL), "repeats")
    first, want = {}, {}
    for i, t in sorted((r.doc_id, r.text or "") for r in single.collect()):
        raw, gone = t.encode(), set()
        for at in range(len(raw) - 99):
            if first.setdefault(raw[at : at + 100], (i, at)) != (i, at):
                gone.update(range(at, at + 100))
        want[i] = bytes(b for n, b in enumerate(raw) if n not in gone).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in cut.collect()} == want and cut.where("n_chars <> length(text)").count() == 0
    packed = stages["packing"](spark, cut, SMALL)
    t = Tokenizer.from_file(WORD_BPE)
    total = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want.items()}
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == total
    assert rows(corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "length", "ids_crc32")) == rows(packed.select("doc_id", "piece", "length", "ids_crc32"))


def test_release_deletes_what_was_written(spark):
    df = common.written(spark.range(5), "t")
    assert df.count() == 5
    common.release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
    assert common.written(spark.range(4), "t").count() == 4


# --- awkward inputs --------------------------------------------------------------------------------------------------


def test_a_text_of_megabytes(spark):
    r = np.random.default_rng(1)
    long = " ".join(r.choice(WORDS, 400_000)) + " " + "x" * 300_000 + "\t" + PASSAGE
    df = spark.createDataFrame([(1, long), (2, PASSAGE), (3, "short")], "doc_id long, text string")
    t = Tokenizer.from_file(BYTE_BPE)
    n = len(t.encode(long, add_special_tokens=False).ids)
    assert {x.doc_id: x.n_tokens for x in token_counts.token_counts(df, BYTE_BPE).collect()}[1] == n
    assert {x.doc_id: x.n_tokens for x in bpe_codec.encode_decode(df, BYTE_BPE, 100).collect()}[1] == n
    pieces = packing.pack(df, WORD_BPE).where("doc_id = 1")
    assert pieces.agg(F.sum("length")).first()[0] == len(Tokenizer.from_file(WORD_BPE).encode(long, add_special_tokens=False).ids) + 1
    assert media.media_digests(df).where("doc_id = 1").first().n_bytes == len(long)
    assert minhash.near_duplicates(df).count() == 3
    assert {x.doc_id: x.n_removed for x in suffix_dedup.digests(df).collect()}[2] == len(PASSAGE)
    assert {x.doc_id: x.n_removed for x in substring_dedup.digests(df).collect()}[2] == len(PASSAGE.split())


def test_other_columns_of_any_name(spark):
    names = ["id", "tag", "check", "rest", "removed", "key", "a", "b", "bands", "bits", "word", "n", "level", "part", "rank", "score", "row", "order", "kept_id", "component", "label"]
    df = spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in enumerate([PASSAGE, PASSAGE + " more", " ".join(BASE), None])], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (token_counts.token_counts(df, BYTE_BPE), bpe_codec.encode_decode(df, BYTE_BPE, 10), packing.pack(df, WORD_BPE), media.media_digests(df), minhash.near_duplicates(df), suffix_dedup.digests(df), substring_dedup.digests(df), quality.quality_scores(df, none)):
        assert out.count() == 4
    for out in (suffix_dedup.without_repeats(df), quality.kept_documents(df, none)):
        assert out.columns == df.columns and out.count() == 4
    assert minhash.one_of_each(df).columns == df.columns


def test_unseen_words_merge_side_by_side_as_alone():
    v = bpe.vocabulary(BYTE_BPE)
    r = np.random.default_rng(6)
    words = ["".join(r.choice(list("abcdeéß日 1.'"), r.integers(1, 14))) for _ in range(3000)] + [" " + w for w in WORDS] + ["a", "aaaaaaaaaaaa", "ÿ"]
    coded = sorted((w.encode() for w in words), key=len)
    coded = [w for w in coded if len(w) <= bpe_codec.SHORT]
    ids, n = v.ids_of_block(coded)
    for w, row, k in zip(coded, ids.tolist(), n.tolist()):
        assert tuple(row[:k]) == v.ids(w.decode())


def test_codec_of_odd_spacing(spark):
    odd = ["", " ", "\n", "a", "a\n", "\na", "a \nb", "a\n b", " a", "a ", "a.b. c,\nd!", "it's 'tis a's\n's", "x" * 70 + " y", "\n\n\n", "a　b", "é\n日本 語!", "a,, b.. 1,2 3.", "<|endoftext|>a <|endoftext|>\n"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    t = Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe_codec.encode_decode(df, BYTE_BPE, 20, keep_ids=True).collect()}
    assert got == {i: (ids := t.encode(x, add_special_tokens=False).ids, t.decode(ids, skip_special_tokens=False)) for i, x in enumerate(odd)}


@pytest.mark.parametrize("size", [20, 64, 100, 130])
def test_search_over_vectors_of_any_length(spark, size):
    r = np.random.default_rng(size)
    vectors = [(i, r.normal(size=size).tolist()) for i in range(150)] + [(150, [1.0] * (size - 3))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    code = {i: [x > 0 for x in v] + [False] * (size - len(v)) for i, v in vectors}
    got = defaultdict(list)
    for x in topk.top_k(df, df.where("vec_id % 20 = 0"), 9).collect():
        got[x.query_id].append((x.rank, x.distance, x.vec_id))
    for q in range(0, 150, 20):
        want = sorted((sum(a != b for a, b in zip(code[q], c)), i) for i, c in code.items() if i != q)[:9]
        assert sorted(got[q]) == [(n + 1, d, i) for n, (d, i) in enumerate(want)]


def test_segments_widen_with_the_rows():
    for rows_ in (10, 1000, 10**6, 10**9, 10**12):
        parts = topk.segments(64, rows_)
        assert sum(n for _, _, n in parts) == 64 and max(n for _, _, n in parts) <= max(8, rows_.bit_length())
        assert rows_ < 2 ** (1.5 * min(n for _, _, n in parts) + 2) or rows_ > 10**9


# --- graphs and urls -------------------------------------------------------------------------------------------------


def test_hubs_and_giant_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST", 3)
    monkeypatch.setattr(graph, "SHARE", 10)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 360)] + [(359, 200), (200, 150)] + [(1000 + i, 1000 + i // 2) for i in range(64)]
    assert graph.hot_keys(spark.createDataFrame(edges, "a long, b long"), "a").count() == 1
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in [*range(201), *range(300, 361)]} == {0} and {got[1000 + i] for i in range(64)} == {1000}


def test_blocks_reach_aliases_through_chains_and_hubs(spark):
    page = lambda i, url, *targets: (i, url, "".join(f'<link rel="canonical" href="{t}">' for t in targets))
    chain = [page(i, f"http://h{i}.net/p", f"http://h{i + 1}.net/p/index.html") for i in range(30)] + [page(30, "http://h30.net/p", "http://shop.com/de/x")]
    hub = [page(100 + i, f"http://n{i}.net/q", "https://hub.net/all?i=1") for i in range(40)] + [page(150, "http://hub.net/all#top")]
    blocked_hub = [page(200 + i, f"http://m{i}.net/q", "//www.example.org/en/12") for i in range(20)]
    allowed = [page(300, "http://x.org/y", "http://h3.net/p"), page(301, "http://shop.com/fr/z", "../de/a"), page(302, "http://shop.com/fr/", "?x=1")]
    relative = [page(400, "http://r.net/a/b/c.html", "../d/./e.htm"), page(401, "http://r.net/a/d/e", "http://shop.com/de/1"), page(402, "http://r.net/a/d/e/", "mailto:x@y"), page(403, "http://s.net/k?p=1&amp;q=2")]
    commented = [(500, "http://c.net/1", '<!-- <link rel="canonical" href="http://shop.com/de/1"> -->'), (501, "http://c.net/2", '<a rel="canonical" href="http://shop.com/de/1"><link rel="stylesheet" href="http://shop.com/de/1">'), (502, "http://c.net/3", '<link rel=canonical href=/4><link href="http://shop.com/de/1" rel=\'canonical\'>'), (503, "http://c.net/4", None)]
    df = spark.createDataFrame(chain + hub + blocked_hub + allowed + relative + commented, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert all(got[i] == "block" for i in range(31)) and all(got[100 + i] == "allow" for i in range(40)) and got[150] == "allow"
    assert all(got[200 + i] == "block" for i in range(20))
    assert got[300] == got[301] == got[302] == "allow"
    assert [got[400 + i] for i in range(4)] == ["block", "block", "block", "allow"]
    assert [got[500 + i] for i in range(4)] == ["allow", "allow", "block", "block"]
    import duckdb

    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert rows(url_filter.judge(df).select("page_id", "verdict")) == Counter(con.sql(f"select page_id, verdict from ({url_filter.op6_sql()})").fetchall())


# --- media -----------------------------------------------------------------------------------------------------------


def matroska(tracks, clusters, cues=b""):
    info = media.element(media.INFO, media.unsigned(media.TIMESTAMP_SCALE, 1_000_000))
    return media.element(media.SEGMENT, info + media.element(media.TRACKS, tracks) + b"".join(clusters) + cues)


def test_groups_laces_cues_and_stripped_headers(spark):
    strip = media.element(media.CONTENT_ENCODINGS, media.element(media.CONTENT_ENCODING, media.element(media.COMPRESSION, media.unsigned(media.COMPRESSION_KIND, 3) + media.element(media.COMPRESSION_SETTINGS, b"HD"))))
    tracks = media.element(media.TRACK_ENTRY, media.unsigned(media.TRACK_NUMBER, 1) + media.unsigned(media.DEFAULT_DURATION, 23_219_954)) + media.element(media.TRACK_ENTRY, media.unsigned(media.TRACK_NUMBER, 2) + strip)
    block = lambda track, ticks, frames, lacing: media.size_field(track) + ticks.to_bytes(2, "big") + bytes([lacing << 1]) + media.laced(frames, lacing)
    group = lambda body, *more: media.element(media.BLOCK_GROUP, media.element(media.BLOCK, body) + b"".join(more))
    cluster = media.element(media.CLUSTER, media.unsigned(media.CLUSTER_TIMESTAMP, 100) + group(block(1, 0, [b"aa", b"bb", b"cc"], media.FIXED)) + group(block(2, 5, [b"p"], media.NO_LACING), media.unsigned(media.BLOCK_DURATION, 40), media.unsigned(media.REFERENCE_BLOCK, 1)) + group(block(2, 50, [b"q", b"rs"], media.XIPH), media.unsigned(media.BLOCK_DURATION, 40)))
    place = lambda track, at: media.element(media.CUE_TRACK_POSITIONS, media.unsigned(media.CUE_TRACK, track) + media.unsigned(media.CUE_CLUSTER_POSITION, at))
    head = len(matroska(tracks, [])) - 0
    inner = len(media.element(media.INFO, media.unsigned(media.TIMESTAMP_SCALE, 1_000_000)) + media.element(media.TRACKS, tracks))
    cues = media.element(media.CUES, media.element(media.CUE_POINT, media.unsigned(media.CUE_TIME, 100) + place(1, inner) + place(2, inner)))
    data = matroska(tracks, [cluster], cues)
    assert head and not media.parse(data).faults
    df = spark.createDataFrame([(7, bytearray(data)), (8, None), (9, bytearray(data[: len(data) - len(cues) - 3]))], "key long, media binary")
    table = media.read_packets(df, "key", "media")
    got = [(p.track, p.timestamp_ns, p.duration_ns, p.keyframe, bytes(p.prefix or b"") + data[p.start : p.start + p.size]) for p in table.where("key = 7").orderBy("packet").collect()]
    assert got[:3] == [(1, 100_000_000 + i * 23_219_954, 23_219_954, True, x) for i, x in enumerate((b"aa", b"bb", b"cc"))]
    assert got[3:] == [(2, 105_000_000, 40_000_000, False, b"HDp"), (2, 150_000_000, 20_000_000, True, b"HDq"), (2, 170_000_000, 20_000_000, True, b"HDrs")]
    found = media.read_cues(df, "key", "media").where("key = 7")
    assert rows(found.select("track", "timestamp_ns")) == Counter([(1, 100_000_000), (2, 100_000_000)])
    assert found.join(table.select("key", "cluster_start").distinct(), ["key", "cluster_start"]).count() == 2
    assert media.read_cues(df, "key", "media").where("key = 8").count() == 0 and table.where("key = 9").count() >= 3
