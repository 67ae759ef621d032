"""The corpus operators on small tables: against the libraries, brute force and SQL, with awkward rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallyloom.llm import bpe, bpe_codec, graph, media, minhash, packing, quality, substring_dedup, suffix_dedup, token_counts, topk, url_filter

SMALL = "/root/testdata/sf0.001"
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("id", T.StringType()), T.StructField("n_chars", T.LongType())])

rng = np.random.default_rng(3)
WORDS = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(300)]
PASSAGE = " ".join(rng.choice(WORDS, 120))
BASE = list(rng.choice(WORDS, 200))


def near(n):
    words = list(BASE)
    words[n] = "changed"
    return " ".join(words)


TEXTS = [
    (0, PASSAGE + " tail one"),
    (1, "head two " + PASSAGE),
    (2, None),
    (3, ""),
    (4, " \n\t"),
    (5, "It's 12,345  naïve　words\x1cand <|endoftext|>!!\n\n  x\r\n" + "é" * 40),
    (6, " ".join(BASE)),
    (7, near(20)),
    (8, near(90)),
    (9, " ".join(BASE)),
    (10, "ab" * 3000),
    (11, "\x00\x1f" + "z" * 5000),
    (12, "four words are here"),
    (13, "four  words are here"),
    (14, " ".join(rng.choice(WORDS, 3000)) + " " + PASSAGE + " " + PASSAGE),
    (None, "no id " + PASSAGE[:300]),
    (15, PASSAGE + " tail one"),
    (15, PASSAGE + " tail one"),
    (15, "another text of the same id " + PASSAGE),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "clash", len(t or "")) for i, t in TEXTS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_token_counts(docs, empty):
    t = Tokenizer.from_file(BYTE_BPE)
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in TEXTS)
    assert rows(token_counts.token_counts(docs, BYTE_BPE)) == want
    assert token_counts.token_counts(empty, BYTE_BPE).count() == 0


def test_runs_of_white_space_beside_tabs(spark):
    """As many blanks and line ends in runs as there are words joined by other white space."""
    texts = enumerate(["a\n\n\nb\tc\td", "a   b\u3000c\xa0d", "\n\nb\tc\td", "\t b\tc", "a \n\nb\tc\x1cd", "a b\nc"])
    d = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in texts], DOCS)
    t = Tokenizer.from_file(BYTE_BPE)
    ids = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids for r in d.collect()}
    assert len(ids[0]) == 8
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(d, BYTE_BPE).collect()} == {i: len(x) for i, x in ids.items()}
    assert {r.doc_id: list(r.ids) for r in bpe_codec.encode_decode(d, BYTE_BPE, keep_ids=True).collect()} == ids


def test_merging_is_by_lowest_rank():
    v = bpe.vocabulary(BYTE_BPE)
    t = Tokenizer.from_file(BYTE_BPE)
    for w in [" hello", "aaaaaaaaaaa", "antidisestablishmentarianism", " ", "ÿÿ", "日本語" * 5]:
        assert list(v.ids(w)) == t.encode(w, add_special_tokens=False).ids
        assert v.count(w) == len(v.ids(w))


def test_codec(docs, empty):
    t = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for i, x in TEXTS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    for size in (0, 5, 50_000):
        assert rows(bpe_codec.encode_decode(docs, BYTE_BPE, size)) == want
    back = bpe_codec.encode_decode(docs, BYTE_BPE, keep_ids=True).where("doc_id = 5").first()
    assert back.decoded == TEXTS[5][1] and len(back.ids) == back.n_tokens
    assert bpe_codec.encode_decode(empty, BYTE_BPE).count() == 0


def test_transducer(tmp_path):
    words = {w + s: (len(w), k) for w in WORDS for k, s in enumerate(("", "ing", "ed", "s"))}
    arrays = bpe_codec.compile_transducer(words)
    assert len(arrays["accepting"]) < sum(map(len, words)) / 4  # suffixes are shared
    bpe_codec.save_transducer(arrays, str(tmp_path / "t"))
    t = bpe_codec.Transducer(str(tmp_path / "t"))
    asked = [*words, "absent", "a" * 70, ""]
    assert t.lookup([w.encode() for w in asked]) == [words.get(w) for w in asked]


def test_packing(docs, empty):
    t = Tokenizer.from_file(WORD_BPE)
    capacity = 300
    got = packing.pack(docs, WORD_BPE, capacity).collect()
    want = Counter()
    for i, x in TEXTS:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[(i, k, at, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_best_two_fit_replaces_the_shortest():
    assert packing.best_two_fit({60: 1, 20: 1, 19: 1, 18: 1}, 97)[0] == ({60: 1, 19: 1, 18: 1}, 1)
    for seed in range(20):
        r = np.random.default_rng(seed)
        lengths = Counter(r.integers(1, 101, 500).tolist())
        bins = packing.best_two_fit(lengths, 100)
        used = Counter()
        for own, times in bins:
            assert sum(k * n for k, n in own.items()) <= 100
            for k, n in own.items():
                used[k] += n * times
        assert used == lengths
        large = sum(n for k, n in lengths.items() if k > 50)  # no two of these fit together
        assert sum(t for _, t in bins) <= max(large, -(-sum(k * n for k, n in lengths.items()) // 100)) * 1.03 + 1


def test_media(docs, empty, spark):
    want = Counter()
    for i, x in TEXTS:
        raw = (x or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
    out = media.media_digests(docs)
    assert rows(out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) == want
    assert out.select("media_sha256", "feature").where("doc_id = 15").distinct().count() == 2
    assert media.media_digests(empty).count() == 0
    data = media.store_samples(bytes(range(256)) * 100)
    table = media.read_packets(spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(data[:900]))], "key long, media binary"), "key", "media")
    packets = table.where("key = 1").orderBy("packet").collect()
    assert b"".join(data[p.start : p.start + p.size] for p in packets) == bytes(range(256)) * 100
    assert [p.timestamp_ns for p in packets] == [i * 72_000_000 for i in range(len(packets))]
    assert table.where("key = 2").count() == 0


@pytest.mark.parametrize("lacing", [media.XIPH, media.FIXED, media.EBML_LACING])
def test_lacing_and_unknown_sizes(lacing):
    sizes = [40, 40, 40] if lacing == media.FIXED else [300, 5, 255, 510, 1, 70]
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    block = media.size_field(200) + b"\x00\x05\x00"[:2] + bytes([lacing << 1]) + media.laced(frames, lacing)
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block))
    cluster = media.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + media.unsigned(media.CLUSTER_TIMESTAMP, 1000) + group
    segment = media.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + media.element(media.INFO, media.unsigned(media.TIMESTAMP_SCALE, 1_000_000)) + cluster * 2
    found = media.parse(segment)
    assert not found.faults
    assert [segment[s : s + n] for _, _, s, n, _, _ in found.packets] == frames * 2
    assert {(p[0], p[1]) for p in found.packets} == {(200, 1005)}


def check_sql(df, sql, sf_dir, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    names = sorted(df.columns)
    assert Counter(map(tuple, df.select(names).collect())) == Counter(con.sql(f"select {', '.join(names)} from ({sql})").fetchall())


def test_search_and_urls_against_sql(spark):
    check_sql(topk.op4_exact_topk(spark, SMALL), topk.OP4_SQL, SMALL, "embeddings")
    check_sql(url_filter.op6_url_filters(spark, SMALL), url_filter.op6_sql(), SMALL, "pages")


def test_search_with_copies_and_few_rows(spark):
    r = np.random.default_rng(5)
    vectors = [(i, [1.0] * 64 if i % 3 == 0 else r.normal(size=64).tolist()) for i in range(120)] + [(200, None), (None, [1.0] * 64)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    codes = {i: sum((x > 0) << k for k, x in enumerate(v)) for i, v in vectors if i is not None and v}
    got = defaultdict(list)
    for x in topk.top_k(df, df.where("vec_id % 20 = 0"), 7).collect():
        got[x.query_id].append((x.rank, x.distance, x.vec_id))
    for q in range(0, 120, 20):
        want = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:7]
        assert sorted(got[q]) == [(n + 1, d, i) for n, (d, i) in enumerate(want)]
    assert topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), 7).count() == 2
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_blocks_spread_over_links(spark):
    page = lambda i, url, html="": (i, url, html, "x")
    pages = spark.createDataFrame(
        [
            page(0, "http://a.com/de/1"),
            page(1, "http://b.net/x", '<link rel="canonical" href="http://a.com/de/1">'),
            page(2, "https://B.net/x?y=1"),
            page(3, "http://c.net/z", "<meta http-equiv='refresh' content='0; url=http://b.net/x/'>"),
            page(4, "http://d.org/", '<link href="http://a.com/de/1" rel=canonical>'),
            page(5, "http://e.net/q", '<link rel="canonical" href="/p">'),
            page(6, None),
            page(7, "nothing"),
            page(8, "http://f.example.org/es/x"),
            page(9, "http://x.com/de/fr/"),
        ],
        "page_id long, url string, html string, node string",
    )
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert [got[i][3] for i in range(10)] == ["block", "block", "block", "block", "allow", "allow", "allow", "allow", "block", "block"]
    assert got[6] == ("", "", None, "allow") and got[2][0] == "b.net" and got[8][2] == "example.org/es/"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 300), (500, 500), (None, 4)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in [*range(41), 300]} == {0} and {got[100 + i] for i in range(50)} == {100} and 500 not in got


def covered(texts, size, earlier, parts, join):
    first, out = {}, []
    for i, t in texts:
        x, gone = parts(t or ""), set()
        for at in range(len(x) - size + 1):
            w = tuple(x[at : at + size])
            if earlier(first.setdefault(w, (i, at)), (i, at)):
                gone.update(range(at, at + size))
        kept = join([c for n, c in enumerate(x) if n not in gone])
        out.append((i, len(x), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeated_bytes(docs, empty, spark):
    ordered = [x for x in sorted(TEXTS, key=lambda x: -1 if x[0] is None else x[0]) if x[0] != 15]
    got = suffix_dedup.digests(docs.where("doc_id is null or doc_id <> 15"))
    assert rows(got.drop("n_spans")) == covered(ordered, 100, lambda a, b: a != b, lambda t: t.encode(), bytes)
    assert suffix_dedup.digests(docs).where("doc_id = 15").count() == 3
    assert suffix_dedup.digests(empty).count() == 0
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("n_chars <> length(text)").count() == 0


def test_repeated_words(docs, empty):
    ordered = sorted(TEXTS, key=lambda x: -1 if x[0] is None else x[0])
    smaller = lambda a, b: (-1 if a[0] is None else a[0]) < (-1 if b[0] is None else b[0])
    assert rows(substring_dedup.digests(docs)) == covered(ordered, 50, smaller, lambda t: t.encode().split(), b" ".join)
    assert substring_dedup.digests(empty).count() == 0


@pytest.mark.parametrize("times", [1, 2])
@pytest.mark.parametrize("hot", [2, 2000])
def test_repeated_rows_and_rows_of_one_id(spark, monkeypatch, hot, times):
    """Every row occurs so many times; some texts of one id agree in 15 bits of their CRC and hold other passages, or none."""
    import tallyloom.llm.repeats as repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    low = lambda t: zlib.crc32(t.encode()) & 0x7FFF
    texts = [(0, PASSAGE + " tail"), (5, " ".join(BASE)), (None, "one " + PASSAGE[:300]), (None, " ".join(BASE[:90])), (None, None), (7, ""), (7, "more " + PASSAGE)]
    for i, text in ((20, "long " * 70 + PASSAGE + " end"), (None, "far " * 70 + PASSAGE + " end")):
        other = next(x for k in range(10**7) if low(x := f"other text {k} " + " ".join(BASE[100:160])) == low(text))
        texts += [(i, text), (i, other)]
    df = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in texts * times], DOCS)
    first = lambda i: -1 if i is None else i
    found = df.distinct().selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()
    ordered = [(r.doc_id, r.text) for r in sorted(found, key=lambda r: (first(r.doc_id), r.h))]
    every = lambda counts: Counter({k: times * n for k, n in counts.items()})
    for d in (df.repartition(1), df.repartition(5)):
        assert rows(suffix_dedup.digests(d).drop("n_spans")) == every(covered(ordered, 100, lambda a, b: a != b, lambda t: t.encode(), bytes))
        assert rows(substring_dedup.digests(d)) == every(covered(ordered, 50, lambda a, b: first(a[0]) < first(b[0]), lambda t: t.encode().split(), b" ".join))
    kept = suffix_dedup.without_repeats(df)
    assert kept.count() == len(texts) * times and kept.where("doc_id = 5 and n_chars > 0").count() == times


def test_hot_passage_is_split(spark, monkeypatch):
    import tallyloom.llm.repeats as repeats

    monkeypatch.setattr(repeats, "HOT", 5)
    r = np.random.default_rng(8)
    texts = [(i, " ".join([*r.choice(WORDS, r.integers(0, 60)), PASSAGE, *r.choice(WORDS, r.integers(0, 60))])) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(suffix_dedup.digests(df).drop("n_spans")) == covered(texts, 100, lambda a, b: a != b, lambda t: t.encode(), bytes)
    assert rows(substring_dedup.digests(df)) == covered(texts, 50, lambda a, b: a[0] < b[0], lambda t: t.encode().split(), b" ".join)


@pytest.mark.parametrize("hot", [5, 10**6])
def test_key_beyond_the_buffers_goes_window_by_window(spark, monkeypatch, hot):
    import tallyloom.llm.repeats as repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BUFFER", 300)
    monkeypatch.setattr(repeats, "LARGE", 2)
    r = np.random.default_rng(9)
    texts = [(i, " ".join([*r.choice(WORDS, r.integers(0, 60)), PASSAGE, *r.choice(WORDS, r.integers(0, 60)), *([PASSAGE] if i % 9 == 0 else [])])) for i in range(60)]
    df = spark.createDataFrame(texts + texts[:7], "doc_id long, text string")
    want_bytes = covered(texts, 100, lambda a, b: a != b, lambda t: t.encode(), bytes)
    want_words = covered(texts, 50, lambda a, b: a[0] < b[0], lambda t: t.encode().split(), b" ".join)
    assert set(rows(suffix_dedup.digests(df).drop("n_spans"))) == set(want_bytes)
    assert set(rows(substring_dedup.digests(df))) == set(want_words)


def test_merged_transforms_are_the_suffix_order():
    r = np.random.default_rng(2)
    texts = [bytes(r.choice([97, 98], r.integers(100, 140)).astype(np.uint8)) for _ in range(8)] + [b"a" * 130, b"a" * 120]
    firsts = np.array([(i, 0, 0) for i in range(len(texts))])
    for window in (4, 8, 100):
        seen, want = {}, set()
        for i, t in enumerate(texts):
            for o in range(len(t) - window + 1):
                if seen.setdefault(t[o : o + window], (i, o)) != (i, o):
                    want.add((i, o))
        got = suffix_dedup.shared_windows(texts, firsts, window)
        assert set(zip(*(x.tolist() for x in got))) == want


def test_near_duplicates(docs, empty):
    got = defaultdict(set)
    for r in minhash.near_duplicates(docs).collect():
        got[r.doc_id].add(r.class_id)
    same = lambda *ids: len({c for i in ids for c in got[i]}) == 1
    assert same(6, 7, 8, 9) and same(2, 3, 4) and same(12, 13) and same(0, 15, 1) and got[None] == {None}
    assert got[10] == {10} and got[5] == {5} and got[14] == {14} and got[6] == {6}
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 2, 5, 6, 10, 11, 12, 14]
    assert minhash.near_duplicates(empty).count() == 0 and minhash.one_of_each(empty).count() == 0


def test_links_through_a_hub_and_in_blocks(spark, monkeypatch):
    """Copies that are each near the hub alone, and a bucket that is compared in several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    hub = [f"w{i}" for i in range(300)]
    texts = [(99, " ".join(hub))]
    for k in range(20):
        w = list(hub)
        for j in range(4):
            w[(k * 14 + j * 73) % 300] = f"new{k}-{j}"
        texts.append((k, " ".join(w)))
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert set(found.values()) == {0}


def test_signatures_are_unbiased():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 2**62, 200, dtype=np.uint64))
    a, b = (base, r.integers(1, 20, len(base))), (base, r.integers(1, 20, len(base)))
    true = minhash.overlap(a, b)
    shift = [np.uint64(k * 7919) for k in range(60)]
    estimate = np.mean([(s[0] == s[1]).mean() for s in (minhash.bag_signatures([(a[0] + k, a[1]), (b[0] + k, b[1])]) for k in shift)])
    assert abs(true - estimate) < 0.02


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op9_quality_classifier(spark, sf).toPandas()
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert ((held.predicted == held.quality).mean()) > 0.9
    assert out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(out.doc_id, out.held_out))


def test_quality_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(empty, none).count() == 0
    assert quality.kept_documents(docs, none).columns == docs.columns


def test_too_few_labels_drop_nothing(docs, spark):
    for labels in ([], [(0, 0, 0), (1, 1, 0)], [(i, 0, 0) for i in range(15)], [(i + 1000, i % 2, 0) for i in range(100)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert rows(quality.kept_documents(docs, known)) == rows(docs)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    out = corpus_pipeline.run(spark, SMALL)
    assert out.select("doc_id").distinct().count() == docs.count()


def test_frequent_words_stay_within_their_bound(spark, empty):
    texts = [(i, f"often often often some some {('left', 'right')[i % 2]}", "en", "s", 0) for i in range(40)]
    d = spark.createDataFrame(texts, DOCS).repartition(3)
    assert bpe_codec.frequent_words(d, 4) == [" often", " some", " left", " right"]
    assert bpe_codec.frequent_words(d, 3) == [" often", " some"]  # the next level has two
    assert bpe_codec.frequent_words(d, 0) == bpe_codec.frequent_words(empty, 3) == []
