"""SentencePiece tokens, near-duplicates, media and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isolume.llm import media, minhash_dedup, textnp
from isolume.llm import sentencepiece as pieces
from isolume.llm.media import media_features, read_archives, write_archives
from isolume.llm.minhash_dedup import classes_of, keep_one
from isolume.storage import scratch_path

needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@needs_model
def test_viterbi_equals_plain_search(vocabulary):
    v = vocabulary
    for word in [b" tokenization", b" unbelievably", "  größer".encode(), b"\n\nx", "日本語".encode(), bytes([0xE2, 0x96, 0x81]), b" " + b"a" * 70]:
        ids, n = pieces.viterbi(np.frombuffer(word, np.uint8)[None, :], v)
        assert ids.tolist() == plain(v, word) and n.tolist() == [len(ids)]


_SCORES = {}


def plain(v, word):
    """Ids of the best segmentation by dynamic programming over the whole word; of equal ones that with the shorter last piece."""
    score = _SCORES.get(id(v)) or _SCORES.setdefault(id(v), {v.data[v.start[i] : v.start[i] + v.size[i]].tobytes(): (s, i) for i, s in zip(v.key_id.tolist(), v.key_score.tolist(), strict=True)})
    best = [(0, 0, -1)]
    for end in range(1, len(word) + 1):
        offers = [(best[end - 1][0] + v.byte_score, 1, int(v.byte_id[word[end - 1]]))]
        offers += [(best[end - k][0] + s, k, t) for k in range(1, min(end, v.lengths[-1]) + 1) for s, t in [score.get(word[end - k : end], (None, 0))] if s is not None]
        best.append(max(offers, key=lambda o: o[0]))
    out, at = [], len(word)
    while at:
        out.append(best[at][2])
        at -= best[at][1]
    return out[::-1]


@needs_model
def test_words_that_advance_together(vocabulary):
    rnd = random.Random(3)
    words = [" " + "".join(rnd.choice("etaoin shrdlu".replace(" ", "")) for _ in range(rnd.randint(1, 90))) for _ in range(300)]
    words += ["".join(rnd.choice("日本語処理の東京éß") for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    ids, count = pieces.Codec(vocabulary).encode(pa.array([w.strip() + "" for w in words]))
    at = np.concatenate([[0], np.cumsum(count)])
    for w, a, b in zip(words, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == plain(vocabulary, b" " + w.strip().encode())


@needs_model
@pytest.mark.parametrize("kind", ["base64", "words", "one letter", "period of three", "Japanese"])
def test_long_units_equal_plain_search(vocabulary, kind):
    """Texts without a blank, of lengths around the stretches' ends."""
    rnd = random.Random(len(kind))
    letters = {"base64": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "one letter": "a", "Japanese": "日本語処理の東京タワー"}
    for n in (385, 512, 640, 2000, 5003):
        if kind == "words":
            text = "".join(rnd.choice(["the", "and", "station", "water", "international", "Xq"]) for _ in range(n // 5))
        elif kind == "period of three":
            text = ("=-~" * n)[:n]
        else:
            text = "".join(rnd.choice(letters[kind]) for _ in range(n))
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) > pieces.LONG:
            assert pieces.viterbi_long(raw, vocabulary).tolist() == plain(vocabulary, raw.tobytes())


@needs_model
def test_a_million_bytes_without_a_blank(vocabulary):
    rnd = np.random.default_rng(1)
    noise = rnd.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", np.uint8), 1_000_000).tobytes().decode()
    texts = pa.array([noise, "=" * 1_000_000])
    began = time.perf_counter()
    pieces.Codec(vocabulary).encode_exact(texts)
    assert time.perf_counter() - began < 60


@needs_model
def test_units_of_one_name(vocabulary, monkeypatch):
    """Where names collide, texts are searched without them."""
    texts = pa.array(["one two", "three four five"])
    want = pieces.Codec(vocabulary).encode(texts)[0].tolist()
    monkeypatch.setattr(pieces.Codec, "_keys", lambda self, data, unit, width: np.zeros(len(unit), np.uint64))
    assert pieces.Codec(vocabulary).encode_exact(texts)[0].tolist() == want


@needs_model
def test_tokens_of_odd_rows(spark, odd, nothing):
    got = pieces.encode_documents(odd)
    assert got.count() == 10 and pieces.encode_documents(nothing).count() == 0
    want = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in got.collect()) == want
    assert all(len(r.ids) == r.n_tokens and (r.n_tokens == 0) == (r.doc_id in (2, 3)) for r in got.collect())
    back = pieces.decode_documents(got.select("doc_id", "ids"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in odd.collect())


@needs_model
def test_units_are_forgotten_and_learned_again(vocabulary, monkeypatch):
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)])
    whole = pieces.Codec(vocabulary).encode(texts)[0]
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    codec = pieces.Codec(vocabulary)
    assert np.concatenate([codec.encode(texts.slice(i, 1))[0] for i in range(40)]).tolist() == whole.tolist()


@needs_model
def test_library_reads_the_ids(vocabulary):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["Hello world, this is a test.", "Größe und Maß", "a\nb\n\nc", "x  y"]
    ids, count = pieces.Codec(vocabulary).encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(count)])
    assert [lib.decode(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)] == texts


def bag(text):
    w = textnp_words(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def textnp_words(text):
    import re

    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def test_words_and_shingles():
    texts = ["One two, THREE", "", None, "é-x é-x", "a b c d e f a b c d e f", "one two three"]
    hashes, before = textnp.words(*textnp.buffers(pa.array(texts)))
    assert np.diff(before).tolist() == [len(textnp_words(t or "")) for t in texts]
    assert hashes[:3].tolist() == hashes[-3:].tolist() and len(set(hashes.tolist())) == 3 + 2 + 6
    keys, count, total = textnp.bags(pa.array(texts), 5)
    assert total.tolist() == [1, 0, 0, 1, 8, 1]
    assert Counter(count.tolist()) == Counter({1: 3 + 4, 2: 2}) or count.sum() == 11


def test_signatures_estimate_weighted_similarity():
    rnd = random.Random(6)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(300)]
    left, right = [], []
    for n in range(60):
        left.append(" ".join(base[n:]))
        right.append(" ".join(w if rnd.random() > n / 300 else "zz" for w in base[n:] + base[n : n + 3 * n]))
    exact = np.diag(minhash_dedup.similarities(minhash_dedup.elements(pa.array(left)), minhash_dedup.elements(pa.array(right))))
    want = [sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values()) for a, b in zip(left, right, strict=True)]
    assert exact == pytest.approx(want, abs=1e-6)
    signed = [minhash_dedup.sign(pa.array(x))[2] for x in (left, right)]
    guess = (signed[0] == signed[1]).mean(axis=1)
    assert abs((guess - want).mean()) < 0.02 and np.abs(guess - want).max() < 0.2


def classes(rows):
    """Least doc_id of each row's class, by all pairs."""
    bags = [bag(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] | bags[j]).values())
            if both and sum((bags[i] & bags[j]).values()) / both >= 0.8 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group]


def near_corpus(n=30, seed=8):
    rnd = random.Random(seed)
    rows = []
    for d in range(n):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.choice([1, 1, 2, 12])):
            rows.append((len(rows), " ".join(w if rnd.random() > 0.02 else f"x{rnd.random()}" for w in words)))
        rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = near_corpus()
    want = dict(zip([i for i, _ in rows], classes(rows), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in classes_of(docs).collect()} == want
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(set(want.values()))


def test_kept_rows_are_the_same_each_time(spark):
    """Rows equal in doc_id and text differ in other columns, some named like the operator's own."""
    rows = [(1, "a b c d e f g h", f"s{i}", i) for i in range(20)] + [(2, "a b c d e f g h", "s", 0), (3, None, "t", 1), (3, None, "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __fp int").withColumn("__alone", F.lit("x")).withColumn("tags", F.create_map(F.lit("k"), "source"))
    kept = [sorted(map(str, keep_one(docs.repartition(n)).collect())) for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == 3 and keep_one(docs).columns == docs.columns


def test_wide_buckets_of_unlike_texts(spark, monkeypatch):
    """Many texts that share a bucket but not a class: their blocks meet by salted joins, and no link is lost."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2)
    monkeypatch.setattr(minhash_dedup, "SALT", 2)
    rnd = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*common, *[f"u{rnd.randint(0, 10**6)}" for _ in range(20 if i % 3 else 5)]])) for i in range(60)]
    want = dict(zip([i for i, _ in rows], classes(rows), strict=True))
    got = {r.doc_id: r.class_id for r in classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 20


@pytest.mark.parametrize("hot", [10, 0])
def test_no_group_comes_together_in_one_task(spark, monkeypatch, hot):
    """Half of the rows are one key: it is broadcast, the others are shuffled, rows without a key or a partner stay."""
    rows = [(i, "hot") for i in range(500)] + [(500 + i, f"k{i}") for i in range(490)] + [(990, None), (991, "unknown")]
    df = spark.createDataFrame(rows, "doc_id long, root string")
    each = df.filter("root <> 'unknown'").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    least = {k: (min(i for i, r in rows if r == k), sum(r == k for _, r in rows)) for k in {r for _, r in rows} - {None, "unknown"}}
    monkeypatch.setattr(minhash_dedup, "HOT", hot)
    got = minhash_dedup._with(df, each, "root")
    assert sorted((r.doc_id, r.class_id, r.n) for r in got.collect()) == [(i, *least.get(k, (None, None))) for i, k in rows]


def test_near_duplicates_of_a_whole_table(spark):
    """Against all pairs of the distinct bags of the test documents."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    docs = spark.read.parquet(path).select("doc_id", "text")
    rows = docs.toArrow().combine_chunks()
    nodes, bags = minhash_dedup.sign(rows.column("text"))[0], minhash_dedup.elements(rows.column("text"))
    first = {}
    for i, n in enumerate(nodes):
        first.setdefault(n if n is not None else i, i)
    distinct = sorted(first.values())
    group = {i: i for i in distinct}
    near = minhash_dedup.similarities([bags[i] for i in distinct]) >= 0.8
    for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        x, y = group[distinct[a]], group[distinct[b]]
        group = {k: x if v == y else v for k, v in group.items()}
    ids = rows.column("doc_id").to_pylist()
    of = [group[first[n if n is not None else i]] for i, n in enumerate(nodes)]
    least = {}
    for i, g in zip(ids, of, strict=True):
        least[g] = min(least.get(g, i), i)
    assert {r.doc_id: r.class_id for r in classes_of(docs).collect()} == {i: least[g] for i, g in zip(ids, of, strict=True)}


def test_near_duplicates_of_odd_rows(odd, nothing):
    got = classes_of(odd).collect()
    assert len(got) == 10 and Counter(r.class_size for r in got if r.doc_id == 6) == Counter({2: 2, 1: 1})
    assert all(r.class_size == 1 for r in got if r.doc_id in (2, 3, 8))
    kept = keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 9
    assert classes_of(nothing).count() == 0 and keep_one(nothing).count() == 0


def test_media_of_odd_rows(odd, nothing):
    got = media_features(odd).collect()
    texts = Counter((r.text or "").encode() for r in odd.collect())
    assert Counter(r.n_bytes for r in got) == Counter(len(t) for t in texts.elements())
    payloads = {hashlib.sha256(media.payload_of(t)).hexdigest(): media.payload_of(t) for t in texts}
    for r in got:
        p = payloads[r.payload_sha256]
        assert (r.payload_bytes, r.tail_crc32) == (len(p), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(m := media.encode_png(p)), hashlib.sha256(m).hexdigest())
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (2, 3)}) == 1
    assert media_features(nothing).count() == 0


def test_members_are_read_by_range_and_again_by_offset(spark, odd):
    path = write_archives(odd.coalesce(1), scratch_path(spark, "media"))
    whole = read_archives(spark, path)
    ranges = read_archives(spark, path, span=100)
    assert ranges.rdd.getNumPartitions() > 3
    same = lambda df: Counter((r.doc_id, r.offset, bytes(r.media)) for r in df.collect())
    assert same(whole) == same(ranges)
    folder = path.removeprefix("file://")
    name = next(x for x in os.listdir(folder) if x.endswith(".arc"))
    with open(f"{folder}/lost.arc", "wb") as f:
        f.write(b"left by a failed attempt")
    first = min(whole.collect(), key=lambda r: r.offset)
    with open(f"{folder}/{name}", "r+b") as f:
        f.seek(first.offset + 20)
        f.write(b"\xff\xff\xff")
    bad = read_archives(spark, path).collect()
    assert len(bad) == 10 and [r.media for r in bad if r.error] == [None]
    with pytest.raises(Exception, match="wrong checksum"):
        read_archives(spark, path).mapInArrow(media._described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()


def test_archives_are_rolled(spark, odd):
    """A task goes on in a new archive once one is full; all members are read, by name and directory of their own."""
    for limits in ({"members": 3}, {"archive": 200}):
        path = write_archives(odd.coalesce(1), scratch_path(spark, "media"), **limits)
        got = read_archives(spark, path).collect()
        assert len(got) == 10 and len({r.archive for r in got}) >= 4 and not [r for r in got if r.error]
        assert Counter(r.n_bytes for r in got) == Counter(len((r.text or "").encode()) for r in odd.collect())


def test_features_of_a_picture():
    """Against plain Python: rows, mean, deviation, distinct values, columns above the mean."""
    payload = media.payload_of(bytes(range(100)) * 3)
    n, mean = len(payload), sum(payload) / len(payload)
    columns = [sum(payload[i::64]) for i in range(64)]
    bits = int("".join("1" if c / (n // 64) > mean else "0" for c in columns), 2)
    spread = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
    assert media.describe(np.frombuffer(payload, np.uint8).reshape(-1, 64)) == f"{n // 64}:{mean:.4f}:{spread:.4f}:{len(set(payload))}:{bits:016x}"


def test_pictures_are_read_by_other_means():
    """A picture's bytes by the format's own rules: chunks, an inflated stream, a filter byte before each row."""
    payload = media.payload_of(b"some text " * 40)
    raw, at, found = media.encode_png(payload), 8, {}
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        found[raw[at + 4 : at + 8]] = raw[at + 8 : at + 8 + size]
        assert int.from_bytes(raw[at + 8 + size : at + 12 + size], "big") == zlib.crc32(raw[at + 4 : at + 8 + size])
        at += size + 12
    lines = zlib.decompress(found[b"IDAT"])
    assert found[b"IHDR"] == (64).to_bytes(4, "big") + (len(payload) // 64).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    assert b"".join(lines[i + 1 : i + 65] for i in range(0, len(lines), 65)) == payload and set(lines[::65]) == {0}


def test_pictures():
    for n in (0, 1, 63, 64, 65, 5000):
        p = media.payload_of(bytes(random.Random(n).randbytes(n)))
        m = media.encode_png(p)
        assert len(p) % 64 == 0 and len(p) >= max(64, n) and media.decode_png(m).tobytes() == p
    with pytest.raises(ValueError, match="checksum"):
        media.decode_png(m[:20] + b"\1" + m[21:])


@needs_model
def test_pipeline(spark, tmp_path):
    rnd = random.Random(1)
    texts = [(i, " ".join(f"w{rnd.randint(0, 900)}" for _ in range(60)), "en", f"src{i % 3}") for i in range(60)]
    texts += [(100 + i, "BUY!! NOW!! " * 20, "en", "src0") for i in range(20)]
    texts += [(200 + i, texts[i][1] + " extra", "en", "src1") for i in range(10)]
    texts = [(i, f"{t}\nCopyright notice" if i < 15 else t, a, s) for i, t, a, s in texts]
    docs = spark.createDataFrame([(i, t, a, s, len(t)) for i, t, a, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 100 <= i < 200)) for i, *_ in texts], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    one = stages["quality classifier"](spark, docs, sf)
    assert sorted(r.doc_id for r in one.collect()) == [i for i, *_ in sorted(texts) if not 100 <= i < 200] and one.columns == docs.columns
    two = stages["line dedup"](spark, one, sf)
    assert two.count() == 70 and two.filter("text LIKE '%Copyright%'").count() == 0 and two.columns == docs.columns
    assert two.filter("n_chars <> length(text)").count() == 0
    three = stages["near-duplicates"](spark, two, sf)
    assert sorted(r.doc_id for r in three.collect()) == list(range(60)) and three.columns == docs.columns
    four = stages["mixing"](spark, three, sf)
    sizes = Counter(r.doc_id for r in four.collect())
    assert set(sizes.values()) <= {1, 2} and abs(sum(sizes.values()) - 90) <= 3
    five = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in five.collect()) == sizes
    assert {r.decoded_sha256 for r in five.collect()} == {hashlib.sha256(r.text.encode()).hexdigest() for r in four.collect()}


@needs_model
def test_stages_take_odd_rows(spark, odd, nothing, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).filter(F.col("n_tokens") < 0).count() == 0
