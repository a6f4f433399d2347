"""Corpus operators against plain versions, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import decontam, language, line_dedup, minhash, packing, pii, quality, sharding, token_files, tokens, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __gone string, node long"
BYTE, WORD = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("word_bpe_49k.json")


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line = prose(16)
    near = line[:20] + "X" + line[21:-3] + line[-2:]
    base = prose(120)
    cut = base.split(" ")
    cut[5] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(cut), "en", "b"), (4, None, "en", "a"), (5, "", None, None), (6, "   \n ", "de", "b"),
        (7, f"{line}\n{prose(14)}\n{near}", "de", "a"), (8, f"{line}\n{prose(15)}", "de", "a"), (9, "ßü Ünïcode naïve. " * 40, "fr", "b"), (10, prose(9000), "fr", "a"),
        (11, "1 2 3", "en", "a"), (12, "Short", "en", "a"), (12, "Short", "en", "a"), (13, "a  b\n\nc ", "en", "c"), (14, "x<|endoftext|>y " + prose(5), "en", "c"),
        (15, "mail a.b@c.org, call +1 (437) 555-0689, 10.0.0.300 4111 1111 1111 1111", "en", "a"),
    ]
    rows += [(100 + i, prose(rng.randint(1, 80)), rng.choice(["en", "de"]), rng.choice("aab")) for i in range(60)]
    return [(*r, len(r[1] or ""), "g", 0) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1]) for r in corpus()]


def test_edit_join_finds_every_pair():
    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        b = "".join(b)
        for edits in (1, 2, 3):
            near = distance(a, b) <= edits
            assert line_dedup.within(a, b, edits) == near
            if near and min(len(a), len(b)) > edits:
                s, r = (a, b) if len(a) >= len(b) else (b, a)
                own = {(tag, r[at : at + n]) for at, n, tag, mine in line_dedup.places(len(r), edits, 1) if mine}
                assert any((tag, s[at : at + n]) in own for at, n, tag, _ in line_dedup.places(len(s), edits, 1))


def expected_dropped(rows):
    lines = {}
    for doc, text in sorted({(d, t) for d, t in rows if t is not None}):
        for k, x in enumerate(text.split("\n")):
            if x and not x.isspace():
                lines.setdefault(x, []).append((doc, k))
    names = list(lines)
    group = list(range(len(names)))
    for i, a in enumerate(names):
        for j in range(i):
            if line_dedup.within(a, names[j], min(line_dedup.EDITS, min(len(a), len(names[j])) // line_dedup.STEP)):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    gone = set()
    for g in set(group):
        gone |= set(sorted(p for i, x in enumerate(names) if group[i] == g for p in lines[x])[1:])
    return gone


def test_line_dedup(docs, empty):
    rows = line_dedup.line_dedup(docs).collect()
    assert len(rows) == len(corpus())
    assert {(r.doc_id, k) for r in rows for k in r.dropped} == expected_dropped(texts())
    assert {(7, 2), (8, 0), (2, 0)} <= {(r.doc_id, k) for r in rows for k in r.dropped}
    assert all(r.n_dropped == len(r.dropped) == len(r.class_ids) for r in rows)
    kept = line_dedup.drop_lines(docs)
    assert kept.columns == docs.columns
    by = {r.doc_id: r for r in kept.collect()}
    assert 2 not in by and by[4].text is None and by[8].text == dict(texts())[8].split("\n")[1] and by[8].n_chars == len(by[8].text)
    assert line_dedup.line_dedup(empty).count() == 0 and line_dedup.drop_lines(empty).count() == 0


def test_equal_short_lines_are_a_class(spark):
    short = "All rights reserved."
    rows = [(1, f"{short}\n\n \nx"), (2, f"one\n{short}\n\n \nx"), (3, f"{short}\n{short}"), (4, "All rights withheld."), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.dropped, len(set(r.class_ids))) for r in line_dedup.line_dedup(frame).collect()}
    assert got == {1: ([], 0), 2: ([1, 4], 2), 3: ([0, 1], 1), 4: ([], 0), 5: ([], 0)}
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(frame).collect()} == {1: rows[0][1], 2: "one\n\n ", 4: rows[3][1], 5: None}


def test_long_lines_are_hashed_alike(spark, monkeypatch):
    rng = random.Random(10)
    rows = []
    for i in range(40):
        line = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([56, 57, 58, 59, 60, 61, 62, 63, 64, 90])))
        other = list(line)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        rows.append((i, f"{line}\n{''.join(other)}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(line_dedup, "LONG", 60)
    monkeypatch.setattr(line_dedup, "KEY_CHARS", 100)
    batch = [pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})]
    keys = pa.Table.from_batches(list(line_dedup.key_rows(iter(batch), 2, 20))).to_pydict()
    met = {}
    for key, node, shape in zip(keys["key"], keys["node"], keys["shape"], strict=True):
        met.setdefault(key, []).append((node, shape & 1))
    pairs = {frozenset((a, b)) for group in met.values() for a, x in group for b, y in group if a != b and (x or y)}
    node = lambda x: int(line_dedup.digests([x])[0, 0])
    for _, text in rows:
        a, b = text.split("\n")
        assert a == b or not line_dedup.within(a, b, 2) or frozenset((node(a), node(b))) in pairs
    assert frame.count() == len(rows)


def test_short_lines_link_by_their_length(spark):
    rng = random.Random(12)
    rows = []
    for i in range(150):
        line = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([6, 12, 19, 20, 21, 25, 39, 40, 41, 60])))
        other = list(line)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        rows.append((i, f"{line}\n{''.join(other)}"))
    got = {(r.doc_id, k) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() for k in r.dropped}
    assert got == expected_dropped(rows) and 20 < len(got) < 140


def test_line_runs_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "RUN", 8)
    rng = random.Random(9)
    head, rows = "shared start of many lines " * 3, []
    for i in range(60):
        rows.append((i, head + "".join(rng.choice("abcdefgh") for _ in range(6))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, k) for r in line_dedup.line_dedup(frame).collect() for k in r.dropped}
    assert got == expected_dropped(rows)


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


@pytest.mark.parametrize("plan", [minhash.CONTRACT, minhash.STAGE])
def test_minhash(docs, empty, plan):
    sets = [(d, shingles(t, plan.width)) for d, t in texts()]
    root = {d: d for d, _ in sets}
    for d, s in sets:
        for e, t in sets:
            if s and t and 100 * len(s & t) >= plan.similar * len(s | t):
                low, high = sorted((root[d], root[e]))
                root = {k: low if v == high else v for k, v in root.items()}
    rows = minhash.near_duplicates(docs, plan).collect()
    assert len(rows) == len(sets)
    sizes = {d: len(s) for d, s in sets}
    assert all((r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], root[r.doc_id], root[r.doc_id] == r.doc_id) for r in rows)
    assert root[2] == root[3] == 1
    assert minhash.near_duplicates(empty, plan).count() == 0


@pytest.mark.parametrize("plan", [minhash.CONTRACT, minhash.STAGE])
def test_minhash_misses_few_links(plan):
    n, p = plan.bands * plan.rows, plan.similar / 100
    dropped = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(math.ceil((p - plan.margin) * n)))
    assert (1 - p**plan.rows) ** plan.bands + dropped < 1e-8


def test_minhash_stage(docs):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and {4, 5, 6} <= set(ids)


def test_language(docs, empty):
    rows = {r.doc_id: r for r in language.language_id(docs).collect()}
    assert all(rows[d].lang_pred == "und" and rows[d].score == 0 for d in (4, 5, 6, 11))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows.values())
    assert language.language_id(empty).count() == 0
    assert language.keep_languages(docs).columns == docs.columns


def test_every_language_is_learned_within_the_bound(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "fit", lambda samples, order: seen.update(samples))
    rows = [(i, "ab " * 2000, "long") for i in range(5)] + [(100 + i, "word " * 6, "many") for i in range(300)] + [(500 + i, "x y", "few") for i in range(9)]
    language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), train_chars=60, keep_out=False)
    assert set(seen) == {"long", "many", "few"} and len(seen["few"]) == 9
    assert seen["long"] == [b"ab " * 20] and len(seen["many"]) == 2


def test_language_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.language_id(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def plain_bits(texts, text, order, alphabet, elsewhere):
    """Code length of a text by counting: method C without exclusion, contexts that no language has seen cost nothing."""
    total = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            context = text[i - k : i]
            if not any(context in t[j : j + k] for t in elsewhere for j in range(len(t) - k) if k) and k:
                continue
            counts = {}
            for t in texts:
                for j in range(k, len(t)):
                    if t[j - k : j] == context:
                        counts[t[j]] = counts.get(t[j], 0) + 1
            n, distinct = sum(counts.values()), len(counts)
            if text[i] in counts:
                total -= math.log2(counts[text[i]] / (n + distinct))
                break
            total -= math.log2(distinct / (n + distinct)) if n else 0.0
        else:
            total += 8.0
    return total


def test_context_trees_are_distributions():
    trees = language.fit([("x", [b"abracadabra", b"abba"]), ("y", [b"zyzzyva"])])
    for bits in trees.bits:
        total = (2.0 ** -bits.reshape(-1, trees.symbols, 2)[:, 1:, :].astype(float)).sum(1)
        assert (total <= 1.0 + 1e-5).all()  # escapes without exclusion only waste


def test_code_lengths_equal_a_plain_coder():
    rng = random.Random(5)
    made = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    samples = [("x", [made(b"abc", 60), made(b"abc", 9)]), ("y", [made(b"bcd", 50)])]
    trees = language.fit(samples, order=2)
    texts = [made(b"abcd", rng.randint(1, 30)) for _ in range(12)] + [b"zz!", b"a"]
    every = [t for _, ts in samples for t in ts]
    want = [[plain_bits(ts, text, 2, 256, every) for _, ts in samples] for text in texts]
    assert np.allclose(trees.costs(texts), want, rtol=1e-4)


def test_pipeline_stage_drops_foreign_texts(spark):
    rng = random.Random(2)
    words = ["the", "house", "on", "hill", "was", "green", "and", "quiet", "with", "windows"]
    prose = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, prose(), "en", i) for i in range(80)] + [(100, "漢字仮名交じり文" * 30, None, 0), (101, None, "en", 0), (102, "", "en", 0), (103, "123 456", "en", 0), (104, prose(), None, 7), (104, rows_text := prose(), None, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, Lang_x long").repartition(3)
    kept = language.keep_languages(frame)
    assert kept.columns == frame.columns
    got = sorted((r.doc_id, r.Lang_x) for r in kept.collect())
    assert got == [*[(i, i) for i in range(80)], (104, 7), (104, 7)] and rows_text


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 0, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == len({d for d, _ in texts()}) and not rows[4].keep and not rows[5].keep
    assert all(0 <= x <= 1 for r in rows.values() for x in (r.quality, r.score, r.toxicity))
    assert quality.classify(empty, labels).count() == 0


def test_quality_on_labels_it_never_saw(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    hidden = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    gone = spark.createDataFrame([(r.doc_id,) for r in hidden], "doc_id long")
    rows = {r.doc_id: r for r in quality.classify(docs, labels.join(gone, "doc_id", "left_anti")).collect()}
    assert len(hidden) > 60 and sum(rows[r.doc_id].keep == (r.quality == 1 and not r.toxic) for r in hidden) >= 0.95 * len(hidden)
    assert sum((rows[r.doc_id].toxicity >= 0.5) == bool(r.toxic) for r in hidden) >= 0.9 * len(hidden)  # some forty toxic texts to learn from


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.85
    votes = np.stack([np.where(rng.random(20_000) < a, np.where(good, 1, 2), np.where(good, 2, 1)) for a in (0.97, 0.95, 0.96, 0.94)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.share[0] - 0.85) < 0.03 and ((model.posterior(votes) > 0.5) == good).mean() > 0.98


def test_shards(docs, empty):
    rows = sharding.shard(docs, 5).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(5)]
    assert len(rows) == len(corpus()) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in range(5))
    by = dict(texts())
    assert all(r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) and r.size == len((by[r.doc_id] or "").encode()) + 8 for r in rows)
    share = sum(r.source == "a" for r in rows) / len(rows)
    assert all(abs(sum(r.source == "a" for r in rows if r.shard == s) / sizes[s] - share) < 0.2 for s in range(5))
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path, monkeypatch):
    from tokenizers import Tokenizer

    odd = ["", " ", " a", "a ", "a  b", "a \n b", "it's 's", "ΑΣ ΣΑΣ İi", "éte ́x", "漢字 テスト ａｂ", "a.\nB c", "x<|endoftext|>y z", "12 3,4 ---", "\x1c a\x85b", "Ǆ ǅ ﬁ", "İ", "İstanbul", "an İ.", "İ,\nK. Å", "J̌ ǰ", "a,b", "a..", "it's."]
    rng = random.Random(21)
    signs = ["a", "B", "é", "İ", "Σ", "ß", " ", "  ", "\n", " \n", "'s", "'", "1", "23", ".", ",", "!", "\u0301", "\u0307", "漢", "ﬁ", "Ǆ", "\t", "\x85", "<|endoftext|>", "<|", "the", "ı", "\u212a", "😀", "\r"]
    odd += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    sample = odd + [t for _, t in texts() if t]
    whole = Tokenizer.from_file(path)
    encoder = tokens.Encoder(path, spaced=path == BYTE)
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in sample]
    assert [bytes(x) for x in encoder.encode_many(sample)] == want
    assert encoder.encode(None) == b"" and [bytes(x) for x in encoder.encode_many([None, "", None])] == [b""] * 3
    monkeypatch.setattr(tokens, "GROUP_CHARS", 11)  # every longer text is cut into stretches
    monkeypatch.setattr(tokens, "MEMORY_BYTES", 2_000)
    assert [bytes(x) for x in tokens.Encoder(path, spaced=path == BYTE).encode_many(sample[:4000])] == want[:4000]


def ids_of(path, end):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return [(d, np.array([*whole.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for d, t in sorted(texts(), key=lambda r: r[0])]


def test_token_files(docs, empty):
    rows = sorted(token_files.token_file_digest(docs, BYTE).collect(), key=lambda r: r.start)
    at = 0
    for r, (doc, ids) in zip(rows, ids_of(BYTE, 0), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_file_digest(empty, BYTE).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, WORD).collect()
    ids = ids_of(WORD, 1)
    for doc, whole in {d: w for d, w in ids}.items():
        pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        copies = sum(d == doc for d, _ in ids)
        assert sum(r.length for r in pieces) == copies * len(whole)
        assert all(zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole) for r in pieces)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= packing.CAPACITY and len(used) <= sum(used.values()) / packing.CAPACITY + 2
    assert packing.pack(empty, WORD).count() == 0


def test_cuts_cover_and_fit():
    counts = packing.class_counts(2048)
    for n in range(1, 6000, 7):
        cuts = packing.cut_lengths(n, 2048)
        assert sum(cuts) == n and all(0 < c <= 2048 and packing.class_of(c, counts, 2048) * c <= 2048 for c in cuts)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(6), 1)]) for i in range(150)]
    rows += [(150, None), (151, [float("nan")] * 6), (152, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (153, [0.0] * 6), (154, rows[0][1]), (155, rows[3][1]), (200, [9.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = {i: np.floor(np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v))) * 256).astype(int) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in vectors if i % 50 == 0):
        best = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(frame).collect()}
    assert got == want
    assert topk.top_k(frame.limit(0)).count() == 0
    again = topk.top_k(frame.unionByName(frame.where("vec_id = 50")).withColumn("__extra", frame.vec_id).withColumn("ids", frame.vec_id)).collect()
    assert len(again) == len(want) and all(r.query_id == 50 or want[r.query_id, r.rank][1] <= r.score for r in again)
    assert {(r.rank, r.vec_id, r.score) for r in again if r.query_id == 50} == {(k, *v) for (q, k), v in want.items() if q == 50}


def test_queries_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [5.0, 1.0]), (2, [1.0, 7.0]), (None, [9.0, 9.0]), (3, [])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    unit = 256 * 256
    assert got == sorted([(0, 1, 1, 5 * unit), (0, 2, 2, unit), (0, 3, 3, 0), (0, 1, 2, 7 * unit), (0, 2, 1, unit), (0, 3, 3, 0)])


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_spans(text):
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    order = ("email", "ip", "card", "phone")
    return sorted((m.start(), order.index(k), m.end()) for k, m in out)


def test_private_data(docs, empty):
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice("ab@.- %+0123()é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    by = dict(texts())
    rows = pii.find(docs).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        base = plain_spans(by[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.render(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(pii.render(base).split(",")) <= set(r.spans.split(",")) or not base
    assert pii.find(empty).count() == 0


def test_tagger_on_windows_it_never_saw():
    model = pii.train()
    x, y = pii.labelled_windows(300, seed=99)
    e = pii.emissions(model, x)[0]
    paths = [pii.viterbi(e[:, j], model.trans) for j in range(x.shape[1])]
    assert np.mean([(np.array(p) == y[:, j]).mean() for j, p in enumerate(paths)]) > 0.95

    def spans(tags):
        starts = [t for t, tag in enumerate(tags) if tag % 2]
        return {(t, tags[t], next((u for u in range(t + 1, len(tags)) if tags[u] != tags[t] + 1), len(tags))) for t in starts}

    hits = total = found = 0
    for j, p in enumerate(paths):  # spans that a window holds whole
        want = {s for s in spans(y[:, j].tolist()) if 0 < s[0] and s[2] < len(p)}
        got = {s for s in spans(p) if 0 < s[0] and s[2] < len(p)}
        hits, total, found = hits + len(want & got), total + len(want), found + len(got)
    assert 2 * hits / (total + found) > 0.9
    text = "z" * 100 + " call 415-555-2671 now " + "z" * 90 + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + "z" * 70
    got = [(k, text[a:b]) for a, k, b in pii.decode(model, [text])[0]]
    assert got == [(3, "415-555-2671"), (4, "04dbebab91ab85687d33eeaaf9ac699e1188f962")]


def test_planted_personal_data_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    planted = {d for d, t in docs.select("doc_id", "text").collect() if t and re.search(r'(?i)token = "|@mail|555-[0-9]{4}|[0-9]+(\.[0-9]+){3}|[0-9]{14,19}', t)}
    caught = {d for d, r in rows.items() if r.spans}
    assert len(planted) > 20 and len(planted & caught) >= 0.95 * len(planted)
    assert len(caught - planted) <= 0.01 * len(rows)


def test_emails_behind_long_runs():
    text = ("a" * 4000 + " ") * 20 + "b" * 50_000 + "@x.org " + "c@" * 3000 + "@@y.z q@r"
    assert pii.emails(text) == [m.span() for m in EMAIL.finditer(text)]


def plain_matches(doc, item):
    w, v = ([x for x in re.split(r"[^\w]+|_", t.lower()) if x] for t in (doc or "", item or ""))
    n = min(13, len(v))
    need = n - n * 2 // 13
    best = 0
    if len(v) < 3:
        return 0
    for i in range(len(w) - n + 1):
        for j in range(len(v) - n + 1):
            best = max(best, sum(a == b for a, b in zip(w[i : i + n], v[j : j + n], strict=True)))
    return best if best >= need else 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(6)
    passage = dict(texts())[101 + 5].split(" ") + [f"w{i}" for i in range(30)]
    items = [(1, " ".join(passage)), (2, "one two three four five six"), (3, "a b"), (4, None), (5, " ".join(f"q{i}" for i in range(13)))]
    items += [(n, " ".join(f"s{n}x{i}" for i in range(n))) for n in range(7, 13)] + [(60, "three words only")]
    extra = []
    for k in range(40):
        cut = passage[3:22]
        for _ in range(rng.randint(0, 4)):
            cut[rng.randrange(len(cut))] = "zzz"
        extra.append((1000 + k, "intro " + ", ".join(cut) + " end"))
    for n in range(7, 13):
        for k in range(n):
            cut = dict(items)[n].split(" ")
            cut[k] = "zzz"
            extra += [(3000 + 20 * n + k, "a " + " ".join(cut) + " b")]
            if k + 2 < n:
                cut[k + 2] = "yyy"
                extra += [(4000 + 20 * n + k, " ".join(cut))]
    extra += [(2010, "of three words only!"), (2011, "three words, not only")]
    extra += [(2000, "xx One two THREE four-five six yy"), (2001, "one two three four five"), (2002, None)]
    frame = spark.createDataFrame(extra, "doc_id long, text string")
    rows = {r.doc_id: r for r in decontam.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for doc, text in extra:
        hits = {i: m for i, t in items if (m := plain_matches(text, t))}
        assert (rows[doc].item_ids, rows[doc].matched) == (sorted(hits), max(hits.values(), default=0))
    assert rows[2000].contaminated and rows[2010].item_ids == [60] and not rows[2011].contaminated
    assert all(r.contaminated == (d < 4000) for d, r in rows.items() if d >= 3000) and any(r.contaminated for d, r in rows.items() if d < 2000)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.decontaminate(docs, none).collect())
    assert decontam.keep_clean(docs, none).columns == docs.columns and decontam.decontaminate(empty, none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and max(r.offset + r.length for r in rows) <= packing.CAPACITY


def saved(spark, folder, rows, items):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, doc_id long, n long").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def plain_near(rows, plan):
    """{doc_id: smallest doc_id reachable}."""
    sets = [(d, shingles(t, plan.width)) for d, t in rows]
    root = {d: d for d, _ in sets}
    for d, s in sets:
        for e, t in sets:
            if s and t and 100 * len(s & t) >= plan.similar * len(s | t) and root[d] != root[e]:
                low, high = sorted((root[d], root[e]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    passage = rows[30][1]
    items = [(1, passage + " and some more words that stand here", 5, 0), (2, None, None, None), (3, "too short", 1, 1)]
    folder = saved(spark, tmp_path, rows, items)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in language.keep_languages(frame).collect()]
    gone = expected_dropped(kept)
    texts_ = []
    for d, t in kept:
        lines = t.split("\n")
        left = [x for k, x in enumerate(lines) if (d, k) not in gone]
        if len(left) == len(lines) or "\n".join(left).strip():
            texts_.append((d, "\n".join(left)))
    root = plain_near(texts_, minhash.STAGE)
    texts_ = [(d, t) for d, t in texts_ if root[d] == d]
    texts_ = [(d, t) for d, t in texts_ if not any(plain_matches(t, i) for _, i, *_ in items)]
    got = corpus_pipeline.run(spark, folder).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD)
    want = sorted((d, len(ids := [*whole.encode(t, add_special_tokens=False).ids, 1]), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, t in texts_)
    assert {d for d, *_ in want} == {r.doc_id for r in got} and {4, 5, 6, 2, 30} & {r.doc_id for r in got} == set()
    for d, n, crc in want:
        pieces = [r for r in got if r.doc_id == d]
        assert {r.doc_tokens for r in pieces} == {n} and sum(r.length for r in pieces) == n * sum(x == d for x, *_ in want)
        assert len(pieces) > 1 or pieces[0].ids_crc32 == crc
    nothing = saved(spark, tmp_path / "none", [], items)
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_rows_without_ids_and_extra_columns(spark):
    rows = [(None, "no id here"), (3, "three"), (None, "none again"), (1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(7)).withColumn("ids", F.lit("x"))
    out = sorted(((r.doc_id is not None, r.doc_id or 0), r.start) for r in token_files.token_file_digest(frame, BYTE).collect())
    assert [k for k, _ in out] == [(False, 0), (False, 0), (True, 1), (True, 3)] and [s for _, s in out] == sorted(s for _, s in out)  # null ids first
    assert sorted((r.doc_id or 0, r.length) for r in packing.pack(frame, WORD).collect())[0][0] == 0
    assert line_dedup.line_dedup(frame).count() == 4 and minhash.near_duplicates(frame).count() == 4 and sharding.shard(frame.withColumn("source", F.lit(None).cast("string")), 2).count() == 4
    labels = spark.createDataFrame([(3, 1, 0, "x", 5)], "doc_id long, quality int, toxic int, votes string, known int")
    assert quality.classify(frame, labels).count() == 4
    bench = spark.createDataFrame([(1, "three", 9, "z"), (None, "three", 1, "z")], "item_id long, text string, n long, w string")
    assert not any(r.contaminated for r in decontam.decontaminate(frame, bench).collect())


def test_token_files_are_read_in_part(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    folder = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, folder, BYTE)
    whole = {r.start: (r.doc_id, r.n_tokens, list(r.ids)) for r in token_files.read_tokens(spark, folder).collect()}
    at = 0
    for doc, ids in ids_of(BYTE, 0):
        assert whole[at] == (doc, len(ids), ids.tolist())
        at += len(ids)
    some = token_files.read_tokens(spark, folder, ["doc_id", "n_tokens"])
    assert some.columns == ["doc_id", "n_tokens"] and "ids" not in some._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    footer = pq.ParquetFile(next(p for p in (tmp_path / "tokens").glob("part-*.parquet") if pq.ParquetFile(p).metadata.num_rows)).metadata
    columns = {footer.row_group(0).column(i).path_in_schema: footer.row_group(0).column(i) for i in range(footer.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["ids.list.element"].encodings and columns["doc_id"].has_offset_index and columns["ids.list.element"].has_column_index
