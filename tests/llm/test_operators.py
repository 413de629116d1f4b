"""The operators of opsrisk.llm against plain-Python brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from opsrisk.llm import bpe, chat, jaccard, langid, mixing, ngram_lm, pages, quality, queries, suffix, topk
from opsrisk.llm.components import components

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, size string, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_documents():
    """Nulls in any column, empty and long texts, repeated rows, ties; extra columns whose names clash with inner ones."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota".split()) + str(rng.randint(0, 40)) for _ in range(n))
    same, long = text(60), text(4000)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "  \n\t", "en", None), (4, same, "en", "a"), (5, same, "de", "b"), (5, same, "de", "b"),
        (None, same, "en", "a"), (None, None, "en", "b"), (6, same + " tail", "en", "b"), (7, long, "en", "c"), (8, "one two", "en", "c"),
        (9, "é" * 300 + " ümlaut " * 30, None, "c"), (5, "same id, other text " * 12, "en", None), (10, "line\n" * 40, "en", "a"), (11, long[:3000], "en", "b"),
    ]
    return [(i, t, lang, s, None, "x", "y", None) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text or "") for r in rows]


# --- 1 quality rules


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, covered = Counter(win), set()
    for i, x in enumerate(win):
        if n[x] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_quality_counts(odd, none):
    got = sorted(map(repr, quality.text_statistics(odd.select("text")).select(COUNTS).toLocalIterator()))
    assert got == sorted(repr(r) for r in odd.sparkSession.createDataFrame([brute_counts(r[1]) for r in odd_documents()], ", ".join(f"{c} long" for c in COUNTS)).collect())
    assert quality.quality_rules(none).count() == 0 and quality.keep_good(none).columns == none.columns


def test_quality_verdict(odd):
    rows = quality.quality_rules(odd).collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert (r.distance is None) == r.base_failed and r.kept == (not r.base_failed and r.distance <= quality.CUTOFF)


def plain_estimate(x, h):
    """The least determinant that concentration to convergence finds from the whole set and from forty sets of five rows, in numpy."""
    floor = np.diag([f * f for f in quality.FLOORS.values()])
    moments = lambda rows: (x[rows].mean(0), np.cov(x[rows].T, bias=True) + floor)
    found = []
    for first in [np.arange(len(x)), *[np.random.default_rng(i).choice(len(x), 5, replace=False) for i in range(40)]]:
        (m, s), last = moments(first), np.inf
        while True:
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            m, s = moments(np.argsort(d, kind="stable")[:h])
            if np.linalg.slogdet(s)[1] > last - 1e-6:
                break
            last = np.linalg.slogdet(s)[1]
        found.append((last, m, s))
    return min(found, key=lambda f: f[0])


def test_mcd_agrees_on_real_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.col("source").alias("grp")).where("grp is not null")
    n = F.col("n_words").cast("double")
    vectors = quality.saved(quality.text_statistics(docs), "test-statistics").where(~quality.base_failed()).select(
        F.col("doc_id").alias("_id"), F.xxhash64("doc_id").alias("_h"), "grp",
        (F.log(F.col("word_chars") / n + 1) - 1.7).alias("v_length"),
        F.log1p(100.0 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("v_symbols"),
        F.log1p(100.0 * F.col("n_dup_lines") / n).alias("v_lines"), (F.col("n_repeat_words") / n).alias("v_repeats"),
    ).toPandas()
    three = list(vectors.grp.value_counts().index[:3])
    est = {r.grp: r for r in quality.mcd_estimates(spark.createDataFrame(vectors[vectors.grp.isin(three)])).collect()}
    assert sorted(est) == sorted(three)
    for g in three:
        x = vectors[vectors.grp == g][list(quality.FLOORS)].to_numpy()
        det, m, _ = plain_estimate(x, int(np.ceil(quality.H_SHARE * len(x))))
        assert est[g].log_det < det + 0.1, g
        assert np.allclose([est[g][f"m{i}"] for i in range(4)], m, atol=0.1), g


def test_small_groups_lean_on_their_language(spark):
    """An estimate moves steadily from its language's to its own as a group grows; one odd text among few of its source is rejected."""
    moments = lambda n, m, v: (n, m, 0.0, 0.0, 0.0, *[v if i == j else 0.0 for i, j in quality._PAIRS])
    levels = [("a", *moments(10, 1.0, 0.2)), ("b", *moments(100000, 1.0, 0.2)), ("p", *moments(100010, 0.0, 0.4)), ("{}", *moments(100010, 0.0, 0.4))]
    est = spark.createDataFrame(levels, "grp string, n long, " + ", ".join(f"{c} double" for c in quality._MOMENTS))
    got = {r.own: r for r in quality.shrunk_estimates(spark.createDataFrame([("a", "p", "{}"), ("b", "p", "{}")], "own string, pool string, all string"), est).collect()}
    assert abs(got["a"].m0 - 10 / 60) < 1e-3 and abs(got["b"].m0 - 1) < 1e-3
    assert abs(got["a"].l00 ** 2 - (10 * 0.2 + 50 * 0.4) / 60) < 1e-2 and abs(got["b"].l00 ** 2 - 0.2) < 1e-2
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(80))
    rows = [(i, text(), "en", "big" if i < 400 else "small") for i in range(405)] + [(500, " ".join(["#$%&|<>*#$"[: 3 + i % 7] + str(i) for i in range(80)]), "en", "small")]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, kept in got.items() if not kept] == [500]


def test_mcd_finds_planted_outliers(spark):
    rng = np.random.default_rng(5)
    clean = rng.normal(0, 1, (400, 4)) * [0.1, 0.4, 0.6, 0.1]
    bad = rng.normal(0, 0.1, (60, 4)) + [0.9, 3.4, 0, 0]
    x = np.vstack([clean, bad])
    df = spark.createDataFrame([(i, i * 7919, "g", *map(float, v)) for i, v in enumerate(x)], "_id long, _h long, grp string, " + ", ".join(f"{v} double" for v in quality.FLOORS))
    e = quality.mcd_estimates(df).first()
    # brute force: concentration steps in numpy from the same start (the whole group)
    best = np.arange(len(x))
    floor = np.diag([f * f for f in quality.FLOORS.values()])
    for _ in range(60):
        m, s = x[best].mean(0), np.cov(x[best].T, bias=True) + floor
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
        best = np.argsort(d)[: int(quality.H_SHARE * len(x))]
    assert np.allclose([e[f"m{i}"] for i in range(4)], x[best].mean(0), atol=0.08)
    assert (d[:400] < quality.CUTOFF * 2).all() and (d[400:] > quality.CUTOFF * 2).all()


# --- 2 top-k


def test_top_k_edges(spark):
    v = [(100, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (2, [0.5, -0.25]), (3, [math.nan, 1.0]), (4, None), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [math.inf, 0.0]), (200, [1.0]), (7, [-1.0, 1.0]), (300, [])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 100 == 0, 3).orderBy("query_id", "rank").collect()]
    s = 512 * 512 + 256 * 256
    assert got == [(100, 1, 1, s), (100, 2, 2, s), (100, 3, 2, s)]
    assert topk.top_k(topk.integer_vectors(df.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_nra_bounds_keep_the_best():
    rng = np.random.default_rng(1)
    for n in (10, 500):
        x, q = rng.integers(-300, 300, (n, 16)), rng.integers(-300, 300, (40, 16))
        x[n // 2 :] = x[0]  # ties
        for query, able in zip(q, topk.nra(x, q, np.full(40, 5)), strict=True):
            score = x @ query
            assert set(np.flatnonzero(score >= np.sort(score)[-5])) <= set(able.tolist())


# --- 3 byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    path, pattern = queries.public_ranks()
    ranks = bpe.load_ranks(open(path, "rb").read())
    return bpe.Tokenizer(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_tiktoken(tokenizer):
    tok, enc = tokenizer
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "22", "'s", "'t", "!", "=", "the", "ing", "日本", "🙂", "\x1c", "\x85", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["=" * 5000, "ab" * 3000, "nonon" * 900]
    for text, ids in zip(texts, tok.encode_all(texts), strict=True):
        assert ids == enc.encode_ordinary(text) == tok.encode(text)
        assert tok.decode(ids) == text.encode()


def test_merge_many_is_merge(tokenizer):
    tok, _ = tokenizer
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abnothe ing=-") for _ in range(rng.randint(1, rng.choice([4, 30, 600])))) for _ in range(1500)]
    assert bpe.merge_many(words, tok.table) == [bpe.merge(w, tok.ranks) for w in words]


def test_bpe_documents(odd, none, tokenizer):
    _, enc = tokenizer
    rows = bpe.encode_documents(odd, *queries.public_ranks()).collect()
    expect = Counter()
    for i, t, *_ in odd_documents():
        ids = enc.encode_ordinary(t or "")
        expect[(i, tuple(ids), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expect
    assert bpe.encode_documents(none, *queries.public_ranks()).count() == 0


# --- 4 Jaccard join


def brute_classes(docs):
    """doc_id -> (class_id, links, copies); ids are unique here."""
    nodes = defaultdict(list)
    for k, t in docs:
        w = t.encode().split()
        if w:
            nodes[frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))].append(k)
    sets, links = list(nodes), Counter()
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    lead = {}
    for i, s in enumerate(sets):
        lead[find(i)] = min(lead.get(find(i), 10**18), min(nodes[s]))
    out = {k: (k, 0, 1) for k, _ in docs}
    for i, s in enumerate(sets):
        for k in nodes[s]:
            out[k] = (lead[find(i)], links[i], len(nodes[s]))
    return out


def test_jaccard_classes(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(120)] for _ in range(12)]
    docs = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{i}"
        docs.append((i, " ".join(w)))
    docs += [(200, ""), (201, "one two"), (202, "one  two"), (203, "two one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    # small leaves and blocks, so that buckets split and groups span blocks
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.jaccard_classes(df, leaf=8, block=7, recall=0.99999).collect()}
    assert got == brute_classes(docs)
    # blocks bounded by their shingles instead: the same
    again = jaccard.jaccard_classes(df, leaf=8, recall=0.99999, block_shingles=900)
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in again.collect()} == got


def test_jaccard_pairs_in_a_large_bucket(spark):
    """150 texts share a passage of half their words; the near pairs among them are found, however the bucket is cut."""
    rng = random.Random(7)
    some = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = some(120)
    docs = [(2 * k, passage + some(100)) for k in range(75)]
    docs += [(k + 1, w[:190] + some(5) + w[195:]) for k, w in docs]
    docs = [(k, " ".join(w)) for k, w in docs]
    got = jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), depth=1, leaf=4, block=32).collect()
    assert {r.doc_id: r.class_id for r in got} == {k: k - k % 2 for k, _ in docs}
    assert all(r.n_links == 1 for r in got)


def test_jaccard_edges(odd, none):
    rows = jaccard.jaccard_classes(odd).collect()
    assert len(rows) == len(odd_documents())
    same = [r for r in rows if r.doc_id in (4, 6) or (r.doc_id is None and r.n_copies > 1)]
    assert len(same) == 3 and {r.class_id for r in same} == {None}  # the null id stands first
    left = jaccard.one_of_each(odd)
    assert left.columns == odd.columns and left.where("doc_id is null and text is not null").count() == 1 and left.where("doc_id = 4").count() == 0
    assert jaccard.jaccard_classes(none).count() == 0


def test_recall_formula():
    assert jaccard.survival(1.0, 3) == 1.0
    assert 1 - (1 - jaccard.survival(0.8, 3)) ** jaccard.runs_for(0.99, 0.8, 3) >= 0.99


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


# --- 5 suffix dedup


def brute_removed(docs, length):
    seen, out = set(), []
    for k, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out)


DIGEST = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def passages(n=150):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab é") for _ in range(400)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 399)
            parts += [rng.choice(base)[a : a + rng.randint(1, 300)], *rng.choice([[], ["z" * rng.randint(1, 250)], ["xy" * rng.randint(1, 150)], [str(rng.random())]])]
        docs.append((i, "".join(parts)))
    return docs


def test_suffix_dedup(spark, real):
    docs = passages()
    got = suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), keep_text=False)
    assert sorted(map(tuple, got.select(DIGEST).collect())) == brute_removed(docs, 100)


def sort_steps(docs, n_buckets):
    """The steps of the sort without Spark: removed bytes of each document, and the numbers of entries in the buckets of the last step."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"_id": [k for k, _ in docs], "_h": [0] * len(docs), "text": [t for _, t in docs]})
    dealt = pa.Table.from_batches(list(suffix._deal_anchors(n_buckets, 100)(iter([batch]))))
    spans, texts = defaultdict(list), dict(docs)
    opened = defaultdict(list)
    for b in set(dealt["bucket"].to_pylist()):
        for r in suffix._first_pass(n_buckets)(dealt.filter(pa.compute.equal(dealt["bucket"], b))).to_pylist():
            (opened if r["kind"] else spans)[r["_id"]].append(r["spans"])
    keys = sorted(opened)
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([0] * len(keys), pa.int64()), pa.array([texts[k] for k in keys]), pa.array([opened[k] for k in keys], pa.list_(pa.binary()))], names=["_id", "_h", "text", "spans"])
    entries = pa.Table.from_batches(list(suffix._deal_entries(n_buckets, 100)(iter([batch]))))
    held = Counter()
    for b in set(entries["bucket"].to_pylist()):
        own = entries.filter(pa.compute.equal(entries["bucket"], b))
        held[b] = sum(len(k) // 8 for k in own["entry_key"].to_pylist())
        for r in suffix._last_passes(n_buckets, 100)(own).to_pylist():
            spans[r["_id"]].append(r["spans"])
    return {k: n for k, v in spans.items() if (n := sum(b - a for a, b in suffix._runs(v)))}, held


@pytest.mark.parametrize(("hot", "hot_all", "flush"), [(1, 1024, 3000), (256, 2, 3000), (1, 2, 1 << 20), (256, 1024, 3000)])
def test_suffix_hot_gram(monkeypatch, hot, hot_all, flush):
    """Grams dealt out by their surroundings, and their strings one by one: blocks of several documents."""
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "HOT_ALL", hot_all)
    monkeypatch.setattr(suffix, "FLUSH", flush)
    docs = passages(80)
    assert sort_steps(docs, 4)[0] == {k: n for k, _, n, _, _ in brute_removed(docs, 100) if n}


def test_suffix_passage_in_a_third_of_all_documents(monkeypatch):
    monkeypatch.setattr(suffix, "FLUSH", 300_000)
    rng = random.Random(6)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = own(300)
    docs = [(i, own(150) + (passage + own(150) if i % 3 == 0 else "")) for i in range(6000)]
    got, held = sort_steps(docs, 32)
    want = {k: n for k, _, n, _, _ in brute_removed(docs, 100) if n}
    assert got == want and len(want) == 1999
    assert max(held.values()) < 0.05 * sum(held.values())


def test_suffix_length_is_checked(none):
    for length in (39, 148):
        with pytest.raises(ValueError, match="length"):
            suffix.remove_repeats(none, length=length)


def test_suffix_edges(odd, none):
    rows = suffix.remove_repeats(odd, carry=("_id", "source")).collect()
    assert len(rows) == len(odd_documents()) and all(r.carried.c0 == "x" for r in rows)
    # the null id is first and keeps its text; a repeated row is not its own copy, but one of the null id's
    kept = [r for r in rows if r.doc_id is None and r.n_bytes]
    assert [r.n_removed for r in kept] == [0]
    assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id == 4)
    assert [r.n_spans for r in rows if r.doc_id == 8] == [0]
    assert suffix.remove_repeats(none).count() == 0
    twice = odd.where("doc_id = 7").unionByName(odd.where("doc_id = 7"))
    assert len({tuple(r) for r in suffix.remove_repeats(twice).select(DIGEST).collect()}) == 1


# --- 6 language model


def test_interpolation(spark, real):
    docs = real[:300]
    rows = ngram_lm.interpolated_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {k: WORD.findall(t.translate(lower)) + [None] for k, t in docs}
    out = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in docs}
    c = Counter(w for k, x in tokens.items() if not out[k] for w in x)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(docs)
    for r in rows:
        x = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_interpolation_weights_use_every_document(spark, real, monkeypatch):
    """Many small blocks whose ids follow the kind of text: the scores are those of weights from all learning documents."""
    docs = [(k, " ".join(f"same{j % 7}" for j in range(k % 40 + 5))) for k in range(100)] + [(1000 + k, t) for k, t in real[:150]]
    monkeypatch.setattr(ngram_lm, "BLOCK", sum(len(t.encode()) + 1 for _, t in docs) // 20)
    got = {r.doc_id: r.score for r in ngram_lm.interpolated_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {k: WORD.findall(t.translate(lower)) + [None] for k, t in docs}
    learns = [k for k, _ in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    pairs = {k: list(zip([0, *x[:-1]], x, strict=True)) for k, x in tokens.items()}  # 0: a text's start
    c = Counter(w for k in learns for w in tokens[k])
    c2 = Counter(p for k in learns for p in pairs[k])
    c1 = Counter({0: len(learns)} | {w: c[w] for w in c if w is not None})
    n, vocabulary = sum(c.values()), len(c)
    held = [(c1[v], c2[v, w], c[w]) for k in learns for v, w in pairs[k]]
    v, vw, w = np.array(held).T - 1
    codes = (ngram_lm.magnitude(v) * 1000 + ngram_lm._bin(vw / np.maximum(v, 1))) * 1000 + ngram_lm._bin(w / (n - 1))
    weights = ngram_lm.learn_weights(Counter(codes.tolist()), vocabulary)
    for k, x in pairs.items():
        want = 0.0
        for v, w in x:
            l2, l1, l0 = weights[min(c1[v].bit_length(), ngram_lm.BUCKETS - 1)]
            want += math.log10((l2 * c2[v, w] / c1[v] if c1[v] else 0) + l1 * c[w] / n + l0 / (vocabulary + 1))
        assert got[k] == pytest.approx(want, rel=1e-9)


def test_interpolated_probabilities_sum_to_one():
    weights = ngram_lm.learn_weights({(3 * 1000 + 150) * 1000 + 100: 5, (5 * 1000) * 1000 + 120: 7}, 10)
    assert weights.shape == (ngram_lm.BUCKETS, 3) and np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0


def test_lm_edges(odd, none):
    rows = ngram_lm.interpolated_scores(odd).collect()
    assert len(rows) == len(odd_documents())
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2, 3))
    assert ngram_lm.interpolated_scores(none).count() == 0


# --- 7 language identification


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = langid.crc_fold(F.col("doc_id"), 4) == 2
    model = langid.learn(docs.where(~held).select(F.col("doc_id").alias("key"), "text", "lang"))
    got = langid.identify(docs.where(held).select("doc_id", "text", "lang"), model, keep=("doc_id", "lang")).collect()
    known = [r for r in got if r.lang is not None and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in known) / len(known) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(odd, none):
    model = langid.learn(odd.select(F.col("doc_id").alias("key"), "text", "lang"))
    got = langid.identify(odd.select("doc_id", "text"), model).collect()
    assert len(got) == len(odd_documents())
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and {r.lang_pred for r in got} <= {"und", "en", "de"}
    empty = langid.learn(none.select(F.col("doc_id").alias("key"), "text", "lang"))
    assert {r.lang_pred for r in langid.identify(odd.select("doc_id", "text"), empty).collect()} == {"und"}
    assert langid.identify(none.select("doc_id", "text"), model).count() == 0


# --- 8 chat


def brute_viterbi(model, emission):
    """Best path by trying all, and by how much it beats the next."""
    import heapq
    import itertools

    score = lambda p: model["first"][p[0]] + sum(model["step"][a, b] for a, b in zip(p, p[1:], strict=False)) + sum(e[r] for e, r in zip(emission, p, strict=True))
    best = heapq.nlargest(2, itertools.product(range(chat.STATES), repeat=len(emission)), key=score)
    return best[0], score(best[0]) - score(best[1])


def test_viterbi_and_pieces():
    rng = np.random.default_rng(2)
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    n = chat.STATES
    model = {"first": log(rng.random(n)), "step": log(rng.random((n, n)))}
    for k in (1, 2, 6):
        e = np.log(rng.random((k, n)))
        best, _ = brute_viterbi(model, e)
        assert tuple(chat.decode(model, e, None, None)) == best
        assert chat.fold(model, e)[n].argmax() == best[-1]


TRANSCRIPT = "User: hi\nthere\nAssistant: hello\n\nwhat is it?\nUser: this: a list\n- one\nAssistant: fine<|im_end|>"


def test_transcript_of_several_turns(spark):
    known = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"line {c}\nand {t}") for c in range(40) for t in range(4)], "conv_id long, turn long, role string, text string")
    model = chat.learn(known)
    tagged = "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nwhy?<|im_end|>"
    faq = "Q: is A: b a colon?\nA: yes\nme: no marker"
    rows = [(1, 0, TRANSCRIPT), (1, 1, "one more\nquestion"), (2, 0, tagged), (3, 0, faq), (None, 0, TRANSCRIPT), (4, 0, "plain text\nof two lines")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, text string, part int, lines string")
    for piece in (1, 4096):
        got = {(r.conv_id, r.turn): [(t.role, t.text) for t in r.turns] for r in chat.recover_roles(df, model, piece=piece).collect()}
        want = [("user", "hi\nthere"), ("assistant", "hello\n\nwhat is it?"), ("user", "this: a list\n- one"), ("assistant", "fine")]
        assert got[1, 0] == want == got[None, 0] and got[1, 1] == [("user", "one more\nquestion")]
        assert got[2, 0] == [("system", "be kind"), ("user", "why?")] and got[4, 0] == [("user", "plain text\nof two lines")]
        assert got[3, 0][0] == ("user", "is A: b a colon?") and got[3, 0][1][0] == "assistant"


def test_chat_states_equal_brute_force(spark):
    rng = random.Random(8)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    model = chat.learn(turns)
    rows = [(c, t, "\n".join(rng.choice(["User: a?", "Assistant: b", "plain", "Why?", "", "System:"]) for _ in range(rng.randint(1, 3)))) for c in range(30) for t in range(2)]
    rows = rows + rows[:6]  # repeated rows
    got = Counter((r.conv_id, r.turn, tuple((t.role, t.text) for t in r.turns)) for r in chat.recover_roles(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3), model, piece=2).collect())
    want = Counter()
    for c in range(30):
        own = sorted((t, x) for k, t, x in rows if k == c)
        seen = [chat.observe(x) for _, x in own]
        if sum(map(len, seen)) > 6:  # 6 states to the power of the lines
            continue
        (states, lead), at = brute_viterbi(model, chat.emissions(model, np.array([o for x in seen for o in x]))), 0
        if lead < 1e-6:  # either path is right
            continue
        for (t, x), o in zip(own, seen, strict=True):
            want[c, t, tuple(chat.split_turns(x, states[at : at + len(o)]))] += 1
            at += len(o)
    assert len(want) >= 20
    assert {k: got[k] for k in want} == dict(want)


def test_hot_conversation(spark):
    turns = spark.range(100_000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("text "), "id", F.when(F.col("id") % 2 == 0, "?").otherwise(".")).alias("text"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"))
    turns = turns.repartition(8)
    model = chat.learn(turns.where("turn < 1000"))
    got = chat.recover_roles(turns.drop("role"), model).join(turns.drop("text"), ["conv_id", "turn"])
    assert got.where("role = role_pred").count() == 100_000
    assert np.allclose(model["step"], chat.learn(turns.where("turn < 1000").coalesce(1))["step"])


def test_chat_pieces_equal_whole(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    model = chat.learn(turns.where("conv_id % 2 = 0"))
    whole = sorted(map(tuple, chat.recover_roles(turns, model).drop("turns").collect()))
    assert whole == sorted(map(tuple, chat.recover_roles(turns, model, piece=2).drop("turns").collect()))
    truth = {(r.conv_id, r.turn): r.role for r in turns.collect()}
    held = [(c, t, r) for c, t, r, _ in whole if c % 2]
    assert sum(truth[c, t] == r for c, t, r in held) / len(held) > 0.95


def test_chat_markers_and_edges(spark):
    model = chat.learn(spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y"), (1, 2, None, None)], "conv_id long, turn long, role string, text string"))
    turns = [(1, 0, "Human: hi there"), (1, 1, "Assistant: hello"), (2, 0, "### System:\nbe kind"), (2, 1, "<|user|>\nwhy?"), (2, 2, None), (None, 0, "AI: alone"), (None, 0, "User: alone"), (3, None, ""), (1, 1, "Assistant: hello")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, text string, _n string")
    got = [(r.conv_id, r.role_pred, r.rendered) for r in chat.recover_roles(df, model).collect()]
    assert len(got) == len(turns)
    assert (1, "user", "<|user|>\nhi there\n<|end|>") in got and (1, "assistant", "<|assistant|>\nhello\n<|end|>") in got
    assert (2, "system", "<|system|>\nbe kind\n<|end|>") in got and (2, "user", "<|user|>\nwhy?\n<|end|>") in got
    assert (None, "assistant", "<|assistant|>\nalone\n<|end|>") in got and (None, "user", "<|user|>\nalone\n<|end|>") in got
    assert chat.recover_roles(df.limit(0), model).count() == 0


# --- 9 pages


def page(body, extra=""):
    return (
        '<html><head><title>t</title><script>var x="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>'
        f'<div class="cookie-notice">We use cookies</div><div class="wrap12"><div id=main class="post-77 story">{body}</div><aside>side</aside></div>'
        f'{extra}<div class="comments"><p>first comment</p></div><form><label>mail</label></form><footer>&copy; us</footer></body></html>'
    )


def test_main_text(spark):
    article = "<h1>Title &amp; more</h1><p>First  para<br>goes\non, at good length for a paragraph.<p>Second <b>bold<p>Third &lt;tag&gt; <!-- no --> end<style>p{}</style>"
    rows = [
        (1, "http://a.example.com/1", page(article)), (2, "http://A.example.com:80/2", page("<p>short</p>", extra=f"<div class=promo><p>{'buy ' * 200}</p></div>")),
        (3, None, page("<p>no host</p>")), (4, "http://a.example.com/4", None), (5, "not a url", ""), (6, "http://b.example.com/", "plain text &eacute; < 5"), (None, "http://a.example.com/1", page(article)),
        (7, "http://c.example.com/", "<p>unclosed <a href='x>y"),
    ]
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path int")).collect()}
    want = "Title & more\nFirst para goes on, at good length for a paragraph.\nSecond bold\nThird <tag> end"
    assert got[1].text == want == got[None].text and got[1].n_chars == len(want)
    assert got[2].text == "short" and got[2].path == got[1].path  # the host's path, though the promotion is longer
    assert got[3].text == "no host" and got[3].path is None
    assert (got[4].text, got[5].text, got[6].text) == ("", "", "plain text é < 5")
    assert got[7].text.startswith("unclosed")


def test_names_of_whole_pages_are_no_furniture(spark):
    text = "<h1>Title</h1><p>All of the text.</p>"
    rows = [
        (1, "http://a.example.com/", f'<body class="has-sidebar"><div class="no-sidebar">{text}</div><div class="sidebar">beside</div></body>'),
        (2, "http://b.example.com/", f'<body><main class="overflow-hidden page-widget">{text}</main><div class="hidden">unseen</div></body>'),
        (3, "http://c.example.com/", f'<body><article class="single-comments">{text}</article><p class="visually-hidden">unseen</p></body>'),
        (4, "http://d.example.com/", f'<body><nav>menu</nav><div id="page-widget">{text}</div></body>'),
        (5, None, f'<body><div class="overflow-hidden">{text}</div></body>'),
    ]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == dict.fromkeys(range(1, 6), "Title\nAll of the text.")


def test_main_text_keeps_what_stands_beside_the_largest_part(spark):
    long = "a long section of the text " * 20
    body = f"<h1>Title</h1><p>Introduction.</p><div class=body><p>{long}</p><blockquote>Quoted.</blockquote></div><section><h2>Last</h2><ul><li>One.</li></ul></section>"
    rows = [(k, f"http://a.example.com/{k}", f"<body><nav>menu</nav><div class=links><a href=x>other pages</a></div><article>{body}</article><div class=ad>buy</div></body>") for k in range(3)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["\n".join(["Title", "Introduction.", long.strip(), "Quoted.", "Last", "One."])] * 3


# Ten layouts; text in [[ ]] is the article's. {k} differs from page to page.
LAYOUTS = {
    "headline": "<header>Site {k}</header><article><header><h1>[[Headline {k}]]</h1></header><p>[[The body of story {k} is told here.]]</p></article>",
    "legal": "<article><h1>[[Title {k}]]</h1><p>[[Text {k} of some length, as texts are.]]</p></article><div class=legal>Copyright and all the legal words that nobody reads</div>",
    "teasers": "<div class=post><h1>[[Title {k}]]</h1><p>[[Text {k} of some length, as texts are.]]</p></div><div class=teasers><div class=t>Another story</div><div class=t>One more story</div></div>",
    "ids": "<article><h1>[[Title {k}]]</h1><section id=social-policy><p>[[Policy {k} is a social matter.]]</p></section><div class=story-share-price><p>[[Shares rose {k} times.]]</p></div><p class=register>[[Register {k} of ships.]]</p></article>",
    "comments": "<article><h1>[[Title {k}]]</h1><p>[[Text {k}.]]</p><section class=comments><p>A reader's comment on {k}, much longer than the text itself is.</p></section></article><div id=post-comments>First! {k}</div>",
    "formula": "<article><h1>[[Law {k}]]</h1><p>[[We find <math><mi>E</mi><mo>=</mo><mi>m{k}</mi></math> here]]</p><noscript><p>[[Figure {k} shows it.]]</p></noscript></article><noscript>Turn scripts on</noscript>",
    "flat": "<nav>menu</nav><h1>[[Title {k}]]</h1><p>[[Text {k} of some length, as texts are.]]</p><h2>[[Part {k}]]</h2><p>[[More of {k}.]]</p><div class=imprint>All rights are with their owners, whoever these are</div>",
    "sections": "<main><h1>[[Title {k}]]</h1><div class=intro>[[Introduction {k}]]</div><div class=body><p>[[Long text {k} with many words of the story in it.]]</p><blockquote>[[Quoted {k}]]</blockquote></div></main><div class=box>Opening hours: nine to five</div>",
    "byline": "<article><h1>[[Title {k}]]</h1><div class=author>[[By A. Writer]]</div><div class=text><p>[[Text {k} of some length, as texts are.]]</p></div></article><aside>Beside {k}</aside><div class='cookie-bar bottom'>We use them</div>",
    "stray": "<div id=page-widget><h1>[[Title {k}]]</h1><p>[[Text {k} of some length, as texts are, and then some.]]</p></div><footer>Foot {k}</footer>",
}


def layout_page(layout, k):
    source = LAYOUTS[layout].replace("{k}", str(k))
    want = "\n".join(re.sub(r"<[^>]*>", "", x) for x in re.findall(r"\[\[(.*?)\]\]", source))
    return source.replace("[[", "").replace("]]", ""), want


def test_main_text_of_ten_layouts(spark):
    rows, want = [], {}
    for i, layout in enumerate(LAYOUTS):
        for k in range(5):
            page_id = 10 * i + k
            source, want[page_id] = layout_page(layout, k)
            rows.append((page_id, f"http://{layout}.example.com/{k}", f"<html><body>{source}</body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.main_text(df.repartition(5)).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert got[20].path == "html>body>div.post" and got[10].path == "html>body>article"
    copies = df.union(df).union(df)  # copies of a page vote once and are no recurring text
    assert Counter((r.page_id, r.text) for r in pages.main_text(copies).collect()) == Counter({(i, t): 3 for i, t in want.items()})


def brute_votes(rows):
    """Votes by the definition: dictionaries instead of joins."""
    hosts = {}
    for host, source in rows:
        parts = pages.sections(*pages.parse(source))
        hosts.setdefault(host, {})[tuple(sorted(parts.items()))] = parts
    out = {}
    for host, looks in hosts.items():
        texts = {}
        for parts in looks.values():
            for path, (text, _, _) in parts.items():
                texts.setdefault(path, []).append(text)
        recurring = {p for p, t in texts.items() if len(t) >= 3 and 2 * len(set(t)) <= len(t)}
        votes = {}
        for parts in looks.values():
            used = {p: x[1] for p, x in parts.items() if x[1] and not x[2] and p not in recurring}
            if used:
                path = pages.common(list(used))
                if not path:
                    continue
                n, score = votes.get(path, (0, 0))
                votes[path] = (n + 1, score + sum(used.values()))
        out[host] = min(votes, key=lambda p: (-votes[p][0], -votes[p][1], p)).rstrip(">") if votes else None
    return out


def test_host_votes_equal_brute_force(spark):
    rng, names = random.Random(4), list(LAYOUTS)
    rows = []
    for i in range(240):  # a third of the pages on one host, layouts mixed on it
        host = "hot.example.com" if i % 3 == 0 else f"h{rng.randint(0, 15)}.example.com"
        rows.append((i, host, layout_page(rng.choice(names), rng.randint(0, 9))[0]))
    df = spark.createDataFrame([(i, f"http://{h}/{i}", s) for i, h, s in rows], "page_id long, url string, html string").repartition(4)
    got = {r.host: r.path for r in pages.main_text(df).select("host", "path").distinct().collect()}
    assert got == brute_votes([(h, s) for _, h, s in rows])


def test_main_text_of_long_and_odd_pages(spark):
    long = "<p>" + "word " * 400_000 + "</p>"
    deep = "<div>" * 30000 + "deep" + "</div>" * 30000
    rows = [(1, "http://a.example.com/", f"<article><h1>T</h1>{long}</article>"), (2, "http://b.example.com/", deep), (3, "http://c.example.com/", "<div class='a>b'>x</div>"), (4, "http://d.example.com/", "<nav>only a menu</nav>"), (5, "http://e.example.com/", "<p><a href=x>only a link</a>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert got[1] == "T\n" + ("word " * 400_000).strip() and got[2] == "deep" and got[3] == "x" and got[4] == "" and got[5] == "only a link"
    assert pages.main_text(df.limit(0)).count() == 0


# --- 10 mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
        rest -= sum(target[s] for s in over)
        free -= over
    return target


def test_mix(spark):
    rng = random.Random(9)
    docs = [(i, "w " * rng.randint(0, 60), rng.choice(["b", "a", "é", None, "A"] + ["big"] * 9)) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix_copies(df, group=50).collect()
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
    target = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len(docs[r.doc_id][1].split()) and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.copies in (math.floor(target[r.source] / sizes[r.source] + 1e-9), math.ceil(target[r.source] / sizes[r.source] - 1e-9)) or r.size == 0
        taken[r.source] += r.copies * r.size
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= 60 for s in sizes)
    again = mixing.mix_copies(df.repartition(3), group=50).collect()
    assert {r.doc_id: r.copies for r in got} == {r.doc_id: r.copies for r in again}
    out = mixing.mixed_documents(df, group=50)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_pivotal_rounding_keeps_sums():
    rng = np.random.default_rng(3)
    total = np.zeros(30)
    for _ in range(2000):
        p, size = np.full(30, 0.3), np.arange(1.0, 31)
        out, left = mixing.round_group(p, size, rng.random(30))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != left)
        total += out
    assert np.allclose(total / 2000, 0.3, atol=0.06)


def test_mix_edges(odd, none):
    got = mixing.mix_copies(odd).collect()
    assert sum(r.rows for r in got) == len(odd_documents())
    assert all(r.copies == 0 for r in got if r.size == 0)
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix_copies(none).count() == 0 and mixing.mixed_documents(none).count() == 0
