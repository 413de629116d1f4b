"""Tokenizer alignment, periodic runs and URL filters against plain-Python brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opsrisk.llm import align, mixing, perfect, periodic, queries, urls

from .test_operators import DOCS, SF, WORD, none, odd, odd_documents, real  # noqa: F401

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- 11 tokenizer alignment


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 40_000):
        keys = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        of = perfect.slice_of(keys, 7)
        f = perfect.Function(7, {s: perfect.build(keys[of == s]) for s in np.unique(of).tolist()})
        assert sorted(f.number(keys).tolist()) == list(range(len(keys)))
        assert (f.number(rng.integers(2**62, 2**63, 500).astype(np.uint64)) == -1).all()


def test_perfect_hash_lists_what_stays(monkeypatch):
    monkeypatch.setattr(perfect, "LEVELS", 1)
    keys = np.arange(500, dtype=np.uint64)
    f = perfect.Function(1, {0: perfect.build(keys)})
    assert f.listed and sorted(f.number(keys).tolist()) == list(range(500))


def brute_alignment(docs):
    """Token by token, with dictionaries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = queries.public_pair()
    one, two = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    one.encode_special_tokens = True
    signs = align.byte_of_sign()
    count, out = Counter(), []
    for i, x in docs:
        a, b = [], []
        if x:
            e = one.encode(" " + x, add_special_tokens=False)
            a = [(k, bytes(signs[c] for c in t)) for k, t in zip(e.ids, e.tokens, strict=True)]
            b = [(k, bytes([int(p[3:5], 16)]) if two.is_byte(k) else p.replace("▁", " ").encode()) for k in two.encode(x) for p in [two.id_to_piece(k)]]
            if not b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + x).encode():
                a, b = [], []
        ends = lambda tokens: np.cumsum([0] + [len(t) for _, t in tokens]).tolist()
        a_end, b_end = ends(a), ends(b)
        links, groups, s, t = [], [], 0, 0
        for end in sorted(set(a_end[1:]) & set(b_end[1:])):
            u, v = a_end.index(end), b_end.index(end)
            links.append((a[u - 1][0], b[v - 1][0]))
            groups.append(",".join(str(k) for k, _ in a[s:u]) + "|" + ",".join(str(k) for k, _ in b[t:v]))
            s, t = u, v
        count.update(links)
        out.append((i, len(a), len(b), links, ";".join(groups)))
    most = Counter()
    for (_, b), c in count.items():
        most[b] = max(most[b], c)
    return [(i, n, m, len(k), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), sha(g) if g else "", g) for i, n, m, k, g in out]


def odd_texts():
    return [(100 + i, t) for i, t in enumerate(["\u2581x y", "a\n\nb  c\t<0x41> <s> <|endoftext|> </s>", "\x00\x01 \ufffd", "日本語 text 🎉🎉", " ", "\ufeffbom", "x" * 5000, "e\u0301 \u00a0 ﬁ"])]


def test_alignment(spark, odd):  # noqa: F811
    docs = [(r[0], r[1]) for r in odd_documents()] + odd_texts()
    df = odd.unionByName(spark.createDataFrame(odd_texts(), "doc_id long, text string"), allowMissingColumns=True)
    want = sorted(brute_alignment(docs), key=repr)
    assert sorted(map(tuple, align.align_documents(df, *queries.public_pair()).collect()), key=repr) == want
    # many passes over slices, and a tree of several levels
    align.FAN_IN, kept = 2, align.FAN_IN
    try:
        assert sorted(map(tuple, align.align_documents(df.repartition(7), *queries.public_pair(), held=300).collect()), key=repr) == want
    finally:
        align.FAN_IN = kept


def test_alignment_of_nothing(none, spark):  # noqa: F811
    assert align.align_documents(none, *queries.public_pair()).count() == 0
    got = align.align_documents(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *queries.public_pair()).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 0, 0, 0, 0, 0, "", "") for i in (1, 2)]


def test_alignment_query(spark, real):  # noqa: F811
    got = sorted(map(tuple, queries.op11_tokenizer_alignment(spark, SF).collect()))
    assert got == sorted(r[:-1] for r in brute_alignment(real))


def vocabulary_files():
    return tuple(open(p, "rb").read() for p in queries.public_pair())


def test_pieces_are_encoded_once():
    files = vocabulary_files()
    assert align.stand_alone(*files)
    al, given = align.Aligner(*files, True), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **kw):
            given.append(sum(map(len, texts)))
            return self.inner.encode_batch_fast(texts, **kw)

    al.a = Counted(al.a)
    texts = [f"every word of this text stands in the others too {i} " + "again and again " * 200 for i in range(50)]
    first = al.encode(texts)
    assert sum(given) < sum(map(len, texts)) / 50
    for x, y in zip(first, align.Aligner(*files).encode(texts), strict=True):
        assert np.array_equal(x, y)
    n = sum(given)
    al.encode(texts[::-1])
    assert sum(given) == n


def test_pieces_give_the_whole_texts_ids():
    rng = random.Random(7)
    files = vocabulary_files()
    whole, al = align.Aligner(*files), align.Aligner(*files, True)
    signs = [*"aab's\t\n\r\x0b\x1c\x85\u00a0\u3000\u180e\u200b.,0日🎉\u0301", *[" "] * 9, "'ll", " the", "<s>", "<0x41>", "<|endoftext|>", "\u2581"]
    kept, align.KEPT = align.KEPT, 300
    try:
        for _ in range(60):
            texts = ["".join(rng.choice(signs if rng.random() < 0.2 else signs[:-1]) for _ in range(rng.randint(0, 40))) for _ in range(40)]
            a, b, n_a, n_b = al.encode(texts)
            for x, y in zip((a, b, n_a, n_b), whole.encode(texts), strict=True):
                assert np.array_equal(x, y)
            a_at, b_at = np.cumsum(np.append(0, n_a)), np.cumsum(np.append(0, n_b))
            for i, t in enumerate(texts):
                ours, theirs = whole.a.encode(" " + t, add_special_tokens=False).ids, whole.b.encode(t)
                raw = (" " + t).encode()
                good = t and b"".join(whole.a_bytes[k] for k in ours) == raw and b"".join(whole.b_bytes[k] for k in theirs) == raw
                assert a[a_at[i] : a_at[i + 1]].tolist() == (ours if good else [])
                assert b[b_at[i] : b_at[i + 1]].tolist() == (theirs if good else [])
    finally:
        align.KEPT = kept


def test_pieces_only_where_both_cut():
    a, b = vocabulary_files()
    rules = json.loads(a)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": rules["pre_tokenizer"] | {"use_regex": False}}, {"pre_tokenizer": None}):
        assert not align.stand_alone(json.dumps(rules | change).encode(), b)
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    for piece, kind in (("a\u2581b", 1), ("of", 4)):
        model = ModelProto.FromString(b)
        model.pieces.add(piece=piece, score=-1e6, type=kind)
        assert not align.stand_alone(a, model.SerializeToString())


# --- 12 periodic runs


def brute_runs(w, min_length=6, min_exponent=4):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(min_length, min_exponent * q) and not any(all(w[i + t] == w[i + t + k] for t in range(size - k)) for k in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng, letters, most):
    w = []
    while len(w) < most:
        w += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
    return w[: rng.randint(0, most)]


@pytest.mark.parametrize("bounds", [(6, 4), (2, 2)])
def test_runs_of_words(bounds):
    rng = random.Random(4)
    for _ in range(1500):
        w = periodic_words(rng, rng.choice((1, 2, 3, 6)), 45) if rng.random() < 0.7 else [rng.randrange(2) for _ in range(rng.randint(0, 45))]
        assert periodic.runs(w, *bounds) == brute_runs(w, *bounds)


def test_screen_looses_no_run():
    rng = random.Random(5)
    texts = [" ".join(map(str, periodic_words(rng, rng.choice((2, 9)), 60))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    found, n = periodic._text_runs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    for i, t in enumerate(texts):
        assert sorted(found.get(i, []), key=lambda r: (r[0], r[2])) == brute_runs(t.split()) and n[i] == len(t.split())


def test_best_run_and_collapse():
    assert periodic.best_run([]) is None
    assert periodic.best_run([(0, 8, 2), (3, 12, 3), (3, 16, 4), (9, 9, 2)]) == (9, 9, 2)
    assert periodic.best_run([(5, 8, 2), (5, 12, 3)]) == (5, 8, 2)
    w = [b"a", b"b"] * 5 + [b"b"] * 6
    assert periodic.collapse(w, [(0, 10, 2), (9, 7, 1)]) == [b"a", b"b"]
    assert periodic.collapse(w[:10], [(0, 10, 2)]) == [b"a", b"b"]


def planted(i, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(b"" if i is None else str(i).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    return w


def brute_periodic(i, text):
    w = planted(i, text)
    found = brute_runs(w)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    digest = sha("".join(f"{s},{size},{q}\n" for s, size, q in found))
    tail = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (i, len(found), *tail, digest, sha(" ".join(x for k, x in enumerate(w) if k not in gone)), len(w))


def test_periodic_query_parts(spark, odd, none):  # noqa: F811
    rng = random.Random(6)
    texts = [(1000 + k, " \n".join(f"w{x}" for x in periodic_words(rng, 4, 80))) for k in range(200)]
    df = odd.unionByName(spark.createDataFrame(texts, "doc_id long, text string"), allowMissingColumns=True)
    got = periodic.periodic_runs(queries.planted_periods(df)).collect()
    want = []
    for i, t in [(r[0], r[1]) for r in odd_documents()] + texts:
        w = planted(i, t)
        gone = {k for s, size, q in brute_runs(w) for k in range(s + q, s + size)}
        want.append((repr(i), len(w), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted((repr(r.doc_id), r.n_words, r.collapsed) for r in got) == sorted(want)
    assert periodic.periodic_runs(none).count() == 0


def test_periodic_query(spark, real):  # noqa: F811
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, SF).collect()))
    short = [(i, t) for i, t in real if len(t) < 5_000]  # the others take the brute force too long
    want = sorted(brute_periodic(i, t) for i, t in short)
    ids = {i for i, _ in short}
    assert [r for r in got if r[0] in ids] == want and len(got) == len(real)
    assert any(r[1] for r in want)


# --- 13 URL filters


def test_host_and_path(spark):
    cases = {
        "http://A.Example.COM/Fr/x?q=/y": ("a.example.com", "/Fr/x"), "https://h": ("h", ""), "//h/x": ("", ""), None: ("", ""), "": ("", ""), "a://b://c/d#e": ("b:", "//c/d"),
        "x://É.net?z": ("É.net", ""), "q?u=http://in/side": ("in", "/side"), "s://h\n/p\nq/r#": ("h\n", "/p\nq/r"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = urls.host_and_path(F.col("url"))
    assert {r.url: (r.h, r.p) for r in df.select("url", host.alias("h"), path.alias("p")).collect()} == cases


def test_rules(spark):
    cases = {
        ("example.com", "/en/1"): "example.com/en/", ("www.example.com", "/en/1"): "www.example.com/en/", ("m.example.com", "/en/"): "example.com/en/", ("notexample.com", "/en/1"): "com/",
        ("com", "/"): "com/", ("com", ""): None, ("x.net", "/es/"): "net/es/", ("x.net", "/es"): None, ("x.org", "/en/"): None, ("internet", "/es/"): None,
    }
    df = spark.createDataFrame(list(cases), "host string, path string")
    assert {(r.host, r.path): r.rule for r in df.select("host", "path", urls.rule_for(F.col("host"), F.col("path"))["rule"].alias("rule")).collect()} == cases
    assert df.select(urls.rule_for(F.col("host"), F.col("path"), ()).alias("r")).where("r is not null").count() == 0


def site(spark):
    """One host: good articles, a bad tag section, few pages of another host, odd rows."""
    rows, labels = [], []
    for i in range(300):
        part = ("news", "blog", "tag")[i % 3]
        rows.append((i, f"http://Site.org/{part}/{i * 7919}{'.html' if i % 2 else ''}?x", "extra"))
        labels.append((i, part == "tag" and i % 21 != 2))
    rows += [(900, "http://tiny.org/a/b", None), (901, None, None), (902, "", None), (903, "mailto:x", None), (None, "http://site.org/tag/9", None), (5, "http://site.org/tag/9", None)]
    labels += [(900, True), (901, True), (5, False), (5, None), (None, True)]
    return spark.createDataFrame(rows, "page_id long, url string, template string"), spark.createDataFrame(labels, "page_id long, bad boolean")


def test_bad_branch_is_blocked(spark):
    pages, labels = site(spark)
    got = urls.url_filter(pages, labels).collect()
    assert len(got) == pages.count()
    for r in got:
        if r.host == "site.org":
            assert r.template.startswith(("/news/*", "/blog/*", "/tag/*")) and (r.verdict == "block") == r.template.startswith("/tag/")
            assert r.branch == "/" + r.template.split("/")[1]  # endings do not differ, so they are merged
        else:
            assert r.verdict == "allow" and r.rule is None
    assert urls.url_filter(pages, labels.limit(0)).where("verdict = 'block'").count() == 0
    assert urls.url_filter(pages.limit(0), labels).count() == 0
    first = {r.page_id: r.verdict for r in got}
    assert {r.page_id: r.verdict for r in urls.url_filter(pages.repartition(5), labels.repartition(3)).collect()} == first


def test_deep_and_long_urls(spark):
    rows = [(1, "http://h/" + "a/" * 300), (2, "http://h/" + "x" * 50_000)] + [(i, "http://h/" + "a/" * 300) for i in range(3, 12)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.template for r in urls.url_filter(pages, spark.createDataFrame([(1, True)], "page_id long, bad boolean")).collect()}
    assert got[1] == "/" + "a/" * 300 and got[2] == "/*" and len(got) == 11


def test_url_query_is_its_sql_on_odd_pages(spark, tmp_path):
    pages, _ = site(spark)
    pages.select("page_id", "url", F.lit("<p>").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(i, int(i % 3 != 2), i % 2) for i in range(300)] + [(5, None, 0), (5, None, 1), (None, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.op13_url_filters(spark, str(tmp_path))
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE['op13_url_filters']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


# --- 10 source mix: large documents


def test_mix_meets_targets_beside_a_long_text(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(1, 300)), "ab"[i % 2]) for i in range(1200)]
    for s in "ab":  # one text of about a tenth of its source
        rows.append((5000 + ord(s), " ".join(["w"] * (sum(len(t.split()) for _, t, x in rows if x == s) // 9)), s))
    for seed in range(4):
        df = spark.createDataFrame([(i + 10_000 * seed, t, s) for i, t, s in rows], "doc_id long, text string, source string")
        got = mixing.mix_copies(df).groupBy("source").agg(F.sum(F.col("copies") * F.col("size") * F.col("rows")).alias("taken"), F.first("target").alias("target")).collect()
        assert len(got) == 2 and all(abs(r.taken - r.target) <= 30 for r in got), got


def test_mix_query_meets_targets(spark):
    got = queries.op10_source_mix(spark, "/root/testdata/sf0.1").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 20 and all(abs(r.taken - r.target) <= 0.005 * r.target for r in got), got
