"""The corpus pipeline against a plain-Python version of its exact parts, and the registration."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from opsrisk.llm import bpe, mixing, quality, queries
from opsrisk.llm.shared import saved

from .test_operators import brute_classes, brute_removed

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_top_k_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(con.sql(queries.ORACLE["op2_nra_top_k"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["op2_nra_top_k"](spark, SF).collect())) == want


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    read = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    good = saved(stages["quality rules"](spark, docs, SF), "t1")
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert good.columns == docs.columns and {k for k, _ in read(good)} == kept
    single = saved(stages["n-gram Jaccard join"](spark, good, SF), "t2")
    classes = brute_classes(read(good))
    assert {k for k, _ in read(single)} == {k for k, (lead, _, _) in classes.items() if lead == k}
    deduped = saved(stages["suffix-array dedup"](spark, single, SF), "t3")
    want = {k: n - gone for k, n, gone, _, _ in brute_removed(sorted(read(single)), 100)}
    for r in deduped.collect():
        assert abs(len(r.text.encode()) - want[r.doc_id]) <= 3 * 10 and r.n_chars == len(r.text)
    mixed = saved(stages["mixing sources to target weights"](spark, deduped, SF), "t4")
    copies = {r.doc_id: r.copies for r in mixing.mix_copies(deduped).collect()}
    assert Counter(k for k, _ in read(mixed)) == {k: n for k, n in copies.items() if n}
    path, pattern = queries.public_ranks()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(open(path, "rb").read()), special_tokens={})
    texts = dict(read(mixed))
    last = stages["byte-level BPE"](spark, mixed, SF).collect()
    assert len(last) == mixed.count()
    for r in last:
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
