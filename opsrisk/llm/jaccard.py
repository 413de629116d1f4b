"""N-gram Jaccard join by chosen paths.

Each text is its set of five-word shingles; equal sets are one node. A set is
sketched by minhash values, so that two sets share a sketch token (coordinate,
value) with probability equal to their similarity. A run splits all sets
recursively: at every tree node one or two coordinates are drawn from the node's
path, and a set goes to the child of its token there, so sets that share many
tokens stay together. A bucket of one set ends, a small bucket is searched by brute
force, and a large one splits again, up to DEPTH levels; one that is still large
then is searched whole, too, in blocks: parts with the bucket's least set first, and
then every set that this does not connect with the least against all sets of the
bucket. A pair of similarity s
survives k levels of a run with probability p_k = E[1 - (1 - s p_(k-1))^m], m the
number of coordinates drawn; runs repeat until 1 - (1 - p)^runs reaches the target
recall at the threshold itself (more similar pairs: higher).

Buckets only say which sets to compare: they give candidate groups, whose
pairs are then all verified on the full shingle sets, block by block. What
leaves a block is the number of links of each set and a spanning forest of its
links, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import row_key, saved, ship
from .textbytes import chunks, column_bytes, mix, shingle_hashes, word_hashes

SHINGLE = 5
THRESHOLD = (4, 5)  # similarity of at least 4/5
COORDINATES = 64
DEPTH = 3
LEAF = 200  # sets that a bucket may hold to be searched by brute force
BLOCK = 512  # sets of one side of a verified block, about
BLOCK_SHINGLES = 4 << 20  # and their shingles: a group of very long texts has smaller blocks
RECALL = 0.999
_DRAW = np.random.default_rng(20250101)
_MUL = _DRAW.integers(0, 2**63, COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _DRAW.integers(0, 2**63, COORDINATES, dtype=np.int64).astype(np.uint64)


def survival(similarity: float, depth: int) -> float:
    """Probability that a pair shares a path of ``depth`` levels; a level draws one coordinate, or two with probability 1/4."""
    p = 1.0
    for _ in range(depth):
        p = 0.75 * similarity * p + 0.25 * (1 - (1 - similarity * p) ** 2)
    return p


def runs_for(recall: float, similarity: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and each text's offset into them."""
    shingles, at = shingle_hashes(*word_hashes(data, offsets), k)
    parts = [np.unique(shingles[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return (np.concatenate(parts) if parts else shingles), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


_SKETCH = "_id long, _h long, node long, check long, size int, sketch binary"


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for i, j in chunks(offsets):
                flat, at = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                size = np.diff(at)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                cuts = at[:-1][full]
                node = np.add.reduceat(mix(flat), cuts)
                check = np.bitwise_xor.reduceat(mix(flat * _MUL[0] + _ADD[0]), cuts)
                sketch = np.empty((len(full), COORDINATES), np.uint32)
                for c in range(COORDINATES):
                    sketch[:, c] = np.minimum.reduceat((flat * _MUL[c] + _ADD[c]) >> np.uint64(32), cuts)
                pick = pa.array(full + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array(size[full].astype(np.int32)), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=["_id", "_h", "node", "check", "size", "sketch"],
                )

    return run


def _split(runs: int | None):
    """Children of (path, node, sketch) rows; ``runs`` roots for rows without a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            roots = [np.full(len(node), r + 1, np.uint64) for r in range(runs)] if runs else [batch.column("path").to_numpy().view(np.uint64)]
            for path in roots:
                draw = mix(path * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
                first = draw % np.uint64(COORDINATES)
                second = (draw >> np.uint64(20)) % np.uint64(COORDINATES)
                two = ((draw >> np.uint64(40)) % np.uint64(4) == 0) & (second != first)
                for coordinate, use in ((first, np.arange(len(node))), (second, np.flatnonzero(two))):
                    c = coordinate[use].astype(np.int64)
                    child = mix(mix(path[use] ^ draw[use]) + sketch[use, c].astype(np.uint64) * np.uint64(64) + c.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(node[use])], names=["path", "node"])

    return run


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """Least index of every row's component in a symmetric adjacency matrix."""
    n = len(adjacent)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(adjacent, label[None, :], n).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


_NEAR = "path long, a long, b long, apart boolean"


def _search_bucket(agree: int):
    """Links (a, b) of a bucket, of a part of a large one or of a block; apart: a set of a part that is not connected with its least."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        path, in_part = table["path"][0].as_py(), table["large"][0].as_py()
        nodes, where = np.unique(nodes, return_index=True)
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint32).reshape(-1, COORDINATES)[where]
        same = np.zeros((len(nodes), len(nodes)), np.uint8)
        for c in range(COORDINATES):
            same += sketch[:, None, c] == sketch[None, :, c]
        adjacent = same >= agree
        label = _labels(adjacent)
        apart = (label != 0) & in_part
        told = (label != np.arange(len(nodes))) | apart
        n = int(told.sum())
        return pa.table({"path": pa.array([path] * n, pa.int64()), "a": nodes[told], "b": nodes[label[told]], "apart": apart[told]})

    return run


def _leaves(nodes: DataFrame, runs: int, depth: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(path, part, node, large): buckets to search. A bucket that is large at the last level is cut into parts that all hold its
    least set. And (path, node, n): the sets of those large buckets, and how many each has."""
    rows = saved(nodes.select("node", "sketch").mapInArrow(_split(runs), "path long, node long"), "paths")
    out = []
    for level in range(1, depth + 1):
        size = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
        sized = rows.join(size, "path")
        if level < depth:
            out.append(sized.where(F.col("n") <= leaf).select("path", F.lit(0).cast("long").alias("part"), "node", F.lit(False).alias("large")))
            large = sized.where(F.col("n") > leaf).select("path", "node")
            # paths are drawn by the level as well: a child's path is a hash of its parent's
            rows = saved(large.join(nodes.select("node", "sketch"), "node").mapInArrow(_split(None), "path long, node long"), f"paths-{level}")
        else:
            parts = F.ceil(F.col("n") / leaf)
            out.append(sized.select("path", F.pmod(F.xxhash64("path", "node"), parts).alias("part"), "node", (F.col("n") > leaf).alias("large")))
            out.append(size.where(F.col("n") > leaf).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / leaf) - 1)).alias("part"), F.col("least").alias("node"), F.lit(True).alias("large")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found, sized.where(F.col("n") > leaf).select("path", "node", "n")


def _blocks(apart: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """(path, i, j, node): every set of ``apart`` beside every set of its large bucket, in blocks of about ``block`` sets of each."""
    sizes = apart.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("rows"))
    held = large.join(sizes, "path").withColumn("columns", F.ceil(F.col("n") / F.lit(block)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("path", "node"), F.col(n))
    columns = held.select("path", every("rows").alias("i"), mine("columns").alias("j"), "node")
    rows = held.join(apart, ["path", "node"], "left_semi").select("path", mine("rows").alias("i"), every("columns").alias("j"), "node")
    return columns.unionByName(rows)


_VERIFIED = "node long, links long, root long"


def _verify_block(top: int, bottom: int):
    def run(table: pa.Table) -> pa.Table:
        nodes, side = table["node"].to_numpy(), table["side"].to_numpy()
        nodes, where = np.unique(nodes * 1, return_index=True)
        blobs = table["shingles"].to_pylist()
        sets = [np.frombuffer(blobs[i], np.uint64) for i in where.tolist()]
        side = side[where]
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        _, word, often = np.unique(flat, return_inverse=True, return_counts=True)
        shared = often[word] > 1  # others are in no intersection
        word, owner = word[shared], owner[shared]
        _, word = np.unique(word, return_inverse=True)
        common = np.zeros((len(sets), len(sets)))  # a part's counts are exact as float32, their sum needs more digits
        width = 4096
        order = np.argsort(word, kind="stable")
        word, owner = word[order], owner[order]
        for start in range(0, int(word[-1]) + 1 if len(word) else 0, width):
            a, b = np.searchsorted(word, (start, start + width))
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], word[a:b] - start] = 1
            common += part @ part.T
        union = size[:, None] + size[None, :] - common
        adjacent = bottom * common >= top * union
        np.fill_diagonal(adjacent, False)
        if side.any():  # two blocks: pairs inside either are counted elsewhere
            adjacent &= side[:, None] != side[None, :]
        label = _labels(adjacent)
        return pa.table({"node": nodes, "links": adjacent.sum(axis=1).astype(np.int64), "root": nodes[label]})

    return run


def jaccard_classes(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, depth: int = DEPTH, leaf: int = LEAF, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Near-duplicate classes of texts.

    Returns one row for each row of ``docs``: doc_id, _id, _h, class_id (doc_id of the class's first document), n_links (other
    shingle sets whose similarity to this text's is at least the threshold, verified on the whole sets), n_copies (rows with
    the same shingle set, this one included), first (whether the document is its class's first).

    Classes are the connected components of the links; texts with the same set are always in one. Words are separated by ASCII
    blanks; a text of one to four words is one shingle; a null text or one without words is in a class of its own, without links.
    Documents are ordered by id (a null id first), then by a hash of the text; rows equal in both are one document and get equal
    results. An empty table gives no rows. Only doc_id and text are read. Sets are told apart by a 64-bit sum of hashed shingles.
    """
    spark = docs.sparkSession
    ship(spark)
    top, bottom = threshold
    keyed = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.col("text").cast("string").alias("text"))
    sketches = saved(keyed.select("_id", "_h", "text").mapInArrow(_sketch(shingle), _SKETCH), "jaccard-sketches")
    nodes = saved(sketches.groupBy("node").agg(F.min(F.struct("_id", "_h")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "jaccard-nodes")
    runs = runs_for(recall, top / bottom, depth)
    leaves, large = _leaves(nodes, runs, depth, leaf)
    # three and a half standard deviations below the agreement expected at the threshold
    s = top / bottom
    agree = math.floor(COORDINATES * s - 3.5 * math.sqrt(COORDINATES * s * (1 - s)))
    near = saved(leaves.join(nodes.select("node", "sketch"), "node").groupBy("path", "part").applyInArrow(_search_bucket(agree), _NEAR), "jaccard-near")
    apart = near.where("apart").select("path", F.col("a").alias("node")).distinct()
    if not apart.isEmpty():
        blocks = _blocks(apart, large, block).withColumn("large", F.lit(False)).join(nodes.select("node", "sketch"), "node")
        near = near.unionByName(blocks.groupBy("path", "i", "j").applyInArrow(_search_bucket(agree), _NEAR))
    near = near.where("a <> b").select("a", "b")
    groups = saved(components(near, "jaccard-candidates"), "jaccard-groups")
    # all pairs of a candidate group are verified in blocks of its sets
    weight = F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum(F.col("size").cast("long")) / F.lit(block_shingles))
    parts = groups.join(nodes.select("node", "size"), "node").groupBy("root").agg(F.ceil(weight).alias("parts"))
    members = groups.join(parts, "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts"))).join(nodes.select("node", F.col("rep._id").alias("_id"), F.col("rep._h").alias("_h")), "node")
    members = saved(members, "jaccard-members")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for i, j in chunks(offsets):
                flat, at = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                blobs = [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(1, 5)], pa.array(blobs, pa.binary())], names=["node", "root", "mine", "parts", "shingles"])

    # the members grow with the corpus: never a broadcast
    with_text = keyed.select("_id", "_h", "text").join(members.hint("merge"), ["_id", "_h"]).dropDuplicates(["_id", "_h"])
    sets = with_text.select("text", "node", "root", "mine", "parts").mapInArrow(shingled, "node long, root long, mine long, parts long, shingles binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    sets = sets.select("*", other)
    sets = sets.select("node", "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "shingles")
    verified = saved(sets.groupBy("root", "i", "j").applyInArrow(_verify_block(top, bottom), _VERIFIED), "jaccard-verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = saved(components(verified.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "jaccard-links"), "jaccard-classes")
    of = nodes.select("node", "rep", "copies").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = of.groupBy("root").agg(F.min("rep").alias("lead"))
    of = of.join(first, "root").select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), "lead")
    rows = sketches.select("_id", "_h", "node").distinct().join(of, "node")
    rows = rows.select(F.col("_id").alias("_i"), F.col("_h").alias("_j"), "copies", "links", "lead")
    ids = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")))
    out = ids.join(rows, (F.col("_id") == F.col("_i")) & (F.col("_h") == F.col("_j")), "left")
    lead = F.coalesce("lead", F.struct("_id", "_h"))
    class_id = F.when(lead["_id"] != F.lit(-(2**63)).cast("long"), lead["_id"])
    return out.select("doc_id", "_id", "_h", class_id.alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"), (lead == F.struct("_id", "_h")).alias("first"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The first document of every class, all columns of ``docs``; repeated rows of it stay once."""
    kept = jaccard_classes(docs, **options).where("first").select("_id", "_h").distinct()
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i, h = row_key(F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}"))
    out = inner.withColumns({"_id": i, "_h": h}).join(kept, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"])
    return out.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
