"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of all words by its weight, at most ``max_copies``
times its own words; the excess is shared again by weight. A document of a
source with target/size ratio f is to be taken f times: floor(f) whole copies
and one more with probability p = f - floor(f). The fractions are rounded
in pairs: a document and all smaller ones of its group exchange words until one has probability 0
or 1, in a random direction chosen so that every expectation stays. A group's words
(probability times size) stay constant. Groups of a few thousand documents are rounded
first, then their residuals (one document each), level by level up to one
residual for each source: a reduction tree in which no task sees a whole source. A source's total misses its target by
less than the last residual. This is a group's smallest document, unless one document outweighs all smaller
ones of its group together.

Draws are hashes of the document and the level, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import row_key, saved, ship, word_count

GROUP = 4096  # documents that one step of the tree rounds together
HEAVY = 0.001  # share of its source's target beyond which a document that fits in one way only goes that way


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_copies: float) -> DataFrame:
    """One row for each source: source, source_size, target.

    ``sizes`` has source and words. Sources are ordered by code point, null last, and weigh
    ``weights`` in turn. Targets are the least water level over the capped weights: a source stops at
    ``max_copies`` times its size, and the others share the rest by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.select("source", "source_size", F.get(w, turn % len(weights)).alias("w"))
    cap = F.col("source_size") * F.lit(float(max_copies))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    per = (
        per.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("level", level)
        .withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
        .withColumn("water", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    )
    target = F.when(F.col("free"), F.col("water") * F.col("w")).otherwise(F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def _uniform(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Uniform draws in [0, 1) from two hash columns."""
    from .textbytes import mix

    x = mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(salt * 7919 + 17))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def round_group(p: np.ndarray, size: np.ndarray, draw: np.ndarray, heavy: float = math.inf) -> tuple[np.ndarray, int]:
    """Pivotal rounding of one group: probabilities that are 0 or 1 but for at most one, whose index is returned (-1: none).

    Documents come in the order given, the largest first. Each is paired with all that follow it, as one: words go from one
    to the other, in a random direction, until the document or one of the others has probability 0 or 1. The others share
    words by size times the smaller of p and 1 - p, in both directions alike, so every expectation stays, and the sum of
    probability times size stays in every step. If a document has more than ``heavy`` words and the others can make up for one
    of its ends only, this is its end (here alone the expectation gives way to the target). A large document so settles against very many small ones; the one left open
    at the end is the smallest, unless a document outweighs all that follow it.
    """
    out, eps = p.copy(), 1e-9
    ends = (out <= eps) | (out >= 1 - eps)
    out[ends] = np.round(out[ends])
    live = np.flatnonzero(~ends)
    at = 0
    while at < len(live) - 1:
        i, rest = live[at], live[at + 1 :]
        w = size[rest] * np.minimum(out[rest], 1 - out[rest])
        share = w / w.sum() / size[rest]  # change of a probability for each word that the others get together
        room = (1 - out[rest]) / share
        stock = out[rest] / share
        to_i = min((1 - out[i]) * size[i], stock.min())
        from_i = min(out[i] * size[i], room.min())
        up = (1 - out[i]) * size[i] <= (out[rest] * size[rest]).sum() + eps
        down = out[i] * size[i] <= ((1 - out[rest]) * size[rest]).sum() + eps
        toss = draw[i] * (to_i + from_i) < from_i
        moved = to_i if (toss if up == down or size[i] <= heavy else up) else -from_i
        out[i] += moved / size[i]
        out[rest] -= moved * share
        ends = (out[live[at:]] <= eps) | (out[live[at:]] >= 1 - eps)
        settled = live[at:][ends]
        out[settled] = np.round(out[settled])
        draw = _next(draw) if not ends[0] else draw  # the same document draws again
        live, at = live[at:][~ends], 0
    return out, int(live[0]) if len(live) else -1


def _next(draw: np.ndarray) -> np.ndarray:
    return (draw * 7919.0 + 0.618033988749895) % 1.0


_TREE = "source string, _id long, _h long, words long, p double, heavy double, open boolean"


def _round_level(level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_numpy() for c in ("_id", "_h", "words", "p", "heavy")}
        draw = _uniform(cols["_id"], cols["_h"], level)
        # the largest first: each settles against all smaller ones, so that what stays open at the end is small
        order = np.lexsort((cols["_h"], cols["_id"], draw, -cols["words"]))
        p, left = round_group(cols["p"][order], cols["words"][order].astype(float), _uniform(cols["_h"], cols["_id"], level + 1000)[order], cols["heavy"][0])
        still = np.zeros(len(p), dtype=bool)
        if left >= 0:
            if last:
                p[left] = float(draw[order][left] < p[left])
            else:
                still[left] = True
        return pa.table(
            {
                "source": table["source"].take(pa.array(order)),
                "_id": cols["_id"][order],
                "_h": cols["_h"][order],
                "words": cols["words"][order],
                "p": p,
                "heavy": cols["heavy"],
                "open": still,
            }
        )

    return run


def mix_copies(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_copies: float = 3.0,
    group: int = GROUP,
) -> DataFrame:
    """How often the mix takes every document.

    Returns one row for each different document row (same doc_id and text): doc_id, _id, _h, source, rows (how often
    the row stands in the table), size (words), source_size, target, copies (of each such row).

    A null text has no words; a document without words is taken 0 times. Repeated rows are rounded as one document
    and so get equal copies. Rows that differ in text or source only are documents of their own. An empty table gives
    no rows. Other columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)
    base = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    base = saved(
        base.groupBy("_id", "_h", "source").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count(F.lit(1)).alias("rows")),
        "mix-sizes",
    )
    base = base.withColumn("words", F.col("size") * F.col("rows"))
    targets = saved(source_targets(base, weights, max_copies), "mix-targets").withColumnRenamed("source", "_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = base.join(targets, base["source"].eqNullSafe(targets["_s"])).drop("_s").withColumn("ratio", ratio)
    tree = rows.where("words > 0").select("source", "_id", "_h", "words", (F.col("ratio") - F.floor("ratio")).alias("p"), (F.col("target") * F.lit(HEAVY)).alias("heavy"), F.lit(True).alias("open"))
    n = base.count()
    levels, done = max(1, math.ceil(math.log(max(n, 2), group))), []
    for level in range(levels):
        # ever fewer groups, so that residuals of several groups meet; the last level has one group for each source
        groups = math.ceil(n / group ** (level + 1)) if level < levels - 1 else 1
        cut = F.pmod(F.xxhash64("_id", "_h", F.lit(level)), F.lit(groups))
        out = saved(tree.groupBy("source", cut.alias("cut")).applyInArrow(_round_level(level, level == levels - 1), _TREE), f"mix-{level}")
        done.append(out.where("not open"))
        tree = out.where("open")
    bits = done[0]
    for d in done[1:]:
        bits = bits.unionByName(d)
    bits = bits.select(F.col("source").alias("_s"), F.col("_id").alias("_i"), F.col("_h").alias("_j"), F.col("p").cast("long").alias("bit"))
    joined = rows.join(bits, (rows["_id"] == bits["_i"]) & (rows["_h"] == bits["_j"]) & rows["source"].eqNullSafe(bits["_s"]), "left")
    copies = F.when(F.col("words") > 0, F.floor("ratio") + F.coalesce("bit", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return joined.select("doc_id", "_id", "_h", "source", "rows", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns kept, as often as the mix takes it."""
    how = mix_copies(docs, **options).where("copies > 0").select("_id", "_h", F.col("source").alias("_s"), F.col("copies").alias("_n"))
    names = docs.columns
    # positional names inside, so that a column of docs may have any name
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    col = lambda c: F.col(f"c{names.index(c)}")
    i, h = row_key(col("doc_id"), col("text"))
    inner = inner.withColumns({"_k": i, "_g": h})
    out = inner.join(how, (F.col("_k") == F.col("_id")) & (F.col("_g") == F.col("_h")) & col("source").cast("string").eqNullSafe(F.col("_s")))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
