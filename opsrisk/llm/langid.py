"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed letter trigrams. Inverse
document frequencies are counted over all learning documents. Each language has
several centroids: spherical k-means over a bounded sample of its labelled
texts. A text gets the language of the centroid of greatest cosine; it is
accepted only if it is no farther from it than nearly all of the language's
sample was (distance-based rejection).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ship
from .textbytes import chunks, column_bytes

DIMS = 4096
CENTROIDS = 4  # for each language
SAMPLE = 2000  # labelled texts of a language, about, from which its centroids are made
MAX_LANGUAGES = 1000  # bound of the model that is broadcast (16 kB a centroid)
REJECT_SHARE = 0.001  # share of the sample that its own language would reject
ROUNDS = 10

# Letters keep their (lower-cased) byte, every other ASCII byte is a gap.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts of every text (texts x DIMS)."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, DIMS), np.float32)
    x = _FOLD[data].astype(np.uint32)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(20)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))[:-2]
    inside = (np.arange(len(code)) + 3 <= offsets[1:][owner]) & (code != 0x202020)
    return np.bincount(owner[inside] * DIMS + slot[inside], minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        for i, j in chunks(offsets):
            total += (counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) > 0).sum(axis=0)
        n += batch.num_rows
    slots = np.append(np.flatnonzero(total), -1)  # -1: the number of texts
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.append(total[slots[:-1]], n))], names=["slot", "n"])


def cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means of unit rows; starts from rows far from each other, in row order. At most k unit centroids."""
    far = x @ x[0]
    picks = [0]
    while len(picks) < min(k, len(x)):
        i = int(far.argmin())
        if far[i] > 1 - 1e-6:
            break  # all rows are like a pick
        picks.append(i)
        far = np.maximum(far, x @ x[i])
    centroids = x[picks].copy()
    for _ in range(rounds):
        of = (x @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (of == c).any():
                centroids[c] = x[of == c].mean(axis=0)
        centroids = unit(centroids)
    return centroids


def _fit(idf: np.ndarray, k: int, rounds: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_k", "ascending")])
        data, offsets = column_bytes(table["text"])
        x = unit(np.concatenate([counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]) * idf)
        x = x[x.any(axis=1)]
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "least": pa.array([], pa.float64()), "centroid": pa.array([], pa.binary())})
        centroids = cluster(x, k, rounds)
        least = float(np.quantile((x @ centroids.T).max(axis=1), REJECT_SHARE))
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(centroids), pa.string()), "least": [least] * len(centroids), "centroid": pa.array([c.astype(np.float32).tobytes() for c in centroids], pa.binary())})

    return run


def learn(labelled: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS, rounds: int = ROUNDS) -> dict:
    """Model from rows (key long, text, lang): languages, centroids, least accepted cosines, idf.

    Rows without a language or text teach nothing. ``sample`` bounds the expected number of texts of a language
    that make its centroids (drawn by a hash of key and text); idf counts all rows. The model is at most MAX_LANGUAGES * k
    centroids, whatever the input.
    """
    ship(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null")
    df = {r["slot"]: r["n"] for r in rows.select("text").mapInArrow(_document_frequency, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    n = df.pop(-1, 0)
    idf = np.full(DIMS, np.log(1 + n), np.float32)
    for slot, c in df.items():
        idf[slot] = np.log((1 + n) / (1 + c)) + 0.01
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the model would not be small")
    if not sizes:
        return {"langs": [], "centroids": np.zeros((0, DIMS), np.float32), "least": np.zeros(0), "idf": idf}
    share = F.element_at(F.create_map(*[F.lit(v) for lang, c in sizes.items() for v in (lang, min(1.0, sample / c))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.withColumn("_k", F.xxhash64("key", "text")).where(draw < share).select("lang", "text", "_k")
    made = drawn.groupBy("lang").applyInArrow(_fit(idf, k, rounds), "lang string, least double, centroid binary").collect()
    made.sort(key=lambda r: (r["lang"], r["centroid"]))
    return {
        "langs": [r["lang"] for r in made],
        "centroids": np.array([np.frombuffer(r["centroid"], np.float32) for r in made]).reshape(-1, DIMS),
        "least": np.array([r["least"] for r in made]),
        "idf": idf,
    }


def identify(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Language of every row's ``text``.

    Returns the columns ``keep``, lang_pred (`und` if the text is null or has no letter, or nothing was learned), score (cosine to
    the nearest centroid, 0 to 1; 0 for `und`), accepted (whether the nearest centroid is near enough). Ties go to the
    language first in code-point order. Rows are independent: repeated rows get equal results.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = np.array(m["langs"], dtype=object)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            known = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool) & bool(len(langs))
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j in chunks(offsets, 1 << 19) if len(langs) else ():
                for a in range(i, j, 512):
                    b = min(j, a + 512)
                    x = unit(counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) * m["idf"]) @ m["centroids"].T
                    best[a:b], score[a:b] = x.argmax(axis=1), x.max(axis=1)
            lang = [langs[c] if ok else "und" for c, ok in zip(best, known, strict=True)]
            accepted = known & (score >= (m["least"][best] if len(langs) else 1))
            score = np.where(known, np.clip(score, 0, 1), 0.0)
            cols = [batch.column(c) for c in names] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "score", "accepted"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    rows = docs.select(*names, F.col("text").cast("string").alias("text"), letters)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, accepted boolean")
