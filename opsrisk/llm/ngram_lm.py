"""N-gram language model by deleted interpolation.

A text is its words (ASCII letters lower-cased) and one end. The probability of a
word after its predecessor mixes three maximum-likelihood estimates,

    p(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1),

where b is the bucket (binary magnitude) of the context's count c(v). The
weights are learned by expectation-maximisation on held-out counts: over all
learning documents, each token deleted from the counts that predict it (every
count and N less by one).

Counts are exact, over all learning documents, up to collisions of hashes (64 bits for words, 56 for pairs).
Nothing is collected but N, V and a bounded histogram. Documents are cut by id
into blocks of some megabytes. For each block every bucket of hashes receives
the block's distinct n-grams with their counts there, as one row; it adds up
all blocks and answers each with the totals of its own n-grams. A total that is
the block's own count needs no answer. So hot words cost one entry a block, and
words of a single block nothing on the way back. A block then
looks up its tokens once: the counts from which its part of the histogram and
then the scores of its documents are made are stored as one row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import crc_fold
from .shared import row_key, saved, ship
from .textbytes import LOWER, chunks, column_bytes, combine, word_hashes

BLOCK = 4 << 20  # bytes of text
FLUSH = 8 << 20  # bytes of text that a map task folds together
PAIR_BITS = 56  # of a pair's hash
END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A2757A27571235)
_STEPS = 16  # histogram bins for each factor of ten
_FLOOR = 12 * _STEPS
BUCKETS = 40  # of context frequency: binary magnitudes
EM_ROUNDS = 1000  # at most; EM stops when a round adds less than EM_GAIN to the mean log-likelihood of a token
EM_GAIN = 1e-7
SUMS = 64  # groups, beside those of the blocks, that add up the buckets' sums; numbered -1, -2, ...


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token (the words, then END) and each text's offset into them."""
    words, at = word_hashes(LOWER[data], offsets)
    out_at = at + np.arange(len(at))
    out = np.empty(out_at[-1], np.uint64)
    last = out_at[1:] - 1
    mask = np.ones(len(out), dtype=bool)
    mask[last] = False
    out[mask], out[last] = words, END
    return out, out_at


def contexts(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Predecessor of every token; START before a text's first."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[at[:-1]] = START
    return out


def _planes(keys: np.ndarray) -> bytes:
    """Sorted hashes as byte planes of their differences (the high planes are zeros, which shuffles compress away)."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _spread(counts: np.ndarray) -> bytes:
    """Counts as byte planes, for the same reason."""
    return np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unspread(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def pair_hashes(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    return combine([contexts(tokens, at), tokens]) >> np.uint64(64 - PAIR_BITS)


def _block_of(bounds: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Block of each document: its id's range; an id that fills several ranges is spread over them."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    return low + (hashes.view(np.uint64) % (high - low + 1).astype(np.uint64)).astype(np.int64)


def _cuts(keys: np.ndarray, kind: int, n_buckets: int) -> list[int]:
    """Where each bucket's part of sorted hashes starts, and the end."""
    width = 2.0 ** (64 if kind == 1 else PAIR_BITS) / n_buckets
    return [0, *np.searchsorted(keys, (np.arange(1, n_buckets) * width).astype(np.uint64)).tolist(), len(keys)]


_ASKS = "kind int, bucket int, block long, keys binary, counts binary"


def _ask(bounds: np.ndarray, n_buckets: int):
    """For each block and bucket: the distinct n-grams (kind 1: tokens, 2: pairs) and how often learning documents hold them."""

    def flush(parts: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for block, got in parts.items():
            weight = np.concatenate([g[2] for g in got])
            rows = []
            for kind in (1, 2):
                keys = np.concatenate([g[kind - 1] for g in got])
                order = np.argsort(keys)
                keys = keys[order]
                head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                n = np.add.reduceat(weight[order], head, dtype=np.int64)
                keys = keys[head]
                cuts = _cuts(keys, kind, n_buckets)
                for b, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if e > s:
                        rows.append((kind, b, block, _planes(keys[s:e]), n[s:e].astype(np.uint32).tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "bucket", "block", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = defaultdict(list), 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(3))
            ids, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            learns = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            block = _block_of(bounds, ids, hashes)
            for i, j in chunks(offsets):
                tokens, at = token_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                pairs = pair_hashes(tokens, at)
                owner = np.repeat(np.arange(i, j), np.diff(at))
                weight, of = learns[owner].astype(np.uint8), block[owner]
                for b in np.unique(block[i:j]).tolist():
                    use = of == b
                    parts[b].append((tokens[use], pairs[use], weight[use]))
                size += offsets[j] - offsets[i] + j - i
                if size >= FLUSH:
                    yield from flush(parts)
                    parts, size = defaultdict(list), 0
        if parts:
            yield from flush(parts)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Totals of a bucket: one row for each block that tells which of its n-grams there, in order, have a total that is not the
    block's own count (bits), and these totals; a negative block: sums of the bucket."""
    kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
    blocks = table["block"].to_pylist()
    keys = [_unplanes(k) for k in table["keys"].to_pylist()]
    counts = [np.frombuffer(c, np.uint32) for c in table["counts"].to_pylist()]
    sizes = [len(k) for k in keys]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
    own = np.split(np.concatenate(counts), np.cumsum(sizes)[:-1])
    del keys, counts
    out = [(kind, -1 - bucket % SUMS, b"", np.array([total.sum(), (total > 0).sum()], np.int64).tobytes())]
    mine = defaultdict(list)
    for b, n, c in zip(blocks, np.split(where, np.cumsum(sizes)[:-1]), own, strict=True):
        mine[b].append((n, c))
    for b, got in mine.items():
        n, at = np.unique(np.concatenate([n for n, _ in got]), return_inverse=True)
        other = total[n] != np.bincount(at, weights=np.concatenate([c for _, c in got])).astype(np.int64)
        if other.any():
            out.append((kind, b, np.packbits(other).tobytes(), _spread(total[n[other]])))
    cols = list(zip(*out, strict=True))
    buckets = pa.array([bucket] * len(out), pa.int32())
    return pa.table({"kind": pa.array(cols[0], pa.int32()), "bucket": buckets, "block": pa.array(cols[1], pa.int64()), "other": pa.array(cols[2], pa.binary()), "counts": pa.array(cols[3], pa.binary())})


def _totals(keys: np.ndarray, learns: np.ndarray, kind: int, n_buckets: int, answers: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """Total of every n-gram of a block: the answer, or its own count."""
    own, where = np.unique(keys, return_inverse=True)
    total = np.bincount(where, weights=learns, minlength=len(own)).astype(np.int64)
    cuts = _cuts(own, kind, n_buckets)
    for bucket, other, counts in answers:
        part = total[cuts[bucket] : cuts[bucket + 1]]
        part[np.unpackbits(np.frombuffer(other, np.uint8), count=len(part)).astype(bool)] = _unspread(counts)
    return total[where]


def _pack(bounds: np.ndarray):
    """Documents of each block, some megabytes in one compressed row."""

    def flush(parts: dict[int, list[pa.RecordBatch]]) -> pa.RecordBatch:
        blobs = []
        for got in parts.values():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, got[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in got:
                    out.write_batch(batch)
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array(blobs, pa.binary())], names=["block", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = defaultdict(list), 0
        for batch in batches:
            block = _block_of(bounds, batch.column(0).to_numpy(), batch.column(1).to_numpy())
            for b in np.unique(block).tolist():
                part = batch.take(pa.array(np.flatnonzero(block == b)))
                parts[b].append(part)
                size += part.nbytes
            if size >= FLUSH:
                yield flush(parts)
                parts, size = defaultdict(list), 0
        if parts:
            yield flush(parts)

    return run


def _unpack(packed: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in packed["docs"].to_pylist()])


def _with_counts(docs: pa.Table, answers: pa.Table, n_starts: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token offsets, c(v, w), c(v) and c(w) of a block's documents."""
    data, offsets = column_bytes(docs["text"])
    tokens, pairs, ends = [], [], [np.zeros(1, np.int64)]
    for i, j in chunks(offsets):
        part, at = token_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        tokens.append(part)
        pairs.append(pair_hashes(part, at))
        ends.append(at[1:] + ends[-1][-1])
    tokens, pairs, at = np.concatenate(tokens), np.concatenate(pairs), np.concatenate(ends)
    learns = np.repeat(docs["learns"].to_numpy().astype(np.uint8), np.diff(at))
    got: dict[int, list] = {1: [], 2: []}
    for kind, *answer in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "other", "counts")), strict=True):
        got[kind].append(answer)
    c_w = _totals(tokens, learns, 1, n_buckets, got[1])
    c_v = np.empty_like(c_w)
    c_v[1:] = c_w[:-1]
    c_v[at[:-1]] = n_starts
    return at, _totals(pairs, learns, 2, n_buckets, got[2]), c_v, c_w


def magnitude(c: np.ndarray) -> np.ndarray:
    """Bucket of a context count: its number of binary digits."""
    return np.minimum(np.frexp(c.astype(np.float64))[1], BUCKETS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    """Logarithmic bin of a probability; 0: zero."""
    with np.errstate(divide="ignore"):
        x = np.rint(np.log10(p) * _STEPS) + _FLOOR + 1
    return np.where(p > 0, np.clip(x, 1, _FLOOR + 1), 0).astype(np.int64)


def _value(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 10.0 ** ((b - _FLOOR - 1) / _STEPS), 0.0)


def _histogram(c_vw: np.ndarray, c_v: np.ndarray, c_w: np.ndarray, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """How many held-out tokens have their context in a bucket and their deleted estimates in a pair of bins."""
    v = np.maximum(c_v - 1, 0)
    p2 = np.where(v > 0, (c_vw - 1) / np.maximum(v, 1), 0.0)
    p1 = (c_w - 1) / max(n_tokens - 1, 1)
    return np.unique((magnitude(v) * 1000 + _bin(p2)) * 1000 + _bin(p1), return_counts=True)


_COUNTED = "ids binary, hashes binary, learns binary, sizes binary, c_vw binary, c_w binary, tokens long, words long"


def _count(n_starts: int, n_buckets: int):
    """One row for a block: ids, sizes and token counts of its documents.

    A group without documents holds buckets' sums: one row with the tokens and the different words in them.
    """
    types = (*[pa.binary()] * 6, pa.int64(), pa.int64())
    names = [f.split()[0] for f in _COUNTED.split(", ")]

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        if packed.num_rows:
            docs = _unpack(packed)
            at, c_vw, _, c_w = _with_counts(docs, answers, n_starts, n_buckets)
            learns = docs["learns"].to_numpy().astype(np.uint8)
            row = [docs["_id"].to_numpy().tobytes(), docs["_h"].to_numpy().tobytes(), learns.tobytes(), np.diff(at).tobytes()]
            row += [pa.compress(_spread(c), codec="zstd", asbytes=True) for c in (c_vw, c_w)] + [None, None]
        else:
            sums = [np.frombuffer(c, np.int64) for k, c in zip(answers["kind"].to_pylist(), answers["counts"].to_pylist(), strict=True) if k == 1]
            row = [None] * 6 + np.sum([np.zeros(2, np.int64), *sums], axis=0).tolist()
        return pa.table({n: pa.array([x], t) for n, t, x in zip(names, types, row, strict=True)})

    return run


def _stored_counts(sizes: bytes, c_vw: bytes, c_w: bytes, n_starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of a block's documents, and c(v, w), c(v) and c(w) of their tokens."""
    sizes = np.frombuffer(sizes, np.int64)
    n = 8 * int(sizes.sum())
    c_vw, c_w = (_unspread(pa.decompress(c, n, codec="zstd", asbytes=True)) for c in (c_vw, c_w))
    c_v = np.empty_like(c_w)
    c_v[1:] = c_w[:-1]
    c_v[np.cumsum(sizes) - sizes] = n_starts
    return sizes, c_vw, c_v, c_w


def _histograms(n_starts: int, n_tokens: int):
    """Histograms of the blocks' learning documents, added up over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = defaultdict(int)
        for batch in batches:
            for i in range(batch.num_rows):
                learns, *stored = (c[i].as_py() for c in batch.columns)
                sizes, *counts = _stored_counts(*stored, n_starts)
                use = np.repeat(np.frombuffer(learns, np.uint8).astype(bool), sizes)
                for code, n in zip(*(x.tolist() for x in _histogram(*(c[use] for c in counts), n_tokens)), strict=True):
                    total[code] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["code", "n"])

    return run


def learn_weights(histogram: dict[int, int], vocabulary: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (l2, l1, l0) of every bucket by EM; a bucket without held-out tokens takes those of all tokens together.

    Estimates are binned to a sixteenth of a factor of ten, so each is off by at most 7.5 % (those under 10^-12 count as 10^-12).
    """
    code = np.array(sorted(histogram), np.int64)
    n = np.array([histogram[c] for c in code.tolist()], np.float64)
    bucket, p2, p1 = code // 1_000_000, _value(code // 1000 % 1000), _value(code % 1000)
    p0 = np.full(len(code), 1.0 / (vocabulary + 1))
    p = np.stack([p2, p1, p0], axis=1)

    def em(use: np.ndarray) -> np.ndarray:
        weights, before = np.full(3, 1 / 3), -np.inf
        for _ in range(rounds):
            part = p[use] * weights
            whole = part.sum(axis=1)
            likelihood = (np.log(whole) * n[use]).sum() / n[use].sum()
            if likelihood - before < EM_GAIN:
                break
            before = likelihood
            weights = (part / whole[:, None] * n[use][:, None]).sum(axis=0)
            weights /= weights.sum()
        # no estimate is ruled out for good by the held-out fold
        return (weights + 1e-6) / (1 + 3e-6)

    every = em(np.ones(len(code), dtype=bool)) if len(code) else np.full(3, 1 / 3)
    out = np.tile(every, (BUCKETS, 1))
    for b in np.unique(bucket):
        out[b] = em(bucket == b)
    out[0, 1:] += out[0, 0] / 2  # a context never seen has no estimate of its own
    out[0, 0] = 0
    return out


_SCORES = "_id long, _h long, n_tokens long, n_known long, base_score double, score double"


def _score(n_starts: int, n_tokens: int, vocabulary: int, weights: np.ndarray):
    def scored(ids: bytes, hashes: bytes, *stored: bytes) -> pa.RecordBatch:
        sizes, c_vw, c_v, c_w = _stored_counts(*stored, n_starts)
        head = np.cumsum(sizes) - sizes
        l2, l1, l0 = weights[magnitude(c_v)].T
        p = l2 * np.where(c_v > 0, c_vw / np.maximum(c_v, 1), 0.0) + l1 * c_w / max(n_tokens, 1) + l0 / (vocabulary + 1)
        base = np.log10((c_w + 0.5) / (n_tokens + 0.5 * (vocabulary + 1)))
        known = np.add.reduceat((c_w > 0).astype(np.int64), head)
        cols = [np.frombuffer(ids, np.int64), np.frombuffer(hashes, np.int64), sizes, known, np.add.reduceat(base, head), np.add.reduceat(np.log10(p), head)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f.split()[0] for f in _SCORES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield scored(*[c[i].as_py() for c in batch.columns])

    return run


def interpolated_scores(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """Log10 probability of every text.

    The model learns from documents whose crc32 of the id as text, modulo ``folds``, is not ``held_out``; its weights come from
    all of them, too. Returns one row for each row of ``docs``: doc_id, held_out, n_tokens, n_known (tokens that learning documents hold), train_tokens, vocabulary,
    base_score (add-half unigrams), score.

    A null text counts as empty and is its end alone. A null id is in the fold of the empty text. Repeated rows count as often as
    they stand. Without learning documents all counts are 0. An empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    fold = crc_fold(F.col("doc_id"), folds)
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), fold.cast("int").alias("fold"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learns = (F.col("fold") != held_out).alias("learns")
    seen = rows.agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.count_if(learns).alias("starts"))
    seen = seen.first()
    n_blocks = max(1, -(-(seen["bytes"] or 0) // BLOCK))
    n_buckets = max(8, n_blocks)
    bounds = rows.agg(F.percentile_approx("_id", [i / n_blocks for i in range(1, n_blocks)], 10 * n_blocks)).first()[0] if n_blocks > 1 else []
    bounds = np.array(bounds or [], np.int64)
    asks = rows.select("_id", "_h", learns, "text").mapInArrow(_ask(bounds, n_buckets), _ASKS)
    given = asks.groupBy("kind", "bucket").applyInArrow(_answer, "kind int, bucket int, block long, other binary, counts binary").groupBy("block")
    starts = seen["starts"]
    packed = rows.select("_id", "_h", learns, "text").mapInArrow(_pack(bounds), "block long, docs binary")
    counted = saved(packed.groupBy("block").cogroup(given).applyInArrow(_count(starts, n_buckets), _COUNTED), "lm-counts")
    sums = counted.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    n_tokens, vocabulary = sums["tokens"] or 0, sums["words"] or 0
    counted = counted.where("ids is not null")
    held = counted.select("learns", "sizes", "c_vw", "c_w").mapInArrow(_histograms(starts, n_tokens), "code long, n long")
    histogram = {r["code"]: r["n"] for r in held.groupBy("code").agg(F.sum("n").alias("n")).collect()}
    weights = learn_weights(histogram, vocabulary)
    scores = counted.select("ids", "hashes", "sizes", "c_vw", "c_w").mapInArrow(_score(starts, n_tokens, vocabulary, weights), _SCORES)
    id_type = rows.schema["doc_id"].dataType
    doc_id = F.when(F.col("_id") != F.lit(-(2**63)).cast("long"), F.col("_id")).cast(id_type)
    out = crc_fold(doc_id, folds) == held_out
    return scores.select(doc_id.alias("doc_id"), out.alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), F.lit(vocabulary).cast("long").alias("vocabulary"), "base_score", "score")
