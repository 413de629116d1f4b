"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the tokenizer's pattern into pre-tokens. Inside one pre-token
the next merge is always the adjacent pair of lowest rank, leftmost first. The
queue keeps one bucket of linked-list positions for each rank that occurs and
a two-level bitmap of the ranks that have a bucket: find-first-set on the upper
and then the lower word gives the next rank. A merge changes the pairs at two
positions only; their old entries stay in the buckets and are skipped when met.
So a pre-token of n bytes takes O(n log n) steps, however long it is. Many short
pre-tokens go through one queue together (merge_many), a bucket at a time.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

_GROUP_BITS = 8  # ranks in one lower word of the bitmap: 2^8
CACHE_BYTES = 64 << 20  # a worker forgets its results for pieces of text beyond about this
LEARN_CHARS = 8 << 20  # texts of so many characters are learned together
_ENTRY, _ID = 160, 36  # bytes of a result, and of each of its ids


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one pre-token."""
    whole = ranks.get(word)
    if whole is not None:
        return (whole,)
    n = len(word)
    after = list(range(1, n + 2))  # linked list of token starts; n ends it
    before = list(range(-1, n))
    pair = [-1] * (n + 1)  # rank of the pair that starts here, -1: none or merged away
    buckets: dict[int, list[int]] = {}
    lower: dict[int, int] = {}
    upper = 0
    get = ranks.get
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            pair[i] = r
            if r in buckets:
                buckets[r].append(i)  # ascending, so a heap already
            else:
                buckets[r] = [i]
                g = r >> _GROUP_BITS
                lower[g] = lower.get(g, 0) | 1 << (r & 255)
                upper |= 1 << g
    while upper:
        g = (upper & -upper).bit_length() - 1
        bits = lower[g]
        r = g << _GROUP_BITS | (bits & -bits).bit_length() - 1
        bucket = buckets[r]
        i = heappop(bucket)
        if not bucket:
            del buckets[r]
            bits &= bits - 1
            lower[g] = bits
            if not bits:
                upper &= upper - 1
        if pair[i] != r:
            continue  # stale
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        pair[j] = -1
        touched = (i, before[i]) if i else (i,)
        for s in touched:
            m = after[s]
            new = get(word[s : after[m]]) if m < n else None
            if new is None:
                pair[s] = -1
                continue
            if pair[s] == new:
                continue  # its entry still stands
            pair[s] = new
            if new in buckets:
                heappush(buckets[new], s)
            else:
                buckets[new] = [s]
                q = new >> _GROUP_BITS
                lower[q] = lower.get(q, 0) | 1 << (new & 255)
                upper |= 1 << q
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return tuple(out)


class PairTable:
    """Rank of every pair of tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values(), default=0) + 2
        self.stop = self.width - 1  # id that pairs with none
        keys, values = [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    values.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, np.int32)[order], np.int32(-1))
        self.byte = np.array([ranks.get(bytes([i]), self.stop) for i in range(256)], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1: none."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], np.int32(-1))


def merge_many(words: list[bytes], table: PairTable) -> list[tuple[int, ...]]:
    """Token ids of many pre-tokens through one queue over all their positions.

    A stop stands after every pre-token, so that no pair crosses its end. One step takes a whole bucket, the lowest
    rank of any pre-token; only where a merge makes a pair of still lower rank does a pre-token go on one merge at a time.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    ids = table.byte[raw]
    ids[ends - 1] = table.stop
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    n = len(ids)
    after = np.arange(1, n + 1, dtype=np.int32)
    after[-1] = n - 1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[0] = n - 1  # the last stop: pairs with none
    live = np.ones(n, dtype=bool)
    pair = np.full(n, -1, np.int32)
    for i in range(0, n - 1, 1 << 18):  # a part at a time, as ranks are looked up by 64-bit keys
        j = min(n - 1, i + (1 << 18))
        pair[i:j] = table.rank(ids[i:j], ids[i + 1 : j + 1])
    buckets: dict[int, list[np.ndarray]] = {}
    lower: dict[int, int] = {}
    upper = 0

    def push(ranks: np.ndarray, at: np.ndarray) -> int:
        bits = 0
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        cuts = [0, *cuts.tolist(), len(ranks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            r, x = int(ranks[a]), at[a:b]
            if r in buckets:
                buckets[r].append(x)
            else:
                buckets[r] = [x]
                g = r >> _GROUP_BITS
                lower[g] = lower.get(g, 0) | 1 << (r & 255)
                bits |= 1 << g
        return bits

    known = np.flatnonzero(pair >= 0).astype(np.int32)
    if len(known):
        upper = push(pair[known], known)
    while upper:
        g = (upper & -upper).bit_length() - 1
        bits = lower[g]
        r = g << _GROUP_BITS | (bits & -bits).bit_length() - 1
        lower[g] = bits = bits & (bits - 1)
        if not bits:
            upper &= upper - 1
        found = buckets.pop(r)
        at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        at = at[pair[at] == r]  # the rest is stale
        if not len(at):
            continue
        if len(at) > 1:  # in a chain of overlapping pairs every other one merges
            linked = np.append(False, after[at[:-1]] == at[1:])
            if linked.any():
                head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
        rest = None
        while True:
            j = after[at]
            k = after[j]
            left, right = before[at], ids[k]
            next_merges = np.append(k[:-1] == at[1:], False)
            last_merged = np.append(False, next_merges[:-1])
            made = np.full(len(at), r, np.int32)
            on_left = table.rank(np.where(last_merged, r, ids[left]), made)
            on_right = table.rank(made, np.where(next_merges, r, right))
            low = (on_left >= 0) & (on_left <= r) | (on_right >= 0) & (on_right <= r)
            if next_merges.any():
                between = table.rank(made, right)
                low |= next_merges & (between >= 0) & (between <= r)
            if rest is not None or not low.any():
                break
            w = word_of[at]
            single = np.isin(w, w[low]) & np.append(False, w[1:] == w[:-1])  # all but a word's first
            rest, at = at[single], at[~single]
        after[at] = k
        before[k] = at
        ids[at] = r
        live[j] = False
        pair[j] = -1
        left = before[at]
        pair[at] = on_right
        pair[left] = on_left
        touched, new = np.concatenate((at, left)), np.concatenate((on_right, on_left))
        some = new >= 0
        if some.any():
            upper |= push(new[some], touched[some])
        if rest is not None and len(rest):
            upper |= push(np.full(len(rest), r), rest)
    live[ends - 1] = False
    kept = np.flatnonzero(live)
    flat, cuts = ids[kept].tolist(), [0, *np.searchsorted(kept, ends).tolist()]
    return [tuple(flat[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Tokenizer:
    """Encoder and decoder over one rank file; not thread-safe (one per Python worker)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_bytes: int = CACHE_BYTES):
        self.ranks, self.limit, self.held = ranks, cache_bytes, 0
        self.find = regex.compile(pattern).findall
        self.vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, r in ranks.items():
            self.vocab[r] = token
        self.table = PairTable(ranks)
        self.pieces: dict[str, tuple[int, ...] | None] = {}

    def _cut(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.find(text):
            out += merge(word.encode(), self.ranks)
        return out

    def learn(self, texts: list[str]) -> None:
        """Encode what stands between two spaces in ``texts`` and is not known yet.

        Such a piece is cut alike in every text if it neither starts nor ends with white space (a run of white space is
        cut as a whole); None tells that it does.
        """
        new: set[str] = set()
        for text in texts:
            new.update(text.split(" "))
        if self.held > self.limit:
            self.pieces.clear()
            self.held = 0
        new.difference_update(self.pieces)
        cuts, words = {}, {}
        for piece in new:
            if not piece or piece[0].isspace() or piece[-1].isspace() or len(piece) > 256:
                self.pieces[piece] = None
                self.held += _ENTRY + 2 * len(piece)
                continue
            cuts[piece] = cut = self.find(" " + piece)
            for word in cut:
                words[word] = None
        if not cuts:
            return
        ranks = self.ranks
        hard = []
        for word in words:
            raw = word.encode()
            whole = ranks.get(raw)
            if whole is None:
                hard.append((word, raw))
            else:
                words[word] = (whole,)
        if hard:
            for (word, _), ids in zip(hard, merge_many([raw for _, raw in hard], self.table), strict=True):
                words[word] = ids
        for piece, cut in cuts.items():
            ids = words[cut[0]]
            for word in cut[1:]:
                ids += words[word]
            self.pieces[piece] = ids
            self.held += _ENTRY + 2 * len(piece) + _ID * len(ids)

    def encode(self, text: str) -> list[int]:
        first, *rest = text.split(" ")
        if first and first[-1].isspace() and rest:
            return self._cut(text)
        out = self._cut(first) if first else []
        get, missing = self.pieces.get, self
        for piece in rest:
            ids = get(piece, missing)
            if ids is missing:
                ids = None if not piece or piece[0].isspace() or piece[-1].isspace() else self._cut(" " + piece)
            if ids is None:
                if not piece or piece[0].isspace() or piece[-1].isspace():
                    return self._cut(text)
                ids = self._cut(" " + piece)
            out += ids
        return out

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of every text; the pieces of a few megabytes of text are learned together."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < LEARN_CHARS):
                size += len(texts[j])
                j += 1
            self.learn(texts[i:j])
            for text in texts[i:j]:
                yield self.encode(text)
            i = j

    def decode(self, ids) -> bytes:
        vocab = self.vocab
        return b"".join([vocab[i] for i in ids])


_TOKENIZERS: dict[tuple[str, str], Tokenizer] = {}  # in a Python worker: parsed once, its cache serves later tasks


def _tokenizer(data: bytes, pattern: str) -> Tokenizer:
    key = hashlib.sha256(data).hexdigest(), pattern
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer(load_ranks(data), pattern)
    return _TOKENIZERS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encode every text and decode it again.

    Returns one row for each row of ``docs``: doc_id, ids (array of int; left out unless ``keep_ids``), n_tokens, ids_sha256
    (ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded bytes). A null text counts as empty: no
    tokens, the digests of no bytes. Repeated rows and null ids pass through. Only doc_id and text are read.

    ``ranks_path`` is read on the driver; the file (under a megabyte for the public vocabularies) is broadcast.
    """
    with open(ranks_path, "rb") as f:
        data = f.read()
    spark = docs.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(data)

    def encoded(tok: Tokenizer, batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"n": [], "i": [], "d": []}
        flat, ends = array("i"), array("i", [0])
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for ids in tok.encode_all(texts):
            packed = array("I", ids)
            out["n"].append(len(ids))
            out["i"].append(hashlib.sha256(packed.tobytes()).hexdigest())
            out["d"].append(hashlib.sha256(tok.decode(ids)).hexdigest())
            if keep_ids:
                flat.extend(ids)
                ends.append(len(flat))
        cols = {"doc_id": batch.column(0)}
        if keep_ids:
            cols["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        cols |= {"n_tokens": pa.array(out["n"], pa.int64()), "ids_sha256": pa.array(out["i"], pa.string()), "decoded_sha256": pa.array(out["d"], pa.string())}
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(vocabulary.value, pattern)
        for batch in batches:
            gc.disable()  # millions of live tuples and no cycles: collections would take a third of the time
            try:
                made = encoded(tok, batch)
            finally:
                gc.enable()
            yield made

    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return kept.mapInArrow(run, schema)
