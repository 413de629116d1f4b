"""Dedup of repeated byte strings by a depth-limited radix sort of suffixes.

A byte is removed if a string of ``length`` bytes that covers it also starts
earlier (in a document of smaller key, or earlier in the same one). Suffixes
need ordering through their first ``length`` bytes only; suffixes equal so far
are the repeated strings. The sort goes from coarse to fine digits:

1. The first digit of a string is its anchor: of its 20-byte grams the one of
   least hash, at the offset where it stands. Equal strings have equal anchors,
   and one anchor serves some forty neighbouring strings. Anchors are dealt out
   by their gram. An occurrence whose whole surroundings (all strings that hold
   it) also stand earlier needs no more: all of it is removed. What is left are
   first occurrences of different surroundings of one gram.
2. These are dealt out by gram and the 40 bytes after it (strings that reach
   there) or before it, and by the anchor's offset. A gram that has very many
   surroundings is known as hot to all its occurrences after step 1; each of its
   strings is dealt out by a hash of all its bytes instead, equal ones
   folded on the map side to the first, so that no task gathers them.
3. Inside a task, passes over 8-byte digits of the actual bytes, most
   significant first, drop what is alone after each pass. Groups that are left
   after ``length`` bytes are exactly the repeated strings.

Steps 1 and 2 group by 64-bit hashes of the bytes; step 3 compares the bytes (strings of hot grams: their hashes).
Blocks of many anchors travel as one row, after the map side has folded equal
surroundings, so a passage that stands in a third of all documents adds one
entry for each block of text. A gram with many different surroundings in one
block is dealt out by its surroundings, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import row_key, saved, ship
from .textbytes import chunks, column_bytes, mix, powers, prefix_hash, range_hash

LENGTH = 100  # bytes
GRAM = 20
FLUSH = 24 << 20  # bytes of text that the map side folds together
BUCKET = 24 << 20  # bytes of text for each bucket of a shuffle
HOT = 256  # surroundings of one gram in a flush from which it is dealt out by them, too
HOT_ALL = 1024  # surroundings of one gram in its bucket from which its strings are dealt out one by one
_POS = np.uint64((1 << 30) - 1)
_BIG = np.uint64(2**64 - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Anchors of all strings of ``length`` bytes inside the texts.

    Arrays: doc, pos (in its text), gram (hash), around (hash of the surroundings), lo and hi (bytes of surroundings before
    and from the anchor on), o1..o2 (offsets in the strings that it anchors).
    """
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return {k: none for k in ("doc", "pos", "gram", "around", "lo", "hi", "o1", "o2")}
    prefix = prefix_hash(data)
    up, _ = powers(n + 1)
    gram = mix((prefix[GRAM:] - prefix[:-GRAM]) * up[: n - GRAM + 1])
    value = (gram & ~_POS) | np.arange(n - GRAM + 1, dtype=np.uint64)
    width, least = 1, value  # least over `width` grams, by doubling
    want = length - GRAM + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: n - length + 1], least[want - width :][: n - length + 1])
    delta = np.zeros(n + 1, np.int32)  # strings that would cross a text's end
    np.add.at(delta, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(delta, offsets[1:], -1)
    inside = np.flatnonzero(np.cumsum(delta)[: n - length + 1] == 0)
    if not len(inside):
        return {k: none for k in ("doc", "pos", "gram", "around", "lo", "hi", "o1", "o2")}
    at = (least[inside] & _POS).astype(np.int64)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    a = at[new]
    first, last = inside[new], inside[np.append(new[1:], len(at)) - 1]
    doc = np.searchsorted(offsets, a, "right") - 1
    start, end = np.maximum(offsets[doc], a - (length - GRAM)), np.minimum(offsets[doc + 1], a + length)
    around = mix(range_hash(prefix, start, end) + (a - start).astype(np.uint64))
    return {"doc": doc, "pos": a - offsets[doc], "gram": gram[a], "around": around, "lo": a - start, "hi": end - a, "o1": a - last, "o2": a - first}


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals for each document number: doc, start, end, sorted."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    shift = doc.astype(np.int64) << 32  # one axis for all documents
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, (start + shift)[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1] - shift[at]


def _is_first(order: np.ndarray, keys: list[np.ndarray], rank: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by ``order`` (keys, then rank and pos): masks in row order of the group's first occurrence (repeats of
    the very same occurrence are none of the two) and of later ones."""
    head = np.zeros(len(order), dtype=bool)
    head[:1] = True
    for k in keys:
        head[1:] |= k[order][1:] != k[order][:-1]
    top = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later_sorted = (rank[order] != rank[top]) | (pos[order] != pos[top])
    first, later = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    first[order[head]] = True
    later[order] = later_sorted
    return first, later


def _rank(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Order of documents by key; equal keys rank alike."""
    order = np.lexsort((hashes, ids))
    step = np.append(False, (ids[order][1:] != ids[order][:-1]) | (hashes[order][1:] != hashes[order][:-1]))
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(step)
    return out


_BLOCK = "bucket long, gram binary, around binary, doc binary, pos binary, extent binary, ids binary, hashes binary"
_SPANS = "_id long, _h long, kind int, spans binary"


def _block(bucket: int, pick: np.ndarray, x: dict[str, np.ndarray], ids: np.ndarray, hashes: np.ndarray) -> tuple:
    docs, doc = np.unique(x["doc"][pick], return_inverse=True)
    extent = np.stack([x[k][pick].astype(np.uint8) for k in ("lo", "hi", "o1", "o2")])
    return (
        bucket,
        x["gram"][pick].tobytes(),
        x["around"][pick].tobytes(),
        doc.astype(np.uint32).tobytes(),
        x["pos"][pick].astype(np.uint32).tobytes(),
        extent.tobytes(),
        ids[docs].tobytes(),
        hashes[docs].tobytes(),
    )


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _deal_anchors(n_buckets: int, length: int):
    def flush(parts: list[dict], keys: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, hashes = (np.concatenate(k) for k in zip(*keys, strict=True))
        x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        if not len(x["doc"]):
            return
        rank = _rank(ids, hashes)[x["doc"]]
        order = np.lexsort((x["pos"], rank, x["around"], x["gram"]))
        first, later = _is_first(order, [x["gram"], x["around"]], rank, x["pos"])
        rows = []
        doc, start, end = merged(x["doc"][later], (x["pos"] - x["lo"])[later], (x["pos"] + x["hi"])[later])
        if len(doc):  # removed already: goes along to the other side
            spread = int(hashes[0]) % n_buckets
            z = np.zeros(len(doc), np.uint64)
            fold = {"doc": doc, "pos": start, "gram": z, "around": end.astype(np.uint64), "lo": z, "hi": z, "o1": z, "o2": z}
            rows.append(_block(n_buckets + spread, np.arange(len(doc)), fold, ids, hashes))
        kept = order[first[order]]  # sorted by gram
        gram = x["gram"][kept]
        head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.diff(np.append(head, len(gram)))
        hot = np.repeat(size > HOT, size)
        bucket = (mix(gram) % np.uint64(n_buckets)).astype(np.int64)
        # a hot gram leaves two of its surroundings in its own bucket, so that others there know of them
        mark = np.concatenate([head[size > HOT], head[size > HOT] + 1])
        spread = (mix(gram ^ x["around"][kept]) % np.uint64(n_buckets)).astype(np.int64)
        every = np.concatenate([kept, kept[mark]])
        to = np.concatenate([np.where(hot, spread, bucket), bucket[mark]])
        flag = np.zeros(len(x["doc"]), dtype=bool)
        flag[kept[hot]] = True
        x["o1"] = x["o1"] + 128 * flag  # top bit: certainly not the gram's only surroundings
        by = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
            rows.append(_block(int(to[by[a]]), np.sort(every[by[a:b]]), x, ids, hashes))
        yield _rows(rows, _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys, size, docs = [], [], 0, 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for i, j in chunks(offsets):
                x = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                x["doc"] = x["doc"] + docs
                parts.append(x)
                keys.append((ids[i:j], hashes[i:j]))
                docs += j - i
                size += offsets[j] - offsets[i]
                if size >= FLUSH:
                    yield from flush(parts, keys)
                    parts, keys, size, docs = [], [], 0, 0
        if parts:
            yield from flush(parts, keys)

    return run


def _unpack(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """All entries of a bucket's blocks; doc counts through the blocks' documents."""
    read = lambda c, t: [np.frombuffer(b, t) for b in table[c].to_pylist()]
    ids, hashes = read("ids", np.int64), read("hashes", np.int64)
    before = np.cumsum([0, *map(len, ids)])[:-1]
    x = {
        "gram": np.concatenate(read("gram", np.uint64)),
        "around": np.concatenate(read("around", np.uint64)),
        "doc": np.concatenate([d + np.int64(b) for d, b in zip(read("doc", np.uint32), before, strict=True)]).astype(np.int64),
        "pos": np.concatenate(read("pos", np.uint32)).astype(np.int64),
    }
    extent = np.concatenate([e.reshape(4, -1) for e in read("extent", np.uint8)], axis=1).astype(np.int64)
    x |= {k: extent[i] for i, k in enumerate(("lo", "hi", "o1", "o2"))}
    return x, np.concatenate(ids), np.concatenate(hashes)


def _by_document(doc: np.ndarray, values: np.ndarray, kind: int, ids: np.ndarray, hashes: np.ndarray) -> list[tuple]:
    """Rows of _SPANS: the value rows (sorted by doc) of each document."""
    if not len(doc):
        return []
    cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)).tolist()
    values = values.astype(np.uint32)
    return [(int(ids[doc[a]]), int(hashes[doc[a]]), kind, values[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]


def _first_pass(n_buckets: int):
    """kind 0: removed spans (start, end); kind 1: anchors to sort further (pos, o1, o2; 2 ** 16 is added to o1 of a hot gram).

    All occurrences of a gram agree on whether it is hot: if a flush has dealt it out by its surroundings, its own bucket knows by the marks.
    """

    def run(table: pa.Table) -> pa.Table:
        x, ids, hashes = _unpack(table)
        if table["bucket"][0].as_py() >= n_buckets:
            values = np.stack([x["pos"], x["around"].astype(np.int64)], axis=1)
            return pa.Table.from_batches([_rows(_by_document(x["doc"], values, 0, ids, hashes), _SPANS)])
        many, x["o1"] = x["o1"] >= 128, x["o1"] & 127
        rank = _rank(ids, hashes)
        by_rank = np.argsort(rank, kind="stable")  # a document of two blocks is one
        ids, hashes = ids[by_rank], hashes[by_rank]
        home = np.empty(len(rank), np.int64)
        home[by_rank] = np.arange(len(rank))
        lead = np.searchsorted(rank[by_rank], rank[by_rank])
        x["doc"] = lead[home[x["doc"]]]
        rank = x["doc"]
        order = np.lexsort((x["pos"], rank, x["around"], x["gram"]))
        first, later = _is_first(order, [x["gram"], x["around"]], rank, x["pos"])
        doc, start, end = merged(x["doc"][later], (x["pos"] - x["lo"])[later], (x["pos"] + x["hi"])[later])
        rows = _by_document(doc, np.stack([start, end], axis=1), 0, ids, hashes)
        kept = order[first[order]]
        gram = x["gram"][kept]
        alike = gram[1:] == gram[:-1]
        more = many[kept] | np.append(False, alike) | np.append(alike, False)
        part = np.cumsum(np.append(True, ~alike)[: len(kept)]) - 1
        hot = ((np.bincount(part, many[kept]) > 0) | (np.bincount(part) > HOT_ALL))[part] if len(kept) else part
        x["o1"][kept] += hot.astype(np.int64) << 16
        kept = kept[more]
        kept = kept[np.lexsort((x["pos"][kept], x["doc"][kept]))]
        rows += _by_document(x["doc"][kept], np.stack([x["pos"][kept], x["o1"][kept], x["o2"][kept]], axis=1), 1, ids, hashes)
        return pa.Table.from_batches([_rows(rows, _SPANS)])

    return run


_ENTRIES = "bucket long, entry_key binary, bytes binary, doc binary, pos binary, extent binary, ids binary, hashes binary"


def _deal_entries(n_buckets: int, length: int):
    """Second digit: entries of the strings that reach 40 bytes past the gram, or 40 bytes before it.

    Buckets from n_buckets on: strings of hot grams (key: hash of the string, pos: its start); from 2 * n_buckets on: spans removed
    already (key: end, pos: start).
    """
    left = length - GRAM
    half = left // 2
    size = length + half  # bytes of an entry

    def deal_hot(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> list[tuple]:
        rank = _rank(ids, hashes)[doc]
        order = np.lexsort((pos, rank, key))
        first, later = _is_first(order, [key], rank, pos)
        d, start, end = merged(doc[later], pos[later], pos[later] + length)
        spread = 2 * n_buckets + int(hashes[0]) % n_buckets
        key, doc, pos = np.concatenate([key[first], end.astype(np.uint64)]), np.concatenate([doc[first], d]), np.concatenate([pos[first], start])
        to = np.concatenate([n_buckets + (key[: first.sum()] % np.uint64(n_buckets)).astype(np.int64), np.full(len(d), spread, np.int64)])
        by = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1])) if len(by) else by
        rows = []
        for s, e in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
            pick = by[s:e]
            docs, place = np.unique(doc[pick], return_inverse=True)
            rows.append((int(to[pick[0]]), key[pick].tobytes(), b"", place.astype(np.uint32).tobytes(), pos[pick].astype(np.uint32).tobytes(), b"", ids[docs].tobytes(), hashes[docs].tobytes()))
        return rows

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        ids, hashes = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        key, body, doc, pos, extent = [], [], [], [], []
        hot_key, hot_doc, hot_pos = [], [], []
        for d, (_, _, text, a, o1, o2) in enumerate(parts):
            padded = np.zeros(len(text) + left + length, np.uint8)
            padded[left : left + len(text)] = text
            prefix = prefix_hash(padded)
            c = a + left  # the anchor's place in the padded text
            lo, hi = np.minimum(a, left), np.minimum(len(text) - a, length)
            hot, o1 = o1 >> 16 > 0, o1 & 0xFFFF
            if hot.any():
                first, last = np.maximum(o1[hot], length - hi[hot]), np.minimum(o2[hot], lo[hot])
                n = np.maximum(last - first + 1, 0)
                offset = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(a[hot], n) - offset
                hot_key.append(mix(range_hash(prefix, start + left, start + left + length) + offset.astype(np.uint64)))
                hot_doc.append(np.full(len(start), d, np.int64))
                hot_pos.append(start)
                a, o1, o2, c, lo, hi = (y[~hot] for y in (a, o1, o2, c, lo, hi))
            for side in (0, 1):
                # side 0: offsets up to half, the string holds [a, a + GRAM + half); side 1: larger ones, it holds [a - half, a + GRAM)
                u1, u2 = (o1, np.minimum(o2, half)) if side == 0 else (np.maximum(o1, half + 1), o2)
                use = u1 <= u2
                if not use.any():
                    continue
                p = c[use]
                k = range_hash(prefix, p, p + GRAM + half) if side == 0 else range_hash(prefix, p - half, p + GRAM)
                base = p - (half if side == 0 else left)
                key.append(mix(k + np.uint64(side)))
                body.append(padded[base[:, None] + np.arange(size)])
                doc.append(np.full(len(p), d, np.uint32))
                pos.append(a[use].astype(np.uint32))
                extent.append(np.stack([lo[use], hi[use], u1[use], u2[use]]).astype(np.uint8))
        rows = deal_hot(np.concatenate(hot_key), np.concatenate(hot_doc), np.concatenate(hot_pos), ids, hashes) if hot_key else []
        if not key:
            return _rows(rows, _ENTRIES)
        key, body, doc, pos, extent = np.concatenate(key), np.concatenate(body), np.concatenate(doc), np.concatenate(pos), np.concatenate(extent, axis=1)
        to = (key % np.uint64(n_buckets)).astype(np.int64)
        by = np.lexsort((key, to))
        cuts = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1]))
        for s, e in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
            pick = by[s:e]
            docs, d = np.unique(doc[pick], return_inverse=True)
            rows.append((int(to[pick[0]]), key[pick].tobytes(), body[pick].tobytes(), d.astype(np.uint32).tobytes(), pos[pick].tobytes(), np.ascontiguousarray(extent[:, pick]).tobytes(), ids[docs].tobytes(), hashes[docs].tobytes()))
        return _rows(rows, _ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            ids, hashes, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                x = np.concatenate([np.frombuffer(b, np.uint32).reshape(-1, 3) for b in found[i]]).astype(np.int64)
                parts.append((ids[i], hashes[i], data[offsets[i] : offsets[i + 1]].copy(), x[:, 0], x[:, 1], x[:, 2]))
                hot = x[:, 1] >> 16 > 0
                size += len(x) + int((x[hot, 2] - (x[hot, 1] & 0xFFFF)).sum()) // 8
                if size >= 100_000:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


def repeated_strings(words: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over strings of ``length`` bytes that start at ``at`` in ``words``.

    Returns the indices of strings that have an equal one in their initial group, and their final groups.
    """
    digits = np.ndarray((len(words) - 7,), "<u8", words, strides=(1,))
    index = np.arange(len(at))
    for step in [*range(0, length - 8, 8), length - 8]:
        digit = digits[at[index] + step]
        order = np.lexsort((digit, group))
        index, group, digit = index[order], group[order], digit[order]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))[: len(index)]
        group = np.cumsum(new)
        alone = new & np.append(new[1:], True)[: len(index)]
        index, group = index[~alone], group[~alone]
        if not len(index):
            break
    return index, group


def _last_passes(n_buckets: int, length: int):
    left = length - GRAM
    half = left // 2
    size = length + half

    def run(table: pa.Table) -> pa.Table:
        read = lambda c, t: [np.frombuffer(b, t) for b in table[c].to_pylist()]
        ids, hashes = read("ids", np.int64), read("hashes", np.int64)
        before = np.cumsum([0, *map(len, ids)])[:-1]
        doc = np.concatenate([d.astype(np.int64) + b for d, b in zip(read("doc", np.uint32), before, strict=True)])
        ids, hashes = np.concatenate(ids), np.concatenate(hashes)
        rank = _rank(ids, hashes)[doc]
        home = np.zeros(int(rank.max()) + 1, np.int64)
        home[rank] = doc  # one of a document's places
        key, body, pos = np.concatenate(read("entry_key", np.uint64)), np.concatenate(read("bytes", np.uint8)), np.concatenate(read("pos", np.uint32)).astype(np.int64)
        bucket = table["bucket"][0].as_py()
        if bucket >= n_buckets:
            if bucket < 2 * n_buckets:  # a later string of equal bytes
                _, later = _is_first(np.lexsort((pos, rank, key)), [key], rank, pos)
                rank, start, end = rank[later], pos[later], pos[later] + length
            else:
                start, end = pos, key.astype(np.int64)
            d, start, end = merged(rank, start, end)
            return pa.Table.from_batches([_rows(_by_document(home[d], np.stack([start, end], axis=1), 0, ids, hashes), _SPANS)])
        lo, hi, o1, o2 = np.concatenate([e.reshape(4, -1) for e in read("extent", np.uint8)], axis=1).astype(np.int64)
        order = np.argsort(key, kind="stable")
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(np.append(True, key[order][1:] != key[order][:-1]))
        some = np.bincount(group)[group] > 1
        starts, ranks = [], []
        for o in range(left + 1):  # equal strings have their anchor at equal offsets
            use = np.flatnonzero(some & (o1 <= o) & (o <= o2) & (lo >= o) & (hi >= length - o))
            if len(use) < 2:
                continue
            base = half if o <= half else left
            index, equal = repeated_strings(body, use * size + base - o, group[use], length)
            use = use[index]
            at, r = pos[use] - o, rank[use]
            order = np.lexsort((at, r, equal))
            _, later = _is_first(order, [equal], r, at)
            starts.append(at[later])
            ranks.append(r[later])
        if not starts:
            return pa.Table.from_batches([_rows([], _SPANS)])
        at = np.concatenate(starts)
        d, start, end = merged(np.concatenate(ranks), at, at + length)
        return pa.Table.from_batches([_rows(_by_document(home[d], np.stack([start, end], axis=1), 0, ids, hashes), _SPANS)])

    return run


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans to remove: _id, _h, blobs (arrays of packed uint32 pairs start, end in bytes; they may overlap), for each
    document key that has any. ``docs`` has _id, _h, text."""
    if not 2 * GRAM <= length < GRAM + 128:  # offsets in a string must fit seven bits beside a flag
        raise ValueError(f"length must be from {2 * GRAM} to {GRAM + 127} bytes, not {length}")
    spark = docs.sparkSession
    ship(spark)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, -(-n_bytes // BUCKET))
    blocks = docs.select("_id", "_h", "text").mapInArrow(_deal_anchors(n_buckets, length), _BLOCK)
    # one bucket, one task: a bucket is sized to fill it
    blocks = blocks.repartition(2 * n_buckets, "bucket")
    first = saved(blocks.groupBy("bucket").applyInArrow(_first_pass(n_buckets), _SPANS), "suffix-first")
    open_ = first.where("kind = 1").groupBy("_id", "_h").agg(F.collect_list("spans").alias("spans"))
    entries = docs.select("_id", "_h", "text").join(open_, ["_id", "_h"]).select("_id", "_h", "text", "spans").mapInArrow(_deal_entries(n_buckets, length), _ENTRIES)
    last = saved(entries.groupBy("bucket").applyInArrow(_last_passes(n_buckets, length), _SPANS), "suffix-last")
    spans = first.where("kind = 0").unionByName(last)
    return spans.groupBy("_id", "_h").agg(F.collect_list("spans").alias("blobs"))


def _runs(blobs: list[bytes] | None) -> list[tuple[int, int]]:
    if not blobs:
        return []
    x = np.concatenate([np.frombuffer(b, np.uint32).reshape(-1, 2) for b in blobs]).astype(np.int64)
    _, start, end = merged(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])
    return list(zip(start.tolist(), end.tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """What is left of every text.

    Returns one row for each row of ``docs``: doc_id, _id, _h, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of
    the bytes left) and, with ``keep_text``, span_starts and span_ends (the runs, in bytes) and text (the bytes left; a character
    cut apart by a run's border is dropped). Columns named in ``carry`` go along in a struct ``carried`` (fields c0, c1, ...).

    A null text counts as empty. Texts under ``length`` bytes keep everything. Documents are ordered by id, a null id first, and at
    equal ids by a hash of the text; rows equal in both are one document, so a repeated row is no earlier copy of
    itself. An empty table gives no rows. Other columns are not read. ``length`` may be 40 to 147 bytes.
    """
    carried = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried")
    keyed = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), carried)
    spans = removed_spans(keyed, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(3))
            raw = data.tobytes()
            n_bytes = np.diff(offsets)
            removed, count, digest, texts, starts, ends = [], [], [], [], [], []
            for i, blobs in enumerate(batch.column(4).to_pylist()):
                runs, text = _runs(blobs), raw[offsets[i] : offsets[i + 1]]
                if runs:
                    edges = [0, *[e for r in runs for e in r], len(text)]
                    left = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                else:
                    left = text
                removed.append(len(text) - len(left))
                count.append(len(runs))
                digest.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    texts.append(left.decode("utf-8", "ignore"))
                    starts.append([a for a, _ in runs])
                    ends.append([b for _, b in runs])
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "_id", "_h", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols += [pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(texts, pa.string())]
                names += ["span_starts", "span_ends", "text"]
            cols.append(batch.column(5))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "carried"])

    id_type = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, _id long, _h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", span_starts array<long>, span_ends array<long>, text string" * keep_text
    schema += f", carried {keyed.schema['carried'].dataType.simpleString()}"
    out = keyed.join(spans, ["_id", "_h"], "left").select("doc_id", "_id", "_h", "text", "blobs", "carried").mapInArrow(run, schema)
    return out if carry else out.drop("carried")
