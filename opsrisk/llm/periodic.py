"""Periodic runs of words, by a suffix automaton with link-cut access.

A run is a stretch of words with a smallest period q, repeated at least ``min_exponent`` times, that no neighbouring
word extends. The automaton of the words is built first. Then the words are appended in order: appending word i recolours
the path from the state of prefix i up the suffix links to the root, whose strings now end last at i. The path falls into
segments of one colour; link-cut access meets them one by one (a preferred path is a splay tree, and all its states
have one colour, kept at the tree's root). In a segment of colour j whose longest string has m words, this
string ends at j and at i; if the distance i - j is at most m, a square of that period ends at i. The half of a
primitively rooted square never ends between j and i, so every run shows at each of its positions from the end of its first
square on, and only with its smallest period. A square is extended both ways to its run, once for each run.

Most words of a corpus are in no run. A run of at least four periods and six words holds each of its three-word
windows three times, so only stretches of windows that stand three times in their text (then: in their stretch, and so on)
go to the automaton. This screen looses no run; a run lies in one stretch as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship
from .textbytes import chunks, column_bytes, combine, mix, prefix_hash, range_hash, word_ranges

MIN_LENGTH = 6  # words of a run
MIN_EXPONENT = 4  # periods of a run
_WINDOW, _TIMES = 3, 3  # each window of so many words of a run stands so many times in it

Run = tuple[int, int, int]  # start, length, period


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and longest lengths of all states (1 is the root, 0 none), and the state of every prefix.

    A state's first edge stands in two lists, further ones in a dictionary, as most states have one edge only.
    """
    size = 2 * len(words) + 2
    link, length = [0] * size, [0] * size
    sign, to = [-1] * size, [0] * size
    more: dict[int, dict[int, int]] = {}
    states, last, top = [], 1, 2
    for c in words:
        cur, top = top, top + 1
        length[cur] = length[last] + 1
        p, q = last, 0
        while p:
            if sign[p] == c:
                q = to[p]
                break
            if sign[p] < 0:
                sign[p], to[p] = c, cur
            else:
                edges = more.get(p)
                if edges is None:
                    more[p] = {c: cur}
                else:
                    q = edges.get(c, 0)
                    if q:
                        break
                    edges[c] = cur
            p = link[p]
        if not q:
            link[cur] = 1
        elif length[q] == length[p] + 1:
            link[cur] = q
        else:
            twin, top = top, top + 1
            length[twin] = length[p] + 1
            link[twin] = link[q]
            sign[twin], to[twin] = sign[q], to[q]
            if q in more:
                more[twin] = more[q].copy()
            while p:
                if sign[p] == c:
                    if to[p] != q:
                        break
                    to[p] = twin
                elif p in more and more[p].get(c) == q:
                    more[p][c] = twin
                else:
                    break
                p = link[p]
            link[q] = link[cur] = twin
        states.append(cur)
        last = cur
    return link[:top], length[:top], states


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(end, distance, length of the longest string at that distance) of every segment that yields a square."""
    link, length, states = automaton(words)
    up = link  # parent in the splay tree, or, from its root, the state above the preferred path
    left, right = [0] * len(up), [0] * len(up)
    colour = [-1] * len(up)  # of a preferred path, at the root of its splay tree
    for i, state in enumerate(states):
        below, x = 0, state
        while x:
            # splay x to the root of its tree
            y = up[x]
            while y and (left[y] == x or right[y] == x):
                z = up[y]
                inner = z and (left[z] == y or right[z] == y)
                if inner and (left[z] == y) == (left[y] == x):  # zig-zig: the upper edge turns first
                    turns = ((y, z), (x, y))
                elif inner:
                    turns = ((x, y), (x, z))
                else:
                    turns = ((x, y),)
                for a, b in turns:
                    c = up[b]
                    if left[b] == a:
                        t = left[b] = right[a]
                        right[a] = b
                    else:
                        t = right[b] = left[a]
                        left[a] = b
                    if t:
                        up[t] = b
                    if c:
                        if left[c] == b:
                            left[c] = a
                        elif right[c] == b:
                            right[c] = a
                    up[a], up[b] = c, a
                if inner:
                    colour[x] = colour[z]
                else:
                    colour[x] = colour[y]
                y = up[x]
            j = colour[x]
            deeper = right[x]
            if deeper:
                colour[deeper] = j  # strings that do not end at i
            if j >= 0 and i - j <= length[x]:
                yield i, i - j, length[x]
            right[x] = below
            below, x = x, up[x]
        colour[below] = i


def runs(words: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """All runs of at least ``min_length`` words and ``min_exponent`` periods (two or more), by start and period."""
    known: dict[int, int] = {}  # end of the last run of a period
    out = []
    n = len(words)
    for i, d, m in squares(words):
        if known.get(d, -1) >= i:
            continue
        start, end = i - d - m + 1, i + 1
        while start and words[start - 1] == words[start - 1 + d]:
            start -= 1
        while end < n and words[end] == words[end - d]:
            end += 1
        known[d] = end - 1
        if end - start >= max(min_length, min_exponent * d):
            out.append((start, end - start, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def screen(hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words, each of one text, that hold all runs of at least four periods and six words."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(hashes))
    while True:
        n = len(place) - _WINDOW + 1
        if n < MIN_LENGTH - _WINDOW + 1:
            return []
        window = combine([hashes[i : n + i] for i in range(_WINDOW)])
        whole = np.flatnonzero(owner[:n] == owner[_WINDOW - 1 :])
        key = mix(window[whole] ^ mix(owner[whole].astype(np.uint64) + np.uint64(1)))
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        often = whole[times[inverse] >= _TIMES]
        if not len(often):
            return []
        broken = (np.diff(often) != 1) | (owner[often[1:]] != owner[often[:-1]])
        heads = np.flatnonzero(np.append(True, broken))
        tails = np.append(heads[1:], len(often)) - 1
        start, stop = often[heads], often[tails] + _WINDOW
        long = stop - start >= MIN_LENGTH
        start, stop = start[long], stop[long]
        sizes = stop - start
        if not len(sizes) or sizes.sum() > 0.9 * len(place):
            return list(zip(place[start].tolist(), (place[start] + sizes).tolist(), strict=True))
        pick = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        hashes, place = hashes[pick], place[pick]
        owner = np.repeat(np.arange(len(sizes)), sizes)


def best_run(found: list[Run]) -> Run | None:
    """The run of greatest length/period, compared exactly; ties: smallest start, then period."""
    best = None
    for r in found:  # by start and period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that are in no run or in the first period of every run that holds them."""
    if not found:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
    return [words[k] for k in kept.tolist()]


def _text_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[int, list[Run]], np.ndarray]:
    """Runs of the texts that have any, and every text's number of words."""
    starts, ends, at = word_ranges(data, offsets)
    found: dict[int, list[Run]] = {}
    for a, b in screen(range_hash(prefix_hash(data), starts, ends), at):
        d = int(np.searchsorted(at, a, "right")) - 1
        part = data[starts[a] : ends[b - 1]].tobytes().split()
        ids: dict[bytes, int] = {}  # of the words themselves: no hash decides
        shift = a - int(at[d])
        for s, length, period in runs([ids.setdefault(w, len(ids)) for w in part]):
            found.setdefault(d, []).append((s + shift, length, period))
    return found, np.diff(at)


_FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of every text, and the text without what they repeat.

    Words are separated by ASCII blanks and numbered from 0. Returns one row for each row of ``docs``: doc_id, n_words,
    runs (by start, then period), best (greatest length/period; null without a run), collapsed (words joined by a space; a word
    is left out if any run holds it after the run's first period).

    A null or empty text has no words, no runs and an empty collapsed text. Repeated rows and null ids pass through, each
    row for itself. An empty table gives no rows. Only doc_id and text are read. Rows are independent and nothing is shuffled; a task's memory grows with
    its longest text (about 400 bytes for each word that the screen leaves).
    """
    ship(docs.sparkSession)
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    named = lambda r: {"start": r[0], "length": r[1], "period": r[2]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            counts, lists, bests, texts = [], [], [], []
            for i, j in chunks(offsets, 1 << 20):
                base = offsets[i]
                part, part_at = data[base : offsets[j]], offsets[i : j + 1] - base
                found, sizes = _text_runs(part, part_at)
                counts += sizes.tolist()
                for d in range(j - i):
                    mine = sorted(found.get(d, ()), key=lambda r: (r[0], r[2]))
                    best = best_run(mine)
                    lists.append([named(r) for r in mine])
                    bests.append(None if best is None else named(best))
                    texts.append(b" ".join(collapse(part[part_at[d] : part_at[d + 1]].tobytes().split(), mine)).decode())
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(run_type)), pa.array(bests, run_type), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "best", "collapsed"])

    return kept.mapInArrow(run, f"doc_id {id_type}, {_FOUND}")
