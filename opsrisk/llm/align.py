"""Cross-tokenizer alignment with corpus-wide pair counts in minimal perfect hash order.

A text is encoded by two tokenizers, A (byte-level BPE) and B (pieces with byte fallback). Both cut the same bytes; byte
offsets where tokens of both end cut them into groups, and the A and B token that end there together are linked. A pair of
ids counts the links that hold it in the corpus.

First pass: every task encodes and aligns its documents (what stands between two spaces is encoded once and looked up where
it stands again, if both vocabularies cut there), stores their ids in blocks, and gives its distinct pairs with
their links. The distinct pairs of the corpus get numbers 0 to n - 1 by a minimal perfect hash function (perfect.py), built
in slices of the pairs. Each task's links become a dense vector indexed by these numbers, and the vectors are summed in
chunks by a tree of fixed fan-in. Second pass: the stored documents are aligned again and look up their links, the keys that stand at the
numbers being verified.

Pairs are at most A's ids times B's. The function, keys and counts of so many slices as hold ``held`` pairs are broadcast at
a time; more pairs take more passes over the stored ids, whose sums are added up, so memory is bounded at every size.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .perfect import Function, build, slice_of
from .shared import saved, ship

SLICES = 64  # of the pairs
HELD = 1 << 21  # pairs whose numbers and counts a worker holds at once (about 40 MB)
BLOCK_CHARS = 1 << 20  # texts of so many characters are stored together
FOLD = 1 << 21  # pairs that a task collects before it gives them out
CHUNK = 1 << 16  # counts of a vector that are summed together
FAN_IN = 32  # vectors that one task of the tree adds
KEPT = 1 << 17  # pieces of text whose ids a worker keeps (about 32 MB); it forgets all beyond that
LINE = 128  # pieces that are encoded as one text


def byte_of_sign() -> dict[str, int]:
    """Byte of each sign that byte-level vocabularies write: printable bytes are themselves, the others 256 and up in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


def stand_alone(a_file: bytes, b_file: bytes) -> bool:
    """Whether both tokenizers cut before every space that stands alone between other signs than white space.

    If so, what lies between two such spaces is encoded alike in every text: A's pattern starts anew at the space, and no piece of
    B has its space sign after another sign, so that no merge crosses it. False if the files do not tell.
    """
    try:
        from sentencepiece.sentencepiece_model_pb2 import ModelProto
    except ImportError:  # it needs protobuf
        return False
    a, b = json.loads(a_file), ModelProto.FromString(b_file)
    pre, model, spec = a.get("pre_tokenizer") or {}, a["model"], b.normalizer_spec
    if a.get("normalizer") or a.get("truncation") or a.get("padding") or model.get("type") != "BPE" or model.get("dropout"):
        return False
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not all(t["special"] for t in a["added_tokens"]):
        return False
    if b.trainer_spec.model_type != b.trainer_spec.BPE or b.trainer_spec.treat_whitespace_as_suffix or spec.precompiled_charsmap:
        return False
    if not (spec.add_dummy_prefix and spec.escape_whitespaces) or spec.remove_extra_whitespaces:
        return False
    odd = (b.SentencePiece.USER_DEFINED, b.SentencePiece.UNUSED)
    return all(p.type not in odd and "▁" not in p.piece.lstrip("▁") for p in b.pieces)


class Aligner:
    """Both tokenizers and the bytes of their tokens; one per Python worker.

    ``alone`` tells that the tokenizers cut at single spaces (stand_alone). Texts are then encoded in pieces, else whole.
    """

    def __init__(self, a_file: bytes, b_file: bytes, alone: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_file)
        signs = byte_of_sign()
        vocab = self.a.get_vocab(with_added_tokens=True)
        added = {t["id"] for t in json.loads(a_file)["added_tokens"]}
        self.a_bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if i in added else bytes(signs[c] for c in token)
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.vocab_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.width = len(self.b_bytes)  # a pair's key is a * width + b
        if not (self.a_size.all() and self.b_size.all()):
            raise ValueError("a vocabulary holds a token without bytes")
        digits = np.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))], "S")
        self.digits = digits.view(np.uint8).reshape(len(digits), -1)
        self.n_digits = np.char.str_len(digits)
        self.alone = alone
        self.cut = re.compile(r"(?<=\S) (?=\S)").split if alone else lambda text: [text]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # number of each piece
        self.a_ids = self.b_ids = np.zeros(0, np.int32)  # ids of all pieces by their numbers
        self.a_at = self.b_at = np.zeros(1, np.int64)  # where each piece's ids start, and the end
        self.wrong = np.zeros(0, bool)  # its ids do not join to its bytes: it has none

    def _learn(self, pieces: Iterable[str], line: int) -> None:
        """Encode the pieces that are not known yet, up to ``line`` of them joined by spaces to one text."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        joined = [p for p in new if line > 1 and not (p[0].isspace() or p[-1].isspace())]
        lines = [joined[i : i + line] for i in range(0, len(joined), line)]
        if len(joined) < len(new):
            rest = set(joined)
            lines += [[p] for p in new if p not in rest]
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        a_ids, b_ids, a_n, b_n, wrong = [self.a_ids], [self.b_ids], [], [], []

        def add(part: list[list[str]]) -> list[list[str]]:
            """Lines that have to be encoded piece by piece."""
            failed = []
            whole = [" ".join(x) for x in part]
            ours = self.a.encode_batch_fast([" " + t for t in whole], add_special_tokens=False)
            for words, text, a, b in zip(part, whole, ours, self.b.encode(whole, num_threads=1), strict=True):
                a, raw = a.ids, b" " + text.encode()
                good = b"".join(map(a_bytes, a)) == raw and b"".join(map(b_bytes, b)) == raw
                if good:
                    a, b = np.array(a, np.int32), np.array(b, np.int32)
                    ends = np.cumsum([len(w.encode()) + 1 for w in words])
                    a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
                    a_last, b_last = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
                    good = bool((a_ends[a_last] == ends).all() and (b_ends[b_last] == ends).all())
                if not good and len(words) > 1:
                    failed.append(words)
                    continue
                for w in words:
                    self.known[w] = len(self.known)
                wrong.extend([not good] * len(words))
                if good:
                    a_ids.append(a)
                    b_ids.append(b)
                a_n.append(np.diff(a_last, prepend=-1) if good else [0])
                b_n.append(np.diff(b_last, prepend=-1) if good else [0])
            return failed

        failed = add(lines) if lines else []
        if failed:
            add([[w] for words in failed for w in words])
        if a_n:
            self.a_ids, self.b_ids = np.concatenate(a_ids), np.concatenate(b_ids)
            self.a_at, self.b_at = (np.append(at, at[-1] + np.cumsum(np.concatenate(n))) for at, n in ((self.a_at, a_n), (self.b_at, b_n)))
            self.wrong = np.append(self.wrong, wrong)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts by A and by B, one text after the other, and how many each text has; none if its bytes are not those of space and text."""
        cut = [self.cut(t) if t else [] for t in texts]
        self._learn(chain.from_iterable(cut), LINE if self.alone else 1)
        number, of = self._numbers(cut)
        if self.wrong[number].any():
            for i in np.unique(np.searchsorted(of, np.flatnonzero(self.wrong[number]), "right") - 1).tolist():
                cut[i] = [texts[i]]  # the whole text decides
                self._learn(cut[i], 1)
            number, of = self._numbers(cut)
        out = []
        for ids, at in ((self.a_ids, self.a_at), (self.b_ids, self.b_at)):
            size = at[number + 1] - at[number]
            ends = np.append(0, np.cumsum(size))
            place = np.arange(ends[-1]) + np.repeat(at[number] - ends[:-1], size)
            out += [ids[place].astype(np.int64), np.diff(ends[of])]
        if len(self.known) > KEPT or len(self.a_ids) + len(self.b_ids) > 16 * KEPT:
            self._forget()
        a, n_a, b, n_b = out
        return a, b, n_a, n_b

    def _numbers(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces, and where each text's start."""
        of = np.append(0, np.cumsum([len(pieces) for pieces in cut], dtype=np.int64))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, of[-1]), of

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the A and of the B token that end each group; ``a`` and ``b`` cut the same bytes."""
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        total = int(a_ends[-1]) + 1 if len(a) else 1
        mark = np.zeros(total, dtype=bool)
        mark[b_ends] = True
        a_last = np.flatnonzero(mark[a_ends])
        mark[b_ends] = False
        mark[a_ends] = True
        return a_last, np.flatnonzero(mark[b_ends])

    def pairs(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> np.ndarray:
        """Key of every link. Tokens have bytes, so one token of A and one of B end at a group's end."""
        return a[a_last].astype(np.uint64) * np.uint64(self.width) + b[b_last].astype(np.uint64)

    def written(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups as `a1,a2|b1;a3|b2,b3;` (bytes), and where each group's part ends."""
        n = len(a) + len(b)
        a_n, b_n = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        a_at = np.arange(len(a)) + np.repeat(b_last - b_n + 1, a_n)
        b_at = np.arange(len(b)) + np.repeat(a_last + 1, b_n)
        ids, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[a_at], ids[b_at] = a, b
        sign[a_at[a_last]], sign[b_at[b_last]] = ord("|"), ord(";")
        size = self.n_digits[ids]
        width = self.digits.shape[1]
        out = np.zeros((n, width + 1), np.uint8)
        out[:, :width] = self.digits[ids]
        out[np.arange(n), size] = sign
        return out[np.arange(width + 1) <= size[:, None]], np.cumsum(size + 1)[b_at[b_last]]


_ALIGNERS: dict[str, Aligner] = {}  # in a Python worker: loaded once


def _aligner(files: tuple[bytes, bytes, bool]) -> Aligner:
    key = hashlib.sha256(files[0] + files[1]).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*files)
    return _ALIGNERS[key]


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit, else four; compressed. The first byte tells."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    raw = ids.astype(np.uint16 if small else np.uint32).tobytes()
    return (b"\2" if small else b"\4") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _wide(blob: bytes) -> np.ndarray:
    raw = pa.decompress(blob[9:], int.from_bytes(blob[1:9], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint16 if blob[0] == 2 else np.uint32)


_BLOCKS = "block long, doc_ids array<{}>, n_a binary, n_b binary, a binary, b binary, slice int, pairs array<long>, links array<long>"


def _store(files, id_type: pa.DataType, slices: int):
    """Rows with a block's documents, then rows with the task's pairs in a slice and their links."""
    types = (pa.int64(), pa.list_(id_type), *[pa.binary()] * 4, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = [f.split()[0] for f in _BLOCKS.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def folded(got: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
        return keys, np.bincount(where, weights=np.concatenate([n for _, n in got]), minlength=len(keys)).astype(np.int64)

    def given(got: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, links = folded(got)
        of = slice_of(keys, slices)
        for s in np.unique(of).tolist():
            yield made([(None, None, None, None, None, None, s, keys[of == s].astype(np.int64), links[of == s])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(files.value)
        block = TaskContext.get().partitionId() << 32
        got, size = [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j]) <= BLOCK_CHARS):
                    chars += len(texts[j])
                    j += 1
                a, b, n_a, n_b = al.encode(texts[i:j])
                yield made([(block, batch.column(0)[i:j].to_pylist(), _narrow(n_a), _narrow(n_b), _narrow(a), _narrow(b), None, None, None)])
                block += 1
                if len(a):
                    keys, links = np.unique(al.pairs(a, b, *al.groups(a, b)), return_counts=True)
                    got.append((keys, links))
                    size += len(keys)
                if size > FOLD:
                    got = [folded(got)]
                    size = len(got[0][0])
                    if size > FOLD // 2:
                        yield from given(got)
                        got, size = [], 0
                i = j
        if got:
            yield from given(got)

    return run


def _build(table: pa.Table) -> pa.Table:
    levels, keys = build(table["pair"].to_numpy().astype(np.uint64))
    return pa.table({
        "slice": pa.array([table["slice"][0].as_py()], pa.int32()),
        "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())),
        "keys": pa.array([keys.tobytes()], pa.binary()),
        "n": pa.array([len(keys)], pa.int64()),
    })


def _function(functions: DataFrame, held: list[int], slices: int) -> Function:
    """Function of some slices, of bounded size."""
    rows = functions.where(F.col("slice").isin(held)).select("slice", "levels", "keys").collect()
    return Function(slices, {r["slice"]: ([np.frombuffer(x, np.uint64) for x in r["levels"]], np.frombuffer(r["keys"], np.uint64)) for r in rows})


def _vectors(function, n: int):
    """One task's links as a dense vector, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, vector, any_ = function.value, np.zeros(n, np.int64), False
        for batch in batches:
            for i in range(batch.num_rows):
                number = f.number(batch.column(0)[i].values.to_numpy())
                vector[number] += batch.column(1)[i].values.to_numpy()
                any_ = True
        if any_:
            part = TaskContext.get().partitionId()
            for c, k in enumerate(range(0, n, CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([part], pa.int64()), pa.array([vector[k : k + CHUNK].tobytes()], pa.binary())], names=["chunk", "part", "counts"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in table["counts"]], axis=0)
    return pa.table({"chunk": table["chunk"][:1], "part": pa.array([table["to"][0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def _tree_sum(vectors: DataFrame, parts: int) -> DataFrame:
    """Sum of the vectors of ``parts`` tasks, chunk by chunk; no task adds more than FAN_IN."""
    while parts > 1:
        parts = -(-parts // FAN_IN)
        to = F.floor(F.col("part") / FAN_IN).alias("to")
        vectors = vectors.select("chunk", "part", to, "counts").groupBy("chunk", "to").applyInArrow(_add, "chunk long, part long, counts binary")
        if parts > 1:
            vectors = saved(vectors, "align-tree")
    return vectors


_LOOKED_UP = "block long, row int, doc_id {}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _look_up(files, counted, id_type: pa.DataType, keep_groups: bool):
    """One row for each document of a block; n_best and count_sum of the pairs that are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(files.value)
        function, counts, best = counted.value
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, *blobs = (c[i].as_py() for c in batch.columns)
                n_a, n_b, a, b = (_wide(x).astype(np.int64) for x in blobs)
                a_last, b_last = al.groups(a, b)
                number = function.number(al.pairs(a, b, a_last, b_last))
                count = np.where(number >= 0, counts[number] if len(counts) else 0, 0)
                top = (number >= 0) & (count == best[b[b_last]])
                cuts = np.searchsorted(a_last, np.append(0, np.cumsum(n_a)))  # groups before each document
                summed = lambda x, cuts=cuts: np.diff(np.append(0, np.cumsum(x))[cuts])
                text, ends = al.written(a, b, a_last, b_last)
                ends = np.append(0, ends)[cuts].tolist()
                text = text.tobytes()
                parts = [text[s : e - 1] if e > s else b"" for s, e in zip(ends, ends[1:], strict=False)]
                digests = [hashlib.sha256(x).hexdigest() if x else "" for x in parts]
                groups = np.diff(cuts)
                cols = [
                    pa.array([block] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, id_type), pa.array(n_a), pa.array(n_b),
                    pa.array(groups), pa.array(groups), pa.array(summed(top.astype(np.int64))), pa.array(summed(count)), pa.array(digests, pa.string()),
                ]
                names = [f.split()[0] for f in _LOOKED_UP.split(", ")]
                if keep_groups:
                    cols, names = [*cols, pa.array([x.decode() for x in parts], pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def align_documents(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = True, slices: int = SLICES, held: int = HELD) -> DataFrame:
    """Align every text's tokens and look up its links.

    Returns one row for each row of ``docs``: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the
    highest of their B id in the corpus, ties included), count_sum (counts of all links), groups_sha256 of the groups written as `a1,a2|b1;a3|b2,b3`
    (decimal ids in order), and this text as groups unless ``keep_groups`` is false.

    A text that is null, empty, or whose tokens by A or B do not join to the bytes of space and text, has no tokens: zeros and
    two empty strings. Repeated rows count each for itself; null ids pass through. An empty table gives no rows. Only doc_id
    and text are read. A text is encoded as a whole, so a task's memory grows with its longest text (about 150 bytes a token).

    The vocabulary files are read on the driver and broadcast (a few megabytes each).
    """
    spark = docs.sparkSession
    ship(spark)
    with open(a_path, "rb") as fa, open(b_path, "rb") as fb:
        raw = fa.read(), fb.read()
    raw = *raw, stand_alone(*raw)
    files = spark.sparkContext.broadcast(raw)
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    type_name = kept.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kept.schema["doc_id"].dataType)
    stored = saved(kept.mapInArrow(_store(files, id_type, slices), _BLOCKS.format(type_name)), "align-blocks")
    blocks = stored.where("block is not null").select("block", "doc_ids", "n_a", "n_b", "a", "b")
    given = stored.where("slice is not null")
    distinct = given.select("slice", F.explode("pairs").alias("pair")).distinct()
    functions = saved(distinct.groupBy("slice").applyInArrow(_build, "slice int, levels array<binary>, keys binary, n long"), "align-functions")
    sets, room = [], 0
    for r in functions.select("slice", "n").orderBy("slice").collect():  # one row a slice
        if not sets or room + r["n"] > held:
            sets.append([])
            room = 0
        sets[-1].append(r["slice"])
        room += r["n"]
    al = Aligner(*raw)
    best = np.zeros(al.width, np.int64)
    summed = []
    for chosen in sets:
        f = _function(functions, chosen, slices)
        n = len(f.keys)
        links = given.where(F.col("slice").isin(chosen)).select("pairs", "links")
        vectors = saved(links.mapInArrow(_vectors(spark.sparkContext.broadcast(f), n), "chunk long, part long, counts binary"), "align-vectors")
        parts = (vectors.agg(F.max("part")).first()[0] or 0) + 1
        total = saved(_tree_sum(vectors, parts), "align-counts")
        summed.append(total)
        np.maximum.at(best, (f.keys % np.uint64(al.width)).astype(np.int64), _counts(total))
    out = None
    for chosen, total in zip(sets or [[]], summed or [None], strict=True):
        counted = spark.sparkContext.broadcast((_function(functions, chosen, slices), _counts(total), best))
        looked = _LOOKED_UP.format(type_name) + ", groups string" * keep_groups
        part = blocks.mapInArrow(_look_up(files, counted, id_type, keep_groups), looked)
        out = part if out is None else out.unionByName(part)
    if len(sets) > 1:
        same = [F.first(c, ignorenulls=False).alias(c) for c in out.columns if c not in ("block", "row", "n_best", "count_sum")]
        out = out.groupBy("block", "row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * keep_groups
    return out.select(columns)


def _counts(total: DataFrame | None) -> np.ndarray:
    """Counts in the order of the numbers; as many as a worker holds at once."""
    if total is None:
        return np.zeros(0, np.int64)
    got = sorted((r["chunk"], r["counts"]) for r in total.select("chunk", "counts").collect())
    return np.concatenate([np.frombuffer(x, np.int64) for _, x in got]) if got else np.zeros(0, np.int64)
