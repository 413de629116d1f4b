"""Transcript parsing by a hidden Markov model over lines, and canonical rendering of the turns.

A row's text may hold one turn or several ("User: hi / Assistant: hello / User: ..."). The lines of a conversation are the
observations: whether a line is the first of its row together with the role that its speaker marker names, its length and whether it
ends with a question. The states are the roles, each as the beginning of a turn and as its continuation; a row begins a turn, and a turn
continues in its own role only. Initial, transition and emission probabilities are counted on labelled rows of one turn each
(with one pseudo-count each; a role's own marker has a strong prior at the beginning of a turn, no marker in its continuation). Viterbi
finds the likeliest states of a whole conversation; each turn is then rendered with its role, its marker left out.

Rows are sorted by conversation over range partitions, and every partition cuts its rows into pieces of one conversation each. A piece is
folded to its best log-probability from every state that enters to every state that leaves (a max-plus matrix product); the
pieces' borders are decoded from these matrices, and then every piece on its own between its borders. No task holds the rows of more
than one piece, which has at most ``piece`` lines and PIECE_BYTES of text, or one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import saved, ship

ROLES = ("system", "user", "assistant")
N = len(ROLES)
STATES = 2 * N  # beginnings of a role's turn, then continuations
PIECE = 4096  # lines
PIECE_BYTES = 4 << 20
MARKER_PRIOR = 200.0  # pseudo-lines in which a role's own marker was seen at a beginning, and none in a continuation
NEVER = -1e9  # a continuation as the first line of a row
# Speaker names and tags of transcripts.
NAMES = {
    "system": ("system", "instruction", "instructions", "context", "sys"),
    "user": ("user", "human", "customer", "question", "prompter", "q", "me", "you"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "response", "model", "gpt", "a"),
}
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role]}
_OPEN = r"(?:<\|im_start\|>|<\|start_header_id\|>|<\||\[|#{1,4}\s*|\*\*|>\s*)"
_CLOSE = r"\s*(?:<\|end_header_id\|>|\|>|\]|\*\*)?\s*"
_ANY = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_FIRST = re.compile(rf"\s*{_OPEN}?\s*({_ANY}){_CLOSE}(?::\**|(?<=[>\])])|(?=\n))\s*", re.I)
# inside a text a name alone is prose: it needs a colon or a tag, and names of one letter are capitals
_INNER = re.compile(rf"\s*(?:{_OPEN}\s*((?i:{_ANY})){_CLOSE}(?::\**|(?<=[>\])])|(?=\n))|((?i:{'|'.join(sorted((x for x in _ROLE_OF if len(x) > 1), key=len, reverse=True))})|Q|A)\s*:)\s*")
_END = re.compile(r"\s*(?:<\|(?:im_end|eot_id|end|endoftext)\|>|</s>)\s*\Z")


def _lines(text: str) -> list[str]:
    return text.split("\n")


def _marker(line: str, first: bool, last: bool) -> re.Match | None:
    return (_FIRST if first else _INNER).match(line if last else line + "\n")


def observe(text: str) -> list[tuple[int, int]]:
    """(mark, shape) of each line: 4 for a row's later lines plus the number of the marker's role from 1; bits of the length and whether it asks."""
    lines, out = _lines(text), []
    for i, line in enumerate(lines):
        m = _marker(line, i == 0, i == len(lines) - 1)
        role = _ROLE_OF[next(g for g in m.groups() if g).lower()] + 1 if m else 0
        out.append((4 * (i > 0) + role, min(len(line).bit_length(), 15) * 2 + line.rstrip().endswith("?")))
    return out


def _sorted(turns: DataFrame) -> DataFrame:
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("text")]
    return turns.repartitionByRange(*order).sortWithinPartitions(*order)


def learn(turns: DataFrame) -> dict[str, np.ndarray]:
    """Log-probabilities from labelled rows (conv_id, turn, role, text); rows of other or null roles teach nothing.

    Every task counts its range of the sorted rows; a range's first and last role join it to its neighbours. The model is a few
    tables of at most 6 x 32 numbers, whatever the input.
    """
    ship(turns.sparkSession)
    role = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.lower(F.trim(F.col("role")))).cast("int"), F.lit(0)) - 1
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), role.alias("role"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, step, goes_on = np.zeros(N), np.zeros((N, N)), np.zeros((N, 2))
        mark, shape = np.zeros((STATES, 8)), np.zeros((STATES, 32))
        opens, before, role = None, None, -1
        for batch in batches:
            for conv, text, r in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if opens is None:
                    opens = (conv, r)
                elif r >= 0:
                    if conv != before:
                        first[r] += 1
                    elif role >= 0:
                        step[role, r] += 1
                before, role = conv, r
                if r < 0:
                    continue
                for i, (m, s) in enumerate(observe(text.as_py())):
                    state = r + N * (i > 0)
                    mark[state, m] += 1
                    shape[state, s] += 1
                    goes_on[r, int(i > 0)] += 1
        if opens is not None:
            counts = np.concatenate([x.ravel() for x in (first, step, goes_on, mark, shape)]).tolist()
            values = (TaskContext.get().partitionId(), opens[0], opens[1], before, role, counts)
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["part", "conv", "opens", "last", "ends", "counts"])

    plain = _sorted(rows).select(F.col("conv_id").cast("string").alias("conv"), "text", "role")
    got = sorted(plain.mapInArrow(counted, "part int, conv string, opens int, last string, ends int, counts array<double>").collect(), key=lambda r: r["part"])
    total = np.sum([r["counts"] for r in got], axis=0) if got else np.zeros(N + N * N + 2 * N + STATES * 40)
    first, step, goes_on, mark, shape = (x.reshape(s) for x, s in zip(np.split(total, np.cumsum([N, N * N, 2 * N, STATES * 8])), ((N,), (N, N), (N, 2), (STATES, 8), (STATES, 32)), strict=True))
    for a, r in zip([None, *got], got, strict=False):
        if r["opens"] >= 0:
            if a is None or a["last"] != r["conv"]:
                first[r["opens"]] += 1
            elif a["ends"] >= 0:
                step[a["ends"], r["opens"]] += 1
    roles = np.arange(N)
    for m in (0, roles + 1, roles + 5):
        mark[roles, m] += MARKER_PRIOR
    mark[N:, 4] += MARKER_PRIOR
    log = lambda x: np.log((x + 1) / (x + 1).sum(axis=-1, keepdims=True))
    on = log(goes_on)  # a turn's next line is a beginning or a continuation
    through = np.full((STATES, STATES), NEVER)
    for s in range(STATES):
        through[s, :N] = on[s % N, 0] + log(step)[s % N]
        through[s, N + s % N] = on[s % N, 1]
    mark = log(mark)
    mark[N:, :4] = NEVER
    return {"first": np.concatenate([log(first), np.full(N, NEVER)]), "step": through, "mark": mark, "shape": log(shape)}


def emissions(model: dict[str, np.ndarray], lines: np.ndarray) -> np.ndarray:
    """Log-probability of every line (mark, shape) in every state."""
    return (model["mark"][:, lines[:, 0]] + model["shape"][:, lines[:, 1]]).T


def fold(model: dict[str, np.ndarray], emission: np.ndarray) -> np.ndarray:
    """Max-plus matrix of a piece: best log-probability of its lines by entering state (last row: at a conversation's start) and leaving state."""
    best = np.vstack([model["step"], model["first"]]) + emission[0]
    for e in emission[1:]:
        best = (best[:, :, None] + model["step"][None]).max(axis=1) + e
    return best


def decode(model: dict[str, np.ndarray], emission: np.ndarray, enters: int | None, leaves: int | None) -> list[int]:
    """Likeliest states of a piece between its borders (None: free); ties go to the first state."""
    back, best = [], (model["first"] if enters is None else model["step"][enters]) + emission[0]
    for e in emission[1:]:
        through = best[:, None] + model["step"]
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + e
    path = [int(best.argmax()) if leaves is None else leaves]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def split_turns(text: str, states: list[int]) -> list[tuple[str, str]]:
    """(role, text without marker and outer blanks) of each turn in a row's text, by the states of its lines."""
    lines, out = _lines(text), []
    for i, (line, state) in enumerate(zip(lines, states, strict=True)):
        if state < N:
            m = _marker(line, i == 0, i == len(lines) - 1)
            out.append((ROLES[state], [line[m.end() :] if m else line]))
        else:
            out[-1][1].append(line)
    return [(role, _END.sub("", "\n".join(body)).strip()) for role, body in out]


def recover_roles(turns: DataFrame, model: dict[str, np.ndarray], piece: int = PIECE) -> DataFrame:
    """Roles and canonical form of every row of ``turns`` (conv_id, turn, text; a column role is not read).

    Returns conv_id, turn, role_pred (system, user or assistant: of the row's first turn), rendered (for each turn of the row `<|role|>`, line
    end, the text without its marker, end tag and outer blanks, line end, `<|end|>`; turns joined by line ends), turns (array of role and text).
    Rows are ordered by turn (null first), then text; repeated rows are rows of their
    own. A null text is empty, and an empty text is one empty line. Each row with a null conv_id is a conversation by itself. A row's lines stay in one piece,
    so a task's memory grows with its longest text. An empty table gives no rows.
    """
    spark = turns.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conv_type, turn_type = rows.schema["conv_id"].dataType, rows.schema["turn"].dataType
    conv_kind, turn_kind = to_arrow_type(conv_type), to_arrow_type(turn_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        key, held, lines, size = None, [], [], 0

        def done() -> pa.RecordBatch:
            values = (key, part, seq, np.array(lines, np.uint8).tobytes(), [len(_lines(t)) for _, t in held], [k for k, _ in held], [t for _, t in held])
            kinds = (conv_kind, pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(turn_kind), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["conv_id", "part", "seq", "lines", "sizes", "turn", "text"])

        for batch in batches:
            for conv, turn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                seen = observe(text)
                if held and (conv is None or conv != key or len(lines) + len(seen) > piece or size + len(text) > PIECE_BYTES):
                    yield done()
                    seq, held, lines, size = seq + 1, [], [], 0
                key = conv
                held.append((turn, text))
                lines += seen
                size += len(text)
        if held:
            yield done()

    kind = f"conv_id {conv_type.simpleString()}, part int, seq long, lines binary, sizes array<int>, turn array<{turn_type.simpleString()}>, text array<string>"
    pieces = saved(_sorted(rows).mapInArrow(cut, kind), "chat-pieces")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [fold(shared.value, emissions(shared.value, np.frombuffer(x.as_py(), np.uint8).reshape(-1, 2))).ravel().tolist() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best, pa.list_(pa.float64()))], names=["conv_id", "part", "seq", "best"])

    def bordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for conv, run in groupby(stream, key=lambda r: r[0]):
            best, back, at = None, [], []
            for _, part, seq, matrix in run:
                matrix = np.array(matrix).reshape(STATES + 1, STATES)
                if best is None:
                    best = matrix[STATES]
                else:
                    through = best[:, None] + matrix[:STATES]
                    back.append(through.argmax(axis=0).astype(np.int8))
                    best = through.max(axis=0)
                at.append((part, seq))
            ends = [int(best.argmax())]
            for b in reversed(back):
                ends.append(int(b[ends[-1]]))
            ends.reverse()
            values = ([conv] * len(at), [p for p, _ in at], [s for _, s in at], [None, *ends[:-1]], ends)
            kinds = (conv_kind, pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["conv_id", "part", "seq", "enters", "leaves"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for conv, lines, sizes, turn, text, enters, leaves in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                states = decode(shared.value, emissions(shared.value, np.frombuffer(lines, np.uint8).reshape(-1, 2)), enters, leaves)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                parsed = [split_turns(t, states[a:b]) for t, a, b in zip(text, starts, starts[1:], strict=False)]
                rendered = ["\n".join(f"<|{role}|>\n{body}\n<|end|>" for role, body in row) for row in parsed]
                turns_of = [[{"role": role, "text": body} for role, body in row] for row in parsed]
                cols = [pa.array([conv] * len(turn), conv_kind), pa.array(turn, turn_kind), pa.array([row[0][0] for row in parsed], pa.string()), pa.array(rendered, pa.string()), pa.array(turns_of, made)]
                yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "turn", "role_pred", "rendered", "turns"])

    conv_text = f"conv_id {conv_type.simpleString()}"
    sums = pieces.where("conv_id is not null").select("conv_id", "part", "seq", "lines").mapInArrow(summed, f"{conv_text}, part int, seq long, best array<double>")
    borders = sums.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(bordered, f"{conv_text}, part int, seq long, enters int, leaves int")
    joined = pieces.join(borders, ["conv_id", "part", "seq"], "left").select("conv_id", "lines", "sizes", "turn", "text", "enters", "leaves")
    return joined.mapInArrow(decoded, f"{conv_text}, turn {turn_type.simpleString()}, role_pred string, rendered string, turns array<struct<role:string,text:string>>")
