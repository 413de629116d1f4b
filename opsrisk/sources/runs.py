"""Versioned runs: tables and documents that are published together or not at all.

A run is written into a folder of its own, ``<base>/runs/<run id>``, that nobody reads yet. Its manifest (files with
their sizes, rows, checksum and schema of every table) is then moved to ``<base>/_log/<number>.json`` by one rename that
fails if the name is taken. This rename is the publication: before it readers see the former run whole, after it the new one.
Nothing published is ever written again, so a reader that holds a run keeps it whatever is published later, and a
save that dies half-way leaves nothing but an unreferenced folder. Two writers at once get two numbers.

Rows and checksum are observed while a table is written, without a pass of their own. The checksum is a sum of row hashes, so
neither partitioning nor order of the rows matters; ``verify`` makes it again from what is read.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files as IO

_NAME = re.compile(r"^(\d{12})\.json$")
# blanks at a value's ends are part of it
_CSV = {**IO.CSV_DIALECT, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# nothing between two commas is null and a pair of quotes the empty text; the sign stands for null inside the reader only
_CSV_READ = {**_CSV, "multiLine": True, "nullValue": "\u0001"}
FORMATS = ("csv", "parquet")


class RunDamaged(ValueError):
    """Files of a published run are missing or changed."""


@dataclass(frozen=True)
class Run:
    base: str
    run_id: str
    number: int = 0  # 0: not published
    tables: dict[str, dict] = field(default_factory=dict)  # name → path, format, schema, files, rows, checksum
    documents: dict[str, dict] = field(default_factory=dict)  # name → path, bytes

    def path(self, relative: str) -> str:
        return f"{self.base}/runs/{self.run_id}/{relative}"


def _hashable(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return c if isinstance(f.dataType, T.AtomicType) else F.to_json(F.struct(c))


def digest(schema: T.StructType) -> list[Column]:
    """Aggregates rows and checksum of a table with ``schema``."""
    cols = [_hashable(f) for f in schema]
    row = F.xxhash64(*cols, *[c.isNull() for c in cols])
    return [F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(20,0)")).alias("checksum")]


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    """Data files of a table's folder and their sizes."""
    fs, p = IO._fs_path(spark, path)
    listed = {s.getPath().getName(): int(s.getLen()) for s in fs.listStatus(p)}
    return {name: n for name, n in sorted(listed.items()) if not name.startswith(("_", "."))}


def write_table(spark: SparkSession, run: Run, name: str, relative: str, df: DataFrame, fmt: str) -> Run:
    """Write one table of an unpublished run; returns the run with the table's entry."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is none of {FORMATS}")
    seen = Observation()
    out = df.observe(seen, *digest(df.schema)).write.mode("error")
    (out.options(**_CSV, maxRecordsPerFile=IO.CSV_FILE_ROWS).csv if fmt == "csv" else out.parquet)(run.path(relative))
    got = seen.get
    entry = {
        "path": relative, "format": fmt, "schema": df.schema.jsonValue(), "files": _files(spark, run.path(relative)),
        "rows": got["rows"], "checksum": str(got["checksum"] or 0),
    }
    return Run(run.base, run.run_id, 0, {**run.tables, name: entry}, run.documents)


def write_document(spark: SparkSession, run: Run, name: str, relative: str, doc: dict) -> Run:
    text = json.dumps(doc, indent=2)
    IO.write_text(spark, run.path(relative), text)
    return Run(run.base, run.run_id, 0, run.tables, {**run.documents, name: {"path": relative, "bytes": len(text.encode())}})


def start(base: str) -> Run:
    """A new, unpublished run under ``base``."""
    return Run(base.rstrip("/"), uuid.uuid4().hex)


def _log_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/_log/{name}"


def _rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file to a name that must be free; False if it is taken."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(source), hadoop.Path(target)
    context = hadoop.FileContext.getFileContext(a.getFileSystem(sc._jsc.hadoopConfiguration()).getUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(a, b, sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def commit(spark: SparkSession, run: Run) -> Run:
    """Publish a run under the next free number."""
    draft = _log_path(run.base, f".{run.run_id}")
    number = (numbers(spark, run.base) or [0])[-1] + 1
    while True:
        IO.write_text(spark, draft, json.dumps({**asdict(run), "number": number, "base": None}))
        if _rename_new(spark, draft, _log_path(run.base, f"{number:012d}.json")):
            return Run(run.base, run.run_id, number, run.tables, run.documents)
        number += 1


def numbers(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the published runs, ascending."""
    log = _log_path(base, "")
    if not IO.path_exists(spark, log):
        return []
    fs, p = IO._fs_path(spark, log)
    found = (_NAME.match(s.getPath().getName()) for s in fs.listStatus(p))
    return sorted(int(m.group(1)) for m in found if m)


def open_run(spark: SparkSession, base: str, number: int | None = None) -> Run | None:
    """A published run, the newest unless a number is given; None if there is none."""
    known = numbers(spark, base)
    if not known or (number is not None and number not in known):
        return None
    number = known[-1] if number is None else number
    doc = IO.load_json(spark, _log_path(base, f"{number:012d}.json"))
    return Run(base.rstrip("/"), doc["run_id"], number, doc["tables"], doc["documents"])


def read_table(spark: SparkSession, run: Run, name: str) -> DataFrame:
    """A table of a run, with the schema that it was written with."""
    entry = run.tables[name]
    path = run.path(entry["path"])
    if not IO.path_exists(spark, path) or _files(spark, path) != entry["files"]:
        raise RunDamaged(f"run {run.number}: files of {name} are not those of its manifest")
    schema = T.StructType.fromJson(entry["schema"])
    reader = spark.read.schema(schema)
    return reader.options(**_CSV_READ).csv(path) if entry["format"] == "csv" else reader.parquet(path)


def read_document(spark: SparkSession, run: Run, name: str) -> dict:
    text = IO.read_text(spark, run.path(run.documents[name]["path"]))
    if len(text.encode()) != run.documents[name]["bytes"]:
        raise RunDamaged(f"run {run.number}: {name} is not the document of its manifest")
    return json.loads(text)


def verify(spark: SparkSession, run: Run) -> list[str]:
    """Names of the tables whose rows, as read now, are not those that were written."""
    wrong = []
    for name, entry in run.tables.items():
        try:
            got = read_table(spark, run, name).agg(*digest(T.StructType.fromJson(entry["schema"]))).first()
        except RunDamaged:
            wrong.append(name)
            continue
        if (got["rows"], str(got["checksum"] or 0)) != (entry["rows"], entry["checksum"]):
            wrong.append(name)
    return wrong


def expire(spark: SparkSession, base: str, keep: int, unfinished_after_hours: float = 24.0) -> list[int]:
    """Remove all published runs but the newest ``keep`` (one at least), and folders of saves that never ended.

    A run leaves the log before its files go, so it is never seen in part. Returns the numbers removed.
    """
    if keep < 1:
        raise ValueError("the newest run stays")
    known = numbers(spark, base)
    gone = known[:-keep]
    held = set()
    for number in known:
        run = open_run(spark, base, number)
        if number in gone:
            for path in (_log_path(base, f"{number:012d}.json"), run.path("")):
                fs, p = IO._fs_path(spark, path)
                fs.delete(p, True)
        else:
            held.add(run.run_id)
    folder = f"{base.rstrip('/')}/runs"
    if IO.path_exists(spark, folder):
        fs, p = IO._fs_path(spark, folder)
        for s in fs.listStatus(p):
            old = time.time() - s.getModificationTime() / 1000 > unfinished_after_hours * 3600
            if old and s.getPath().getName() not in held:
                fs.delete(s.getPath(), True)
    return gone
