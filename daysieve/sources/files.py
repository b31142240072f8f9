"""Contents of the files of an inventory: heads and tails of bounded size, lines and whole texts, with a row for each file that tells what became of it.

Files are opened by the tasks that return their rows, a file at a time. A file that can't be read ends nothing: it has a
row with its status (ok, empty, denied, absent, failed) like all others, beside the rows that could be read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD_BYTES = 16 * 1024
TAIL_BYTES = 8 << 20
#: Rows and bytes of an Arrow batch, about.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def fault(error: OSError) -> str:
    return "denied" if isinstance(error, PermissionError) else "absent" if isinstance(error, FileNotFoundError) else "failed"


def _plain(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:/") else path


def read_ranges(files: DataFrame, head: int | None = None, tail: int | None = None) -> DataFrame:
    """files (path, ...) with size, start, n_bytes (read), text, status and error: only the first head or the last tail bytes are read. A tail that begins within a line begins with the next one; signs cut at an end are U+FFFD."""
    keep = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.schema.get_field_index("path")
            for i, path in enumerate(batch.column(spot).to_pylist()):
                size = start = n = text = error = None
                try:
                    with open(_plain(path), "rb") as f:
                        size = os.fstat(f.fileno()).st_size
                        start = 0 if tail is None else max(0, size - tail)
                        f.seek(start)
                        raw = f.read(head if head is not None else -1 if tail is None else tail)
                        n = len(raw)
                        if start:
                            raw = raw.partition(b"\n")[2]
                        text, status = raw.decode("utf-8", "replace"), "ok" if size else "empty"
                except OSError as e:
                    status, error = fault(e), e.strerror
                made = [pa.array([x], t) for x, t in ((size, pa.int64()), (start, pa.int64()), (n, pa.int64()), (text, pa.string()), (status, pa.string()), (error, pa.string()))]
                yield pa.record_batch([*batch.slice(i, 1).columns, *made], [*keep, "size", "start", "n_bytes", "text", "status", "error"])

    files = files.drop("size", "start", "n_bytes", "text", "status", "error")
    keep = files.columns
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{given}, size bigint, start bigint, n_bytes bigint, text string, status string, error string")


def read_contents(files: DataFrame, whole: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, file, n, value, status, error): the lines of each file of files (path, ...), or one row with all of it, numbered from 0; then a row without value that has the file's status, n how many came before it. Bytes that aren't UTF-8 make a file failed from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held.clear()
            return made

        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in keep), ("file", pa.string()), ("n", pa.int64()), ("value", pa.string()), ("status", pa.string()), ("error", pa.string())])
            for row in batch.to_pylist():
                own, n, status, error = tuple(row[c] for c in keep), 0, None, None
                try:
                    with open(_plain(row["path"]), "rb") as f:
                        for raw in [f.read()] if whole else f:
                            if raw:
                                held.append((*own, row["path"], n, raw.decode() if whole else raw.decode().rstrip("\r\n"), None, None))
                                n, size = n + 1, size + len(raw)
                            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                                yield out()
                                size = 0
                    status = "ok" if n else "empty"
                except OSError as e:
                    status, error = fault(e), e.strerror
                except UnicodeDecodeError as e:
                    status, error = "failed", e.reason
                held.append((*own, row["path"], n, None, status, error))
        if held:
            yield out()

    rows = files.select("path", *keep)
    given = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{given}file string, n bigint, value string, status string, error string")


def report(contents: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, status, files, rows, error) of read_contents(): ok if any file was, else denied, failed, empty or absent, the first of these that a file was; error is one of the faults."""
    has = lambda s: F.count_if(F.col("status") == s) > 0
    status = F.when(has("ok"), "ok").when(has("denied"), "denied").when(has("failed"), "failed").when(has("empty"), "empty").otherwise("absent")
    return contents.where("status IS NOT NULL").groupBy(*by).agg(status.alias("status"), F.count("*").alias("files"), F.count_if(~F.col("status").isin("ok", "empty")).alias("unread"), F.sum("n").alias("rows"), F.min("error").alias("error"))


def working_folders(inventory: DataFrame, n: int = 80, skip: tuple[str, ...] = ("subagents", "workflows")) -> DataFrame:
    """(cwd, mtime): the directories that the n session logs changed last name in their first 16 KB; what else the logs hold is not read."""
    from .inventory import newest

    logs = inventory.where(~F.exists(F.split("path", "/"), lambda x: x.isin(*skip)))
    heads = read_ranges(newest(logs, n, ".jsonl").select("path", "mtime"), head=HEAD_BYTES)
    quoted = F.regexp_extract("text", r'"cwd"\s*:\s*"((?:[^"\\]|\\.)+)"', 1)
    cwd = F.try_element_at(F.from_json(F.concat(F.lit('["'), quoted, F.lit('"]')), "array<string>"), F.lit(1))
    return heads.select(cwd.alias("cwd"), "mtime").where("cwd <> '' AND cwd <> '.'")


def last_lines(files: DataFrame, tail: int = TAIL_BYTES) -> DataFrame:
    """(path, line) of the last tail bytes of each file."""
    return read_ranges(files.select("path"), tail=tail).where("text IS NOT NULL").select("path", F.explode(F.split("text", "\n")).alias("line"))
