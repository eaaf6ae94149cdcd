"""Writers: staged files that are swapped in together, an append-only log, and path guards."""

from __future__ import annotations

import fcntl
import json
import os
import threading
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK = threading.Lock()


class SinkError(ValueError):
    """An output cannot be written."""


def distinct_paths(*paths: str | Path | None) -> None:
    """Resolved paths must differ pairwise; None is left out."""
    given = [Path(p).resolve() for p in paths if p is not None]
    if len(set(given)) != len(given):
        raise SinkError("paths collide")


def both_or_neither(a: object, b: object, what: str) -> None:
    if (a is None) != (b is None):
        raise SinkError(f"{what} need both outputs or none")


class _Local:
    """Files of this machine."""

    def aside(self, target: str, name: str) -> None:
        os.link(target, name)  # the target stays readable until it is replaced

    def exists(self, path: str) -> bool:
        return Path(path).exists()

    def move(self, source: str, target: str) -> None:
        os.replace(source, target)

    def remove(self, path: str) -> None:
        Path(path).unlink(missing_ok=True)

    def write(self, path: str, text: str) -> None:
        Path(path).write_text(text)


class _Shared:
    """Files of any store that Spark reads and writes."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def aside(self, target: str, name: str) -> None:
        self.move(target, name)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def move(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        if not fs.rename(p, self._at(target)[1]):
            raise SinkError(f"{source} cannot be moved to {target}")

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def parts(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return [x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName().startswith("part-")]


def _store(path: str | Path) -> _Local | _Shared:
    """Where a path lies: with a scheme or another default store than local files, in what Spark writes to."""
    spark = SparkSession.getActiveSession()
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///") if spark else "file:///"
    return _Shared(spark) if "://" in str(path) or not default.startswith("file:") else _Local()


def exists(path: str | Path) -> bool:
    return _store(path).exists(str(path))


def _beside(path: str | Path, ending: str) -> str:
    folder, _, name = str(path).rpartition("/")
    return f"{folder}/.{name}.{uuid.uuid4().hex[:8]}{ending}" if folder else f".{name}.{uuid.uuid4().hex[:8]}{ending}"


def stage_json_lines(df: DataFrame, path: str | Path, order: Sequence[str] = (), hide: Sequence[str] = ()) -> str:
    """Write a result as JSON lines to a file beside ``path``: in order if one is given, nulls included, without the hidden columns.

    One task sorts (and spills) and writes the file where it stays, in the store of ``path``; then it is renamed, so nothing passes through the driver.
    If the task fails, or its file cannot be seen from here, that is an error and nothing is left behind.
    """
    shared, store = _Shared(df.sparkSession), _store(path)
    local = isinstance(store, _Local)
    target = str(Path(path).absolute()) if local else str(path)
    folder, out = _beside(target, ""), _beside(target, ".staged")
    rows = df.repartition(1)
    rows = rows.sortWithinPartitions(*order) if order else rows
    lines = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in hide]), {"ignoreNullFields": "false"}).alias("value"))
    where = f"file://{folder}" if local else folder
    try:
        lines.write.text(where)
        parts = shared.parts(where)
        if len(parts) != 1:
            raise SinkError(f"{path}: {len(parts)} parts were written where one was expected")
        store.move(folder + "/" + parts[0].rpartition("/")[2] if local else parts[0], out)
    finally:
        shared.remove(where)
    return out


def stage_text(text: str, path: str | Path) -> str:
    out = _beside(path, ".staged")
    _store(path).write(out, text)
    return out


def commit(staged: Sequence[tuple[str | Path, str | Path]], swap: Callable[[Path, Path], None] | None = None) -> None:
    """Swap all staged files in; if one fails, those before get back what they held (or are removed).

    What a target held stays beside it under a second name until all are swapped, so nothing is copied.
    """
    before: list[tuple[_Local | _Shared, str, str | None]] = []
    try:
        for temp, target in staged:
            store, target = _store(target), str(target)
            old = _beside(target, ".before") if store.exists(target) else None
            if old is not None:
                store.aside(target, old)
            before.append((store, target, old))
            if swap:
                swap(Path(temp), Path(target))
            else:
                store.move(str(temp), target)
    except BaseException:
        for store, target, old in before:
            if old is None or isinstance(store, _Shared):  # elsewhere a rename does not replace
                store.remove(target)
            if old is not None:
                store.move(old, target)
        raise
    finally:
        for store, _, old in before:
            if old is not None:
                store.remove(old)
        for temp, target in staged:
            _store(target).remove(str(temp))


def append_record(path: str | Path, record: dict) -> None:
    """Append one line. A complete last record without a line end is kept, a partial one is cut off.

    Only the last line is read again. Threads take a lock, processes one on the file.
    """
    with _LOCK, Path(path).open("a+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        at = end = f.seek(0, os.SEEK_END)
        tail = b""
        while at and b"\n" not in tail:
            step = min(at, 1 << 16)
            at = f.seek(at - step)
            tail = f.read(step) + tail
        tail = tail.rpartition(b"\n")[2]
        if tail:
            try:
                json.loads(tail)
                f.write(b"\n")
            except ValueError:
                f.truncate(end - len(tail))
        f.write(json.dumps(record, ensure_ascii=False).encode() + b"\n")
