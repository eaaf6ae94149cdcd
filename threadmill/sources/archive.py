"""A ZIP of CSV files: safe extraction with a manifest, and CSV profiles."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import zipfile
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MOST_MEMBERS, MOST_BYTES = 10_000, 2 << 30
MANIFEST = ".threadmill-manifest.json"


class SourceError(ValueError):
    """A source cannot be read as it is."""


@dataclass(frozen=True)
class CsvProfile:
    path: str
    columns: list[str]
    rows: int


@dataclass(frozen=True)
class SourceReport:
    files: list[CsvProfile]
    extracted: bool


def signature(path: Path) -> dict:
    digest = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return {"size": path.stat().st_size, "sha256": digest.hexdigest()}


def check_members(archive: zipfile.ZipFile, into: Path) -> None:
    """Refuse too many members, too many bytes and names that leave the folder."""
    members = archive.infolist()
    if len(members) > MOST_MEMBERS:
        raise SourceError(f"more than {MOST_MEMBERS} members")
    if sum(m.file_size for m in members) > MOST_BYTES:
        raise SourceError(f"more than {MOST_BYTES} bytes uncompressed")
    top = into.resolve()
    for m in members:
        place = (top / m.filename).resolve()
        if place != top and top not in place.parents:
            raise SourceError(f"{m.filename} leaves the folder")


def csv_profile(spark: SparkSession, path: str) -> CsvProfile:
    """Columns and row count of a CSV file; rows must have as many fields as the header."""
    raw = spark.read.text(path).first()
    if raw is None or not raw[0].lstrip("﻿").strip():
        raise SourceError(f"{path} has no header")
    frame = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", inferSchema=False)
    columns = [c.lstrip("﻿") for c in frame.columns]
    header = spark.read.csv(path, header=False, multiLine=True, quote='"', escape='"').first()
    if any(c is None or not c.strip() for c in header):
        raise SourceError(f"{path} has a blank column name")
    schema = ", ".join(f"c{i} string" for i in range(len(columns))) + ", broken string"
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="broken")
    n, broken = rows.cache().agg(F.count("*"), F.count("broken")).first()
    rows.unpersist()
    if broken:
        raise SourceError(f"{path} has {broken} rows that do not fit the header")
    return CsvProfile(path, columns, n)


def read_source_archive(spark: SparkSession, archive: str | Path, folder: str | Path) -> SourceReport:
    """Extract the archive into a folder that this function manages, unless its manifest still holds."""
    archive, folder = Path(archive), Path(folder)
    if not archive.is_file():
        raise SourceError(f"{archive} does not exist")
    if folder.resolve() in archive.resolve().parents:
        raise SourceError("the folder contains the archive")
    manifest = folder / MANIFEST
    if folder.exists() and any(folder.iterdir()) and not manifest.is_file():
        raise SourceError(f"{folder} is not empty and not managed here")
    of_archive = signature(archive)
    if manifest.is_file():
        known = json.loads(manifest.read_text())
        names = {str(p.relative_to(folder)) for p in folder.rglob("*.csv")}
        if known["archive"] == of_archive and names == set(known["files"]) and all(signature(folder / n) == s for n, s in known["signatures"].items()):
            return SourceReport([CsvProfile(**known["files"][n]) for n in sorted(known["files"])], False)
    folder.parent.mkdir(parents=True, exist_ok=True)
    fresh = Path(tempfile.mkdtemp(dir=folder.parent))
    try:
        try:
            with zipfile.ZipFile(archive) as z:
                check_members(z, fresh)
                z.extractall(fresh)
        except zipfile.BadZipFile as e:
            raise SourceError(f"{archive} is not a readable archive") from e
        names = sorted(str(p.relative_to(fresh)) for p in fresh.rglob("*.csv"))
        if not names:
            raise SourceError(f"{archive} holds no CSV file")
        files = {n: CsvProfile(n, (p := csv_profile(spark, str(fresh / n))).columns, p.rows) for n in names}
        content = {"archive": of_archive, "signatures": {n: signature(fresh / n) for n in names}, "files": {n: asdict(f) for n, f in files.items()}}
        (fresh / MANIFEST).write_text(json.dumps(content))
        old = None
        if folder.exists():
            old = folder.with_name(f".{folder.name}.old")
            os.replace(folder, old)
        os.replace(fresh, folder)
        if old:
            shutil.rmtree(old)
    finally:
        shutil.rmtree(fresh, ignore_errors=True)
    return SourceReport([files[n] for n in names], True)
