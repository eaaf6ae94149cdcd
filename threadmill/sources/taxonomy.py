"""Taxonomies in Markdown (some dozen rows, parsed on the driver) as small tables with their order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.contracts import ContractError, decision, gate, unique
from ..functions.fixed_values import TAXONOMY_SIZES

_ID = re.compile(r"^`([a-z][a-z0-9_]*)`$")


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def _table(text: str, header: list[str], empty_ok: bool) -> list[list[str]]:
    """Rows of the table with exactly this header; it ends at the first line without a pipe."""
    lines = text.splitlines()
    at = next((i for i, line in enumerate(lines) if line.lstrip().startswith("|") and [c.lower() for c in _cells(line)] == [h.lower() for h in header]), None)
    if at is None:
        raise ContractError(f"no table with the columns {', '.join(header)}")
    rows = []
    for line in lines[at + 2 :]:
        if not line.lstrip().startswith("|"):
            break
        if len(cells := _cells(line)) != len(header):
            raise ContractError(f"a row of the table {header[0]} has {len(cells)} cells")
        rows.append(cells)
    if not rows and not empty_ok:
        raise ContractError(f"the table {', '.join(header)} is empty")
    return rows


def _intent(cell: str) -> str:
    if not (m := _ID.match(cell)):
        raise ContractError(f"{cell} is not an intent id in backticks")
    return m[1]


def seed_taxonomy(spark: SparkSession, text: str) -> DataFrame:
    """``ord, intent_id, definition, representative_message``: numbered table rows and one representative bullet each."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        if line.lstrip().startswith("|") and len(cells := _cells(line)) == 4 and cells[0].isdigit() and (m := _ID.match(cells[1])):
            if m[1] in found:
                raise ContractError(f"duplicate intent {m[1]}")
            found[m[1]] = cells[2]
    said: dict[str, str] = {}
    for m in re.finditer(r"^\s*[-*] `([a-z][a-z0-9_]*)`[:\s]+(.+?)\s*$", text, re.M):
        if m[1] not in found or m[1] in said:
            raise ContractError(f"unknown or repeated representative of {m[1]}")
        said[m[1]] = m[2].strip().strip('"“”')
    if not found or set(found) != set(said):
        raise ContractError(f"no representative for {', '.join(sorted(set(found) - set(said))) or 'any intent'}")
    rows = [(i, k, d, said[k]) for i, (k, d) in enumerate(found.items())]
    return spark.createDataFrame(rows, "ord int, intent_id string, definition string, representative_message string")


def final_taxonomy(spark: SparkSession, text: str, intents: list[str], seeds: list[str], themes: list[str]) -> dict[str, DataFrame | int]:
    """``version``, ``intents``, ``seed_decisions`` and ``theme_decisions``; the lists name the tables' columns.

    The intents table has id, definition, origin and examples separated by ``;`` or ``<br>``.
    """
    versions = re.findall(r"^\*\*Version:\*\*\s*(\d+)", text, re.M)
    if len(versions) != 1 or int(versions[0]) < 1:
        raise ContractError("exactly one version line is needed")
    rows = [(i, _intent(c[0]), c[1], c[2], [e.strip().strip('"“”') for e in re.split(r";|<br ?/?>", c[3]) if e.strip()]) for i, c in enumerate(_table(text, intents, False))]
    ids = [r[1] for r in rows]
    examples = [e for r in rows for e in r[4]]
    if not TAXONOMY_SIZES[0] <= len(rows) <= TAXONOMY_SIZES[1]:
        raise ContractError(f"a taxonomy has {TAXONOMY_SIZES[0]} to {TAXONOMY_SIZES[1]} intents")
    if len(set(ids)) != len(ids) or "other" not in ids:
        raise ContractError("intents must be unique and include other")
    if not all(r[4] for r in rows) or len(set(examples)) != len(examples):
        raise ContractError("every intent needs examples of its own")
    target = lambda c: None if c in ("", "-", "—") else _intent(c)
    kinds = "subject string, decision string, final_intent string"
    of_seeds = spark.createDataFrame([(_intent(c[0]), c[1].lower(), target(c[2])) for c in _table(text, seeds, False)], kinds)
    of_themes = spark.createDataFrame([(c[0], c[1].lower(), target(c[2])) for c in _table(text, themes, True)], kinds)
    for table in (of_seeds, of_themes):
        gate(table.where(decision().isNotNull() | (table.final_intent.isNotNull() & ~table.final_intent.isin(*ids))), "decisions that break their contract", "subject")
        unique(table, "subject", "decisions")
    frame = spark.createDataFrame(rows, "ord int, intent_id string, definition string, origin string, examples array<string>")
    return {"version": int(versions[0]), "intents": frame, "seed_decisions": of_seeds, "theme_decisions": of_themes}
