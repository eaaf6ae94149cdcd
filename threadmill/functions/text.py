"""Text predicates, normalisation, hashes and JSON extraction as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

#: Case-insensitive in Unicode, Unicode classes, and only a line feed ends a line: how the patterns are meant.
FLAGS = "(?iuUd)"
_EDGE = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"


def java(pattern: str) -> str:
    """A pattern in the engine's dialect; word edges are spelled out, since combining marks are no word characters here."""
    return FLAGS + pattern.replace(r"\b", _EDGE)


def has(text: Column, name: str) -> Column:
    return text.rlike(java(V.PATTERNS[name]))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_apostrophes(text: Column) -> Column:
    return F.translate(text, V.APOSTROPHES, "'" * len(V.APOSTROPHES))


def clean(text: Column) -> Column:
    """Links, then handles, each as a space."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)" + V.URL, " "), "(?U)" + V.MENTION, " ")


def mentions(text: Column, brand: str) -> Column:
    """Whether the whole handle of the brand occurs."""
    handle = r"\Q@" + brand.lower().replace("\\E", "") + r"\E"
    return F.lower(text).rlike(handle + r"(?![\p{L}\p{N}_])")


def acknowledges(text: Column) -> Column:
    """A claim that it works now, or a thank-you that is nearly the whole message."""
    t = plain_apostrophes(text)
    short = F.length(strip(clean(t))) <= V.ACK_LENGTH
    return ~has(t, "negated_fix") & (has(t, "fixed") | (~has(t, "thanks_anyway") & has(t, "ack") & short))


def continues(text: Column) -> Column:
    t = plain_apostrophes(text)
    return has(t, "continuation") | has(t, "negated_fix")


def json_object(reply: Column) -> Column:
    """The JSON object in a reply as text: the whole of it without code fences, else its first ``{`` to last ``}``."""
    bare = strip(F.regexp_replace(strip(reply), r"(?i)^```(?:json)?\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    as_object = lambda c: F.when(F.get_json_object(c, "$").startswith("{") & F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), c)
    return F.coalesce(as_object(bare), as_object(inner))


def prompt_hash(system: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(system, F.lit("\n\n"), prompt), 256)


def hash_rank(seed: int, key: Column) -> Column:
    """The digest that orders a reproducible sample."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def transcript(turns: Column) -> Column:
    """``side text`` lines with time, the side padded to eight characters."""
    line = lambda t: F.concat(F.lpad(t["side"], 8, " "), F.lit(" "), F.date_format(t["created_at"], "yyyy-MM-dd HH:mm"), F.lit("  "), t["text"])
    return F.array_join(F.transform(turns, line), "\n")


def keyword_answer(message: Column) -> Column:
    """The first keyword rule that matches, else the fallback: ``intent, confidence, evidence, decision, reply, reason``."""

    def row(intent: str, confidence: float, evidence: tuple[str, ...], decision: str) -> Column:
        reply, reason = V.KEYWORD_REPLIES[intent]
        told = [F.lit(decision).alias("decision"), F.lit(reply).alias("reply"), F.lit(reason).alias("reason")]
        return F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"), F.array(*map(F.lit, evidence)).alias("evidence"), *told)

    out = None
    for pattern, *result in V.KEYWORD_RULES:
        hit = strip(message).rlike("(?i)" + pattern)
        out = F.when(hit, row(*result)) if out is None else out.when(hit, row(*result))
    return out.otherwise(row(*V.KEYWORD_FALLBACK))


def re2(name: str) -> str:
    """A pattern for engines without lookahead; the exclusion of a refusal is to be tested apart."""
    return "(?i)" + re.sub(r"\(\?! .*?\)\)", "", V.PATTERNS[name])
