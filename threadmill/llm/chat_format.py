"""Chat formatting with typed content parts (DataFrame functions only).

A turn holds parts ``{kind, text, ref, units}``. A visitor flattens them in order: text parts are escaped and copied,
image, audio and document parts become numbered placeholders, and for each placeholder the attachment's
reference and the number of tokens it expands to are recorded. Turns are marked as

    ### role: body</turn>\\n

A backslash escapes ``\\``, ``#``, ``<`` and ``:`` (the last in roles only) inside roles and texts; in the output
an unescaped ``#`` or ``<`` can therefore only come from the template, and reading it back is exact.

Null texts and roles count as empty; null parts are skipped; turns are ordered by (turn, role, body), null turn
numbers first, so ties have one order; repeated rows are repeated turns; an empty table gives no rows; further
columns are ignored. A conversation with very many turns is joined from blocks of turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that one unit of an attachment expands to (an image tile, a second of sound, a page).
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"
OPEN, CLOSE = "### ", "</turn>\n"
BLOCK = 64


def escape(text: Column, more: str = "") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"([\\#<{more}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"), F.lit(None).cast("long").alias("units")))


def is_attachment(part: Column) -> Column:
    return part["kind"].isin(*TOKENS_PER_UNIT)


def attachments(parts: Column) -> Column:
    """``ord, kind, ref, tokens`` of the attachments of a turn, in order."""
    kinds = F.create_map(*[F.lit(x) for pair in TOKENS_PER_UNIT.items() for x in pair])
    return F.transform(
        F.filter(parts, is_attachment),
        lambda p, i: F.struct(
            (i + 1).cast("int").alias("ord"),
            p["kind"].alias("kind"),
            p["ref"].alias("ref"),
            (kinds[p["kind"]] * F.coalesce(p["units"], F.lit(1))).cast("long").alias("tokens"),
        ),
    )


def body(parts: Column) -> Column:
    """Flattened parts: escaped text and ``<kind:n>`` placeholders, n counting the attachments of the turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def visit(acc: Column, p: Column) -> Column:
        n = acc["n"] + F.when(is_attachment(p), 1).otherwise(0)
        mark = F.concat(F.lit("<"), p["kind"], F.lit(":"), n.cast("string"), F.lit(">"))
        piece = F.when(is_attachment(p), mark).otherwise(escape(p["text"]))
        return F.struct(F.concat(acc["out"], piece).alias("out"), n.cast("int").alias("n"))

    return F.aggregate(F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), start, visit)["out"]


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation from rows ``conv_id, turn, role, parts``.

    Returns ``conv_id, formatted, loss_spans, attachments, n_turns``. ``loss_spans`` is an array of ``start, length``
    in code points of ``formatted``: the bodies of the trained role. ``attachments`` carries the turn's place.
    """
    t = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        body(F.col("parts")).alias("body"),
        attachments(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))).alias("files"),
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ":"), F.lit(": "))
    t = t.withColumn("text", F.concat(head, "body", F.lit(CLOSE))).withColumn("head", F.length(head))
    item = F.struct(
        "turn", "role", "text", "head", F.length("text").alias("chars"), F.length("body").alias("body_chars"), "files"
    )
    blocks = t.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(item)).alias("turns")
    )
    start = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def span(acc: Column, x: Column) -> Column:
        own = F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["body_chars"].alias("length")))
        return F.struct(
            (acc["at"] + x["chars"]).alias("at"),
            F.when(x["role"] == trained_role, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"),
        )

    blocks = blocks.select(
        "conv_id",
        F.struct(
            "block",
            F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("text"),
            F.aggregate("turns", start(), span).alias("loss"),
            F.size("turns").alias("n"),
            F.flatten(F.transform("turns", lambda x, i: F.transform(x["files"], lambda f: F.struct((i + 1).alias("place"), f.alias("file"))))).alias("files"),
        ).alias("b"),
    )
    chats = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("bs"))

    def before(size: Callable[[Column], Column]) -> Column:
        """For each block the sum over those before it."""
        return F.aggregate("bs", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + size(b).cast("int"))))

    def moved(sums: Column, change: Callable[[Column, Column], Column]) -> Column:
        """Each block's entries, changed by what lies before it; the sums are bound by an outer function, so that they are formed once."""
        return F.transform(F.array(sums), lambda own: F.flatten(F.transform("bs", lambda b, i: change(b, own[i]))))[0]

    def spans(b: Column, at: Column) -> Column:
        return F.transform(b["loss"]["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length")))

    def files(b: Column, n: Column) -> Column:
        return F.transform(
            b["files"],
            lambda f: F.struct(
                (f["place"] + n).alias("turn_place"),
                f["file"]["ord"].alias("ord"),
                f["file"]["kind"].alias("kind"),
                f["file"]["ref"].alias("ref"),
                f["file"]["tokens"].alias("tokens"),
            ),
        )

    return chats.select(
        "conv_id",
        F.array_join(F.transform("bs", lambda b: b["text"]), "").alias("formatted"),
        moved(before(lambda b: b["loss"]["at"]), spans).alias("loss_spans"),
        moved(before(lambda b: b["n"]), files).alias("attachments"),
        F.aggregate("bs", F.lit(0).cast("long"), lambda n, b: n + b["n"]).alias("n_turns"),
    )


_TURN = r"(?s)### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n"


def read_turns(formatted: Column) -> Column:
    """Array of ``role, text`` read back from a formatted conversation."""
    found = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    return F.transform(
        found,
        lambda x: F.struct(
            unescape(F.regexp_extract(x, _TURN, 1)).alias("role"), unescape(F.regexp_extract(x, _TURN, 2)).alias("text")
        ),
    )


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    Spans are cut from the text in four bytes a code point, where a place is found without counting from the start; the
    inner function is over an array of that one value, so that it is formed once.
    """

    def cut(wide: Column) -> Column:
        return F.transform(spans, lambda s: unescape(F.decode(F.substr(wide, 4 * s["start"] + 1, 4 * s["length"]), "UTF-32")))

    return F.array_join(F.transform(F.array(F.encode(formatted, "UTF-32")), cut)[0], "")
