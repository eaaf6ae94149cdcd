"""The operators of this subpackage applied to whole tables with production parameters, and their SQL."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, exact_dedup, hard_negatives, lattice_lm, mix_sources, quality_fm, rans_tokens, recompress_dedup, simhash_dedup, structure_repair, suffix_dedup
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, _table(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write all documents in the token format and read the files back."""
    import public_tokenizers

    folder = Scratch(spark, "token-files").path("corpus")
    rans_tokens.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return rans_tokens.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    judged = index.add(_table(spark, sf_dir, "documents"))
    index.close()  # the result reads written tables only
    return judged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_recompress_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress_dedup.dedup(_table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(_table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    rows = rows.unionByName(own.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]))
    chats = chat_format.format_chats(rows.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts")))
    chats = Scratch(spark, "chat").put(chats, "formatted")
    turns = chat_format.read_turns(F.col("formatted"))
    loss = chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans"))
    read = chats.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def held_out(folds: int) -> Column:
    """Whether a document is held out from learning: crc32(doc_id as text) mod folds is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_fm.train(docs, labels, learn=~held_out(5))
    scored = quality_fm.score(docs.select("doc_id", "text", "n_chars"), model).select("row.doc_id", "score")
    return scored.select("doc_id", held_out(5).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice_lm.score(_table(spark, sf_dir, "documents"), ~held_out(10), public_tokenizers.path("piece_bpe_32k.model"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.groups(_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    made = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the contract's damage, by crc32(conv_id:turn) % 20: rows dropped, emptied, cut off, repeated, given to the user."""
    part: Callable[[str], Column] = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lines of consecutive runs of one conversation, a run at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    digest, begun = hashlib.sha256(), False
    for batch in batches:
        for at in range(batch.num_rows):
            conv, run, runs, lines = (c[at].as_py() for c in batch.columns)
            if run == 0:
                digest, begun = hashlib.sha256(), False
            if lines is not None:
                digest.update((b"\n" if begun else b"") + lines.encode())
                begun = True
            if run == runs - 1:
                yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    made = structure_repair.repair(damaged(rows))
    line = F.array_join(F.transform("kept", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = made.turns.where("runs = 1").select("conv_id", F.sha2(line, 256).alias("repaired_sha256"))
    runs = made.turns.where("runs > 1").select("conv_id", "run", "runs", F.when(F.size("kept") > 0, line).alias("lines"))
    runs = runs.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "run").mapInArrow(_hashed_runs, "conv_id long, repaired_sha256 string")
    digests = whole.unionByName(runs).withColumnRenamed("conv_id", "id")
    asked = rows.select("conv_id").distinct()
    reports = made.reports.withColumnRenamed("conv_id", "own")
    found = asked.join(reports, F.col("conv_id").eqNullSafe(F.col("own")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(vectors, F.col("id") % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.append(top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality_fm": op2_quality_fm,
    "op3_rans_tokens": op3_rans_tokens,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_recompress_dedup": op6_recompress_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_lattice_lm": op9_lattice_lm,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_bpe": op11_bpe,
    "op12_structure_repair": op12_structure_repair,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY text)""",
    "op5_mix_sources": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3) AS salt FROM documents),
        s AS (SELECT source, sum(size)::DOUBLE AS source_size,
                     ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
              FROM d GROUP BY source),
        -- fill to the caps again and again: what is above its cap stops there, the rest is shared anew
        fill AS (
            SELECT 0 AS round, source, source_size, weight, false AS capped,
                   sum(source_size) OVER () * weight / sum(weight) OVER () AS target FROM s
            UNION ALL
            SELECT round + 1, source, source_size, weight, capped OR target >= 3 * source_size,
                   CASE WHEN capped OR target >= 3 * source_size THEN 3 * source_size
                        ELSE (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped OR target >= 3 * source_size) OVER (), 0))
                             * weight / sum(weight) FILTER (NOT (capped OR target >= 3 * source_size)) OVER () END
            FROM fill WHERE round < 30),
        t AS (SELECT source, source_size, target,
                     ('0x' || substr(sha256('7:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u0,
                     CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM fill WHERE round = 30),
        r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.u0, t.rate, t.rate - floor(t.rate) AS part,
                     row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.salt, d.doc_id) AS k
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        o AS (SELECT r.*, j, u0 + j / 16.0::DOUBLE - floor(u0 + j / 16.0::DOUBLE) AS u FROM r, range(0, 16) x(j)),
        c AS (SELECT *, (size * (floor(rate) + least(1, floor(k * part + u) - floor((k - 1) * part + u))))::BIGINT AS taken FROM o),
        -- of sixteen offsets the one that comes nearest to the target
        e AS (SELECT source, j, abs(sum(taken) - any_value(target)) AS error FROM c GROUP BY source, j),
        b AS (SELECT source, arg_min(j, (error, j)) AS j FROM e GROUP BY source)
        SELECT c.doc_id, c.size, c.source_size::BIGINT AS source_size, c.target, c.taken FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.j = b.j""",
    "op6_recompress_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
        twice AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM g WHERE k IN (SELECT k FROM twice)),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
        SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, unnest(range(1, length(h) // 2 + 1)) AS i, h FROM d),
        g AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS byte, CASE WHEN i + 99 <= length(h) // 2 THEN md5(substr(h, 2 * i - 1, 200)) END AS k FROM b),
        later AS (SELECT doc_id, i, byte, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM g),
        c AS (SELECT doc_id, i, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM later),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
        s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY 1)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN s USING (doc_id)""",
    "op8_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        e AS (SELECT *, regexp_replace(text, '([\\#<])', '\\\1', 'g') AS body, regexp_replace(role, '([\\#<:])', '\\\1', 'g') AS head FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op13_hard_negatives": """
        WITH r AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.k AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
              FROM r a JOIN r b ON a.k <> b.k WHERE a.vec_id % 50 = 0),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
                     s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
              FROM p JOIN s ON p.a = s.a AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score)
        SELECT * FROM n WHERE rank <= 3""",
}
