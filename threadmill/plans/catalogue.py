"""Each operator over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts, text
from ..functions import fixed_values as V
from ..operators import closure, golden, hybrid, labels, language, lexical, metrics, reconcile, resolution, sampling, stitch, vector_index, vectors
from ..sources import records
from ..streaming import verdicts as streams
from .fixture import BRAND, MESSAGES, TWEETS, quoted
from .staging import stage_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def entry(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for what an entry writes and opens again."""
    return f"{stage_root(spark)}/threadmill/{name}-{uuid.uuid4().hex[:12]}"


def projected(spark: SparkSession, sf: str, cte: str, name: str) -> DataFrame:
    return spark.sql(f"WITH {cte} SELECT * FROM {name}".replace("FROM conversations c", "FROM {conversations} c"), conversations=table(spark, sf, "conversations"))


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    return projected(spark, sf, TWEETS, "tweets").withColumn("created_at", F.timestamp_seconds("created_at"))


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations of the fixture that begin with a customer's message, as nested turns."""
    m = projected(spark, sf, MESSAGES, "messages")
    turn = F.struct("turn", "side", "text")
    rows = m.groupBy(F.col("conv_id").alias("interaction_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.where(F.element_at("turns", 1)["side"] == "customer")


def closure_rows(spark: SparkSession, sf: str) -> DataFrame:
    return closure.label_interactions(interactions(spark, sf))


def verdicts(flagged: DataFrame) -> DataFrame:
    """A stand-in for a model: a label by the row's id."""
    pick = F.element_at(F.array(*map(F.lit, V.CLOSURE_LABELS)), (F.col("interaction_id") % 3 + 1).cast("int"))
    return flagged.select("interaction_id", pick.alias("label"), F.lit("read again").alias("reason"), F.concat(F.lit("m"), (F.col("interaction_id") % 2).cast("string")).alias("model"))


def final_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = closure_rows(spark, sf)
    return resolution.merge_verdicts(c, verdicts(c.where("needs_adjudication")))


# ---- reply graph

_PARENT = f"WITH {TWEETS}"
_SEEDS = f"""{TWEETS},
    answered AS (SELECT DISTINCT parent_id AS tweet_id FROM tweets WHERE author_id = 'brand' AND parent_id IN (SELECT tweet_id FROM tweets)),
    seeds AS (SELECT t.tweet_id, t.author_id FROM tweets t LEFT JOIN tweets p ON p.tweet_id = t.parent_id
        WHERE t.inbound AND t.author_id <> 'brand' AND (regexp_matches(lower(t.text), '@brand([^a-z0-9_]|$)')
              OR t.tweet_id IN (SELECT tweet_id FROM answered) OR coalesce(p.author_id = 'brand', false)))"""
_CLIMB = f"""{_SEEDS},
    climb AS (
        SELECT tweet_id AS seed, author_id AS author, tweet_id AS cur, tweet_id AS opening, 0 AS depth FROM seeds
        UNION ALL
        SELECT c.seed, c.author, p.tweet_id, CASE WHEN p.author_id = 'brand' THEN c.opening ELSE p.tweet_id END, c.depth + 1
        FROM climb c JOIN tweets x ON x.tweet_id = c.cur JOIN tweets p ON p.tweet_id = x.parent_id
        WHERE p.author_id = 'brand' OR (p.author_id = c.author AND p.tweet_id IN (SELECT tweet_id FROM seeds))),
    openings AS (SELECT seed, arg_max(opening, depth) AS opening FROM climb GROUP BY seed)"""
_GROW = f"""{_CLIMB},
    dyads AS (
        SELECT DISTINCT o.opening, t.author_id AS customer, o.opening AS tweet_id FROM openings o JOIN tweets t ON t.tweet_id = o.opening
        UNION ALL
        SELECT d.opening, d.customer, t.tweet_id FROM dyads d JOIN tweets t ON t.parent_id = d.tweet_id WHERE t.author_id IN (d.customer, 'brand'))"""
_STITCH = f"""{_GROW},
    inner_openings AS (SELECT DISTINCT tweet_id AS opening FROM dyads WHERE tweet_id <> opening AND tweet_id IN (SELECT opening FROM dyads)),
    kept AS (SELECT d.*, t.author_id, t.created_at, t.text FROM dyads d JOIN tweets t USING (tweet_id) WHERE d.opening NOT IN (SELECT opening FROM inner_openings)),
    made AS (SELECT opening AS interaction_id, customer AS customer_id, count(*) AS n_turns, count(*) FILTER (author_id = 'brand') AS brand_turns,
        string_agg(tweet_id::VARCHAR, ',' ORDER BY created_at, tweet_id) AS turn_ids, string_agg(text, '|' ORDER BY created_at, tweet_id) AS texts
        FROM kept GROUP BY ALL HAVING count(*) FILTER (author_id = 'brand') > 0)"""


@entry(f"{_PARENT} SELECT t.tweet_id, t.parent_id, p.author_id AS parent_author, p.tweet_id IS NOT NULL AS parent_exists FROM tweets t LEFT JOIN tweets p ON p.tweet_id = t.parent_id")
def parent_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return stitch.parents(tweets(spark, sf))


@entry(f"WITH {TWEETS} SELECT DISTINCT p.tweet_id FROM tweets t JOIN tweets p ON p.tweet_id = t.parent_id WHERE t.author_id = 'brand'")
def brand_replied_to(spark: SparkSession, sf: str) -> DataFrame:
    return stitch.replied_to(tweets(spark, sf), BRAND)


@entry(f"WITH {TWEETS} SELECT tweet_id, regexp_matches(lower(text), '@brand([^a-z0-9_]|$)') AS mentioned FROM tweets")
def mention_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return tweets(spark, sf).select("tweet_id", text.mentions(F.col("text"), BRAND).alias("mentioned"))


@entry(f"WITH {_SEEDS} SELECT tweet_id, author_id FROM seeds")
def seed_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return stitch.seeds(tweets(spark, sf), BRAND)


@entry(f"WITH RECURSIVE {_CLIMB} SELECT seed, opening FROM openings")
def climb_openings(spark: SparkSession, sf: str) -> DataFrame:
    return stitch.climb(tweets(spark, sf), BRAND)


@entry(f"WITH RECURSIVE {_GROW} SELECT opening, tweet_id FROM dyads")
def grow_dyads(spark: SparkSession, sf: str) -> DataFrame:
    t = tweets(spark, sf)
    return stitch.grow(t, stitch.climb(t, BRAND).select("opening").distinct(), BRAND)


@entry(f"WITH RECURSIVE {_STITCH} SELECT opening FROM inner_openings")
def absorbed_openings(spark: SparkSession, sf: str) -> DataFrame:
    return stitch.absorbed(grow_dyads(spark, sf))


@entry(f"WITH RECURSIVE {_STITCH} SELECT interaction_id, customer_id, n_turns, turn_ids, sha256(texts) AS texts_sha256 FROM made")
def stitch_interactions(spark: SparkSession, sf: str) -> DataFrame:
    made = stitch.stitch(tweets(spark, sf), BRAND)
    each = lambda f: F.transform("turns", lambda t: t[f].cast("string"))
    return made.select("interaction_id", "customer_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(each("tweet_id"), ",").alias("turn_ids"), F.sha2(F.array_join(each("text"), "|"), 256).alias("texts_sha256"))


@entry(f"""WITH RECURSIVE {_STITCH}, o AS (SELECT DISTINCT opening FROM openings)
    SELECT total_rows, inbound_rows, brand_rows, seed_count, opening_count, absorbed_openings, interactions,
           opening_count - absorbed_openings - interactions AS unanswered_openings, turns_total, turns_total - turns_brand AS turns_customer, turns_brand
    FROM (SELECT count(*) AS total_rows, count(*) FILTER (inbound) AS inbound_rows, count(*) FILTER (author_id = 'brand') AS brand_rows FROM tweets),
         (SELECT count(*) AS seed_count FROM seeds), (SELECT count(*) AS opening_count FROM o), (SELECT count(*) AS absorbed_openings FROM inner_openings),
         (SELECT count(*) AS interactions, sum(n_turns)::BIGINT AS turns_total, sum(brand_turns)::BIGINT AS turns_brand FROM made)""")
def stitch_report(spark: SparkSession, sf: str) -> DataFrame:
    return stitch.stitch_report(tweets(spark, sf), BRAND)


# ---- texts and language


@entry(r"""SELECT page_id, regexp_replace(regexp_replace(concat(url, ' @someone ', html), 'https?://\S+|t\.co/\S+', ' ', 'g'), '@\w+', ' ', 'g') AS cleaned FROM pages""")
def text_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.clean(F.concat("url", F.lit(" @someone "), "html")).alias("cleaned"))


@entry(f"WITH {MESSAGES} SELECT conv_id, turn FROM messages WHERE NOT regexp_full_match(text, '\\s*')")
def blank_filter(spark: SparkSession, sf: str) -> DataFrame:
    return projected(spark, sf, MESSAGES, "messages").where(~text.is_blank(F.col("text"))).select("conv_id", "turn")


_LANG = "CASE lang WHEN 'en' THEN 'ENGLISH' WHEN 'fr' THEN 'FRENCH' WHEN 'de' THEN 'GERMAN' WHEN 'es' THEN 'SPANISH' END"


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(_LANG).alias("language"))


@entry(f"SELECT doc_id, {_LANG} AS language FROM documents WHERE coalesce({_LANG}, 'ENGLISH') = 'ENGLISH'")
def lang_filter(spark: SparkSession, sf: str) -> DataFrame:
    return language.keep(_languages(spark, sf))


@entry(f"SELECT {_LANG} AS language, count(*) AS n FROM documents WHERE {_LANG} <> 'ENGLISH' GROUP BY 1")
def lang_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return language.breakdown(_languages(spark, sf))


@entry(f"""SELECT count(*) AS total, count(*) FILTER (coalesce({_LANG}, 'ENGLISH') = 'ENGLISH') AS retained, count(*) FILTER (({_LANG}) IS NULL) AS no_signal,
    count(*) FILTER (coalesce({_LANG}, 'ENGLISH') <> 'ENGLISH') AS filtered, count(*) FILTER (coalesce({_LANG}, 'ENGLISH') <> 'ENGLISH') / count(*) AS filtered_rate FROM documents""")
def lang_report(spark: SparkSession, sf: str) -> DataFrame:
    return language.report(_languages(spark, sf))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the name of their language; a fifth of them is held out from learning."""
    held_out = F.col("doc_id") % 5 == 0
    return table(spark, sf, "documents").select("doc_id", "text", F.expr(_LANG).alias("language"), held_out.alias("held_out"))


@entry(f"""WITH words AS (SELECT {_LANG} AS language, concat(' ', unnest(regexp_extract_all(lower(text), '\\p{{L}}+')), ' ') AS w FROM documents WHERE ({_LANG}) IS NOT NULL),
    grams AS (SELECT language, substr(w, i, 3) AS gram, count(*) AS n FROM (SELECT language, w, unnest(range(1, length(w) - 1)) AS i FROM words) GROUP BY ALL),
    best AS (SELECT * FROM grams QUALIFY row_number() OVER (PARTITION BY language ORDER BY n DESC, encode(gram)) <= 400)
    SELECT language, gram, n, n / sum(n) OVER (PARTITION BY language) AS share FROM best""")
def lang_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent letter trigrams of each language."""
    return language.profiles(_labelled(spark, sf))


_CLEANED = r"regexp_replace(regexp_replace(text, 'https?://\S+|t\.co/\S+', ' ', 'g'), '@\w+', ' ', 'g')"
_GRAMS = "SELECT {c}, n, substr(CASE WHEN n = 1 THEN word ELSE ' ' || word || ' ' END, i, n) AS gram FROM (SELECT *, unnest(range(1, length(word) + CASE WHEN n = 1 THEN 1 ELSE 4 - n END)) AS i FROM {t}, range(1, 6) o(n))"
_SCORED = f"""docs AS (SELECT doc_id, doc_id % 5 = 0 AS held_out, {_LANG} AS language, regexp_extract_all(lower(coalesce({_CLEANED}, '')), '\\p{{L}}+') AS ws FROM documents),
    said AS (SELECT doc_id, held_out, language, unnest(ws) AS word FROM docs), taught AS (SELECT language, word, count(*) AS c FROM said WHERE NOT held_out AND language IS NOT NULL GROUP BY 1, 2),
    counts AS (SELECT language, n, gram, sum(c) AS c FROM ({_GRAMS.format(c="language, c", t="taught")}) GROUP BY 1, 2, 3),
    floors AS (SELECT language, n, ln(0.5 / (sum(c) + 0.5 * (any_value(v) + 1))) AS floor FROM counts JOIN (SELECT n, count(DISTINCT gram) AS v FROM counts GROUP BY 1) USING (n) GROUP BY 1, 2),
    kept AS (SELECT language, n, gram, ln((c + 0.5) / 0.5) AS gain FROM counts QUALIFY row_number() OVER (PARTITION BY language, n ORDER BY c DESC, encode(gram)) <= 5000),
    known AS (SELECT DISTINCT word FROM said), grams AS ({_GRAMS.format(c="word", t="known")}),
    parts AS (SELECT word, language, count(*) * any_value(floor) AS x FROM grams JOIN floors USING (n) GROUP BY word, n, language UNION ALL SELECT word, language, gain FROM grams JOIN kept USING (n, gram)),
    words AS (SELECT word, language, sum(x) / 5 AS x FROM parts GROUP BY 1, 2), scored AS (SELECT doc_id, w.language, sum(x) AS score FROM said JOIN words w USING (word) GROUP BY 1, 2)"""


def _messages(spark: SparkSession, sf: str) -> tuple[DataFrame, language.Model]:
    docs = _labelled(spark, sf)
    return docs.select(F.col("doc_id").alias("interaction_id"), F.col("text").alias("message")), language.train(docs.where("not held_out"))


@entry(f"WITH {_SCORED} SELECT doc_id AS interaction_id, language, round(score, 4) AS score FROM scored")
def lang_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's log-likelihood in every language, by the n-grams of the documents that are not held out."""
    return language.scores(*_messages(spark, sf)).select("interaction_id", "language", F.round("score", 4).alias("score"))


@entry(f"""WITH {_SCORED}, tops AS (SELECT doc_id, max(score) AS top, list(score ORDER BY score DESC) AS s, arg_max(language, (score, language)) AS best FROM scored GROUP BY 1),
    sure AS (SELECT doc_id, best FROM tops WHERE (1 - exp(s[2] - top)) / list_sum(list_transform(s, lambda x: exp(x - top))) >= 0.25)
    SELECT docs.doc_id AS interaction_id, best AS language FROM docs LEFT JOIN sure USING (doc_id)""")
def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's language, where one leads."""
    return language.detect(*_messages(spark, sf))


# ---- samples

_RANK = "sha256(concat('42:', o_orderkey::VARCHAR))"


@entry(f"SELECT o_orderkey FROM orders ORDER BY {_RANK}, o_orderkey LIMIT 4000")
def hash_rank_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf, "orders").select("o_orderkey"), V.SAMPLE_SIZE, key="o_orderkey")


@entry(f"""WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_RANK}, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CASE WHEN r <= CASE WHEN n < 4000 THEN n * 1000 // 4000 ELSE 1000 END THEN 'holdout' ELSE 'pool' END AS split FROM s WHERE r <= 4000""")
def sample_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_split(table(spark, sf, "orders").select("o_orderkey"), key="o_orderkey")


@entry("""WITH s AS (SELECT n_nationkey, row_number() OVER (ORDER BY sha256(concat('42:', n_nationkey::VARCHAR)), n_nationkey) AS r, count(*) OVER () AS n FROM nation)
    SELECT n_nationkey, CASE WHEN r <= n * 15 // 40 THEN 'holdout' ELSE 'pool' END AS split FROM s""")
def small_input_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_split(table(spark, sf, "nation").select("n_nationkey"), 40, 15, key="n_nationkey")


@entry(f"""WITH {MESSAGES}, f AS (SELECT conv_id AS interaction_id, arg_min(text, turn) AS message, arg_min(side, turn) AS side FROM messages GROUP BY 1)
    SELECT interaction_id, message FROM f WHERE side = 'customer' AND NOT regexp_full_match(message, '\\s*') ORDER BY sha256(concat('42:', interaction_id::VARCHAR)), interaction_id LIMIT 500""")
def dev_slice(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.dev_slice(stitch.opening_text(interactions(spark, sf))).select("interaction_id", "message")


# ---- closure


def _m(column: str, name: str) -> str:
    return f"regexp_matches({column}, {quoted(text.re2(name))})"


def _closure_sql() -> str:
    refused = "(?i)" + V.PATTERNS["refusal"].replace(r"we (?:can'?t|cannot|won'?t)(?! (?:wait|thank|recommend))|", "")
    refusal = f"(regexp_matches(t, {quoted(refused)}) OR (regexp_matches(t, {quoted("(?i)we (?:can'?t|cannot|won'?t)")}) AND NOT regexp_matches(t, {quoted("(?i)we (?:can'?t|cannot|won'?t) (?:wait|thank|recommend)")})))"
    bare = lambda c: f"trim(regexp_replace(regexp_replace({c}, {quoted(V.URL)}, ' ', 'g'), {quoted(V.MENTION)}, ' ', 'g'))"
    acks = lambda c: f"(NOT {_m(c, 'negated_fix')} AND ({_m(c, 'fixed')} OR (NOT {_m(c, 'thanks_anyway')} AND {_m(c, 'ack')} AND length({bare(c)}) <= 72)))"
    goes = lambda c: f"({_m(c, 'continuation')} OR {_m(c, 'negated_fix')})"
    r = lambda k: quoted(V.REASONS[k])
    plain = "translate({}, '’‘`´', '''''''''')"
    return f"""WITH {MESSAGES},
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM messages),
    closings AS (SELECT conv_id AS interaction_id, arg_max(side, i) AS last_side, arg_max(text, i) AS last_text, arg_max(text, i) FILTER (side = 'customer') AS customer_text,
        coalesce(max(i) FILTER (side = 'customer') = 0, false) AS customer_is_opening, arg_max(text, i) FILTER (side = 'brand' AND i < n - 1) AS brand_text
        FROM n GROUP BY 1 HAVING arg_min(side, i) = 'customer'),
    p AS (SELECT *, {plain.format("last_text")} AS t, {plain.format("customer_text")} AS c, {plain.format("brand_text")} AS b FROM closings),
    judged AS (SELECT interaction_id, CASE WHEN last_side = 'customer' THEN CASE
            WHEN {_m("t", "dm_reply")} THEN {r("customer_dm")} WHEN {goes("t")} THEN {r("customer_continues")} WHEN NOT {acks("t")} THEN {r("customer_unclear")}
            WHEN coalesce({_m("b", "deflection")}, false) AND NOT {_m("t", "fixed")} THEN {r("customer_dm_ack")} ELSE {r("customer_resolved")} END
        ELSE CASE WHEN {_m("t", "completion")} THEN {r("brand_completion")} WHEN {_m("t", "deflection")} THEN {r("brand_dm")} WHEN {refusal} THEN {r("brand_refusal")}
            WHEN coalesce(NOT customer_is_opening AND NOT {goes("c")} AND {acks("c")}, false) AND NOT {_m("t", "followup")} AND (NOT {_m("t", "question")} OR {_m("t", "soft_invite")}) THEN {r("brand_ack_close")}
            WHEN {_m("t", "followup")} THEN {r("brand_followup")} WHEN {_m("t", "question")} THEN {r("brand_question")} ELSE {r("brand_silence")} END END AS reason FROM p),
    closure AS (SELECT interaction_id, CASE WHEN reason IN ({r("customer_resolved")}, {r("brand_completion")}, {r("brand_ack_close")}) THEN 'resolved'
            WHEN reason IN ({r("customer_continues")}, {r("brand_refusal")}) THEN 'unresolved' WHEN reason IN ({r("brand_question")}, {r("brand_followup")}, {r("brand_silence")}) THEN 'uncertain' END AS label,
        reason, reason IN ({", ".join(r(k) for k in V.FLAGS)}) AS needs_adjudication FROM judged)"""


_CLOSURE = _closure_sql()
_FINAL = f"""{_CLOSURE},
    final AS (SELECT interaction_id, label, 'heuristic' AS source, reason, NULL::VARCHAR AS flag_reason, NULL::VARCHAR AS model FROM closure WHERE NOT needs_adjudication
        UNION ALL SELECT interaction_id, ['resolved', 'uncertain', 'unresolved'][interaction_id % 3 + 1], 'labeler', 'read again', reason, concat('m', interaction_id % 2) FROM closure WHERE needs_adjudication)"""


@entry(f"{_CLOSURE} SELECT * FROM closings")
def closing_turns(spark: SparkSession, sf: str) -> DataFrame:
    return closure.closing_turns(interactions(spark, sf))


@entry(f"{_CLOSURE} SELECT * FROM closure")
def closure_labels(spark: SparkSession, sf: str) -> DataFrame:
    return closure_rows(spark, sf)


@entry(f"""{_CLOSURE} SELECT count(*) AS total, count(*) FILTER (label = 'resolved') AS resolved, count(*) FILTER (label = 'uncertain') AS uncertain, count(*) FILTER (label = 'unresolved') AS unresolved,
    count(*) FILTER (needs_adjudication) AS flagged, count(label) / count(*) AS label_rate, count(*) FILTER (needs_adjudication) / count(*) AS adjudication_rate FROM closure""")
def closure_report(spark: SparkSession, sf: str) -> DataFrame:
    return closure.closure_report(closure_rows(spark, sf))


@entry(f"{_CLOSURE} SELECT reason, count(*) AS n FROM closure WHERE needs_adjudication GROUP BY 1")
def flagged_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    return closure.flagged_by_reason(closure_rows(spark, sf))


@entry(f"{_CLOSURE} SELECT reason, label, count(*) AS n FROM closure GROUP BY 1, 2")
def closure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return closure_rows(spark, sf).groupBy("reason", "label").agg(F.count("*").alias("n"))


@entry(f"WITH {MESSAGES} SELECT conv_id AS interaction_id, count(*) FILTER (side = 'customer') AS customer_turns, count(*) FILTER (side = 'brand') AS brand_turns FROM messages GROUP BY 1 HAVING arg_min(side, turn) = 'customer'")
def turn_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stitch.turn_counts(interactions(spark, sf))


@entry(f"{_FINAL} SELECT * FROM final")
def adjudicated_merge(spark: SparkSession, sf: str) -> DataFrame:
    return final_rows(spark, sf)


@entry(f"{_FINAL} SELECT source, label, count(*) AS n FROM final GROUP BY GROUPING SETS ((label), (source, label))")
def adjudication_report(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.adjudication_report(final_rows(spark, sf))


@entry(f"{_FINAL} SELECT model, min(interaction_id) AS first FROM final WHERE model IS NOT NULL GROUP BY 1")
def models_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.models_in_order(final_rows(spark, sf), "interaction_id")


@entry(f"{_FINAL} SELECT interaction_id, label, source, retrieval_eligible, 1 AS dataset_version, n_turns FROM (SELECT *, label = 'resolved' AS retrieval_eligible FROM final) JOIN (SELECT conv_id AS interaction_id, count(*) AS n_turns FROM messages GROUP BY 1) USING (interaction_id)")
def resolution_dataset(spark: SparkSession, sf: str) -> DataFrame:
    made = resolution.build_dataset(final_rows(spark, sf), interactions_as_records(spark, sf))
    return made.select("interaction_id", "label", "source", "retrieval_eligible", "dataset_version", F.size("turns").cast("long").alias("n_turns"))


def interactions_as_records(spark: SparkSession, sf: str) -> DataFrame:
    turn = lambda t: F.struct(t["turn"].alias("tweet_id"), t["side"].alias("author_id"), t["side"].alias("side"), F.timestamp_seconds(t["turn"] * 60).alias("created_at"), t["text"].alias("text"))
    return interactions(spark, sf).select("interaction_id", F.concat(F.lit("cust_"), F.col("interaction_id").cast("string")).alias("customer_id"), F.lit(BRAND).alias("brand_id"), F.transform("turns", turn).alias("turns"))


@entry(f"""{_FINAL} SELECT s.source, count(f.label) AS total, count(*) FILTER (label = 'resolved') AS resolved, count(*) FILTER (label = 'uncertain') AS uncertain, count(*) FILTER (label = 'unresolved') AS unresolved,
    count(*) FILTER (label = 'resolved') AS eligible, coalesce(count(*) FILTER (label = 'resolved') / nullif(count(f.label), 0), 0) AS eligible_share FROM (VALUES ('heuristic'), ('labeler')) s(source) LEFT JOIN final f USING (source) GROUP BY 1""")
def resolution_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.by_source(resolution.with_eligibility(final_rows(spark, sf)))


@entry("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def coverage_missing(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.missing_labels(table(spark, sf, "orders"), table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@entry("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def coverage_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.unknown_labels(table(spark, sf, "pages").withColumnRenamed("page_id", "doc_id"), table(spark, sf, "labels"), "doc_id")


@entry("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.duplicates(table(spark, sf, "supplier"), "s_nationkey")


# ---- logs and model replies


@entry("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def verdict_log_latest(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id", F.col("event_id").alias("seq"))
    return records.latest(log, "user_id", "seq").drop("seq")


@entry("""WITH log AS (SELECT user_id, arg_max(sha256(concat('system', chr(10), chr(10), event_type)), event_id) AS logged, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 1),
    work AS (SELECT c_custkey AS user_id, sha256(concat('system', chr(10), chr(10), 'click')) AS prompt_sha256 FROM customer)
    SELECT user_id, coalesce(logged = prompt_sha256, false) AS hit, CASE WHEN logged = prompt_sha256 THEN verdict END AS verdict FROM work LEFT JOIN log USING (user_id)""")
def cache_hit_miss(spark: SparkSession, sf: str) -> DataFrame:
    log = records.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type", text.prompt_hash(F.lit("system"), F.col("event_type")).alias("prompt_sha256"))
    work = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), text.prompt_hash(F.lit("system"), F.lit("click")).alias("prompt_sha256"))
    out = resolution.cache_join(work, log, "user_id")
    return out.select("user_id", "hit", F.col("verdict.event_type").alias("verdict"))


@entry("SELECT doc_id, sha256(concat('You label texts.', chr(10), chr(10), text)) AS prompt_sha256 FROM documents")
def prompt_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.prompt_hash(F.lit("You label texts."), F.col("text")).alias("prompt_sha256"))


_REPLY = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 2 THEN concat('Here you are: ', props, ' Bye.') ELSE 'no object' END"


@entry(f"SELECT event_id, CASE WHEN event_id % 4 < 3 THEN trim(props) END AS object FROM events")
def json_object_extract(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.expr(_REPLY.replace("chr(10)", "char(10)"))
    return table(spark, sf, "events").select("event_id", text.json_object(reply).alias("object"))


@entry(f"""WITH {MESSAGES} SELECT conv_id AS interaction_id, sha256(string_agg(concat(lpad(side, 8, ' '), ' ', strftime(make_timestamp(turn * 60000000), '%Y-%m-%d %H:%M'), '  ', text), chr(10) ORDER BY turn)) AS transcript
    FROM messages GROUP BY 1 HAVING arg_min(side, turn) = 'customer'""")
def transcript_render(spark: SparkSession, sf: str) -> DataFrame:
    return interactions_as_records(spark, sf).select("interaction_id", F.sha2(text.transcript(F.col("turns")), 256).alias("transcript"))


_RULES = " ".join(f"WHEN regexp_matches(trim(text), {quoted('(?i)' + p)}) THEN {quoted(i)}" for p, i, *_ in V.KEYWORD_RULES)
_DECIDE = " ".join(f"WHEN {quoted(i)} THEN {quoted(d)}" for _, i, _, _, d in V.KEYWORD_RULES)


@entry(f"WITH {MESSAGES}, k AS (SELECT conv_id, turn, CASE {_RULES} ELSE {quoted(V.KEYWORD_FALLBACK[0])} END AS intent FROM messages) SELECT *, CASE intent {_DECIDE} ELSE {quoted(V.KEYWORD_FALLBACK[3])} END AS decision FROM k")
def keyword_rules(spark: SparkSession, sf: str) -> DataFrame:
    m = projected(spark, sf, MESSAGES, "messages").withColumn("r", text.keyword_answer(F.col("text")))
    return m.select("conv_id", "turn", "r.intent", "r.decision")


@entry("""SELECT doc_id, CASE WHEN quality NOT IN (0, 1) THEN 'unknown label' WHEN (quality = 0) <> (toxic = 0) THEN 'quality and toxic must agree' END AS error FROM labels""")
def contract_errors(spark: SparkSession, sf: str) -> DataFrame:
    rule = contracts.rules((F.col("quality").isin(0, 1), "unknown label"), ((F.col("quality") == 0) == (F.col("toxic") == 0), "quality and toxic must agree"))
    return table(spark, sf, "labels").select("doc_id", rule.alias("error"))


@entry("""SELECT event_id, event_type IN ('click', 'view', 'purchase') AND coalesce(user_id % 3 = 0 OR sha256(concat('p', user_id::VARCHAR)) = sha256('p1'), false) AS current FROM events""")
def hint_currency(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.inference import hint_is_current

    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("intent"), F.lit("auto").alias("decision"), F.when(F.col("user_id") % 3 != 0, F.sha2(F.concat(F.lit("p"), F.col("user_id").cast("string")), 256)).alias("prompt_sha256"))
    return e.select("event_id", hint_is_current(["click", "view", "purchase"], F.sha2(F.lit("p1"), 256)).alias("current"))


# ---- vectors

_UNIT = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.normalized(table(spark, sf, "embeddings").select(F.col("vec_id").alias("interaction_id"), F.col("label").alias("cluster_id"), F.col("embedding").alias("vector")))


@entry(f"WITH {_UNIT} SELECT vec_id AS interaction_id, round(v[1], 6) AS first, round(v[64], 6) AS last, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM u")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vector")
    return _vectors(spark, sf).select("interaction_id", F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last"), F.round(F.sqrt(vectors.dot(v, v)), 6).alias("norm"))


@entry(f"""WITH {_UNIT}, q AS (SELECT v AS w FROM u WHERE vec_id = (SELECT min(vec_id) FROM u)), s AS (SELECT vec_id AS interaction_id, {_DOT.format(a="v", b="w")} AS score FROM u, q)
    SELECT interaction_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY s.score DESC, interaction_id LIMIT 5)""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    index = _vectors(spark, sf)
    q = index.orderBy("interaction_id").first()["vector"]
    return vectors.topk(index, q).select("interaction_id", F.round("score", 6).alias("score"))


@entry(f"""WITH {_UNIT}, s AS (SELECT q.vec_id AS asked_id, u.vec_id AS interaction_id, {_DOT.format(a="u.v", b="q.v")} AS score FROM u, u q WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY score DESC, interaction_id) AS rank FROM s) SELECT asked_id, interaction_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def vector_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Asked are all rows whose id is divisible by 50."""
    index = _vectors(spark, sf)
    asked = index.where("interaction_id % 50 = 0").select(F.col("interaction_id").alias("asked_id"), "vector")
    return vectors.topk_batch(index, asked).select("asked_id", "interaction_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_CENTER = f"""{_UNIT}, x AS (SELECT label, i, avg(v[i]) AS x FROM u, range(1, 65) t(i) GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY i) AS c FROM x GROUP BY 1),
    c AS (SELECT label, list_transform(c, lambda y: y / sqrt(list_sum(list_transform(c, lambda z: z * z)))) AS c FROM m)"""


@entry(f"WITH {_CENTER} SELECT label AS cluster_id, round(c[1], 6) AS first, round(c[64], 6) AS last FROM c")
def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.centroids(_vectors(spark, sf)).select("cluster_id", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[63], 6).alias("last"))


@entry(f"""WITH {_CENTER}, s AS (SELECT u.label AS cluster_id, vec_id AS interaction_id, {_DOT.format(a="v", b="c")} AS s FROM u JOIN c USING (label)),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, interaction_id) AS rank FROM s) SELECT cluster_id, interaction_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 8""")
def centroid_examples(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.cluster_examples(_vectors(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@entry(f"""WITH {_CENTER}, a AS (SELECT concat('intent_', label) AS intent_id, v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM u) WHERE n <= 2),
    s AS (SELECT label AS cluster_id, intent_id, round(max({_DOT.format(a="c", b="v")}), 6) AS similarity FROM c, a GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, intent_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    v = _vectors(spark, sf)
    two = v.withColumn("n", F.row_number().over(Window.partitionBy("cluster_id").orderBy("interaction_id"))).where("n <= 2")
    anchors = two.select(F.concat(F.lit("intent_"), F.col("cluster_id").cast("string")).alias("intent_id"), "vector")
    return vectors.candidates(vectors.centroids(v), anchors).withColumn("rank", F.col("rank").cast("long"))


@entry()
def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of all vectors; the best of ten seeded runs."""
    return vectors.kmeans(_vectors(spark, sf).select("interaction_id", "vector"), V.CLUSTERS)


# ---- taxonomies and reconciliation

_SEED = "('a_seed', 'kept', 'a_seed'), ('b_seed', 'merged', 'a_seed'), ('c_seed', 'dropped', NULL)"
_THEME = "('3', 'promoted', 'c_theme'), ('8', 'dropped', NULL)"
_INTENTS = "(0, 'a_seed'), (1, 'c_theme'), (2, 'spare'), (3, 'other')"
_CLUSTERS = "SELECT n_nationkey::BIGINT AS cluster_id, (n_regionkey * 10 + n_nationkey + 1)::BIGINT AS size, CASE WHEN n_nationkey IN (3, 8) THEN 'new' WHEN n_nationkey % 4 = 0 THEN 'junk' WHEN n_nationkey % 2 = 0 THEN 'b_seed' ELSE 'a_seed' END AS mapping FROM nation"
_ROUTE = f"""k AS ({_CLUSTERS}), sd(subject, decision, final_intent) AS (VALUES {_SEED}), td(subject, decision, final_intent) AS (VALUES {_THEME}), i(ord, intent_id) AS (VALUES {_INTENTS}),
    routed AS (SELECT cluster_id, size, mapping, CASE WHEN mapping = 'junk' THEN 'other' WHEN mapping = 'new' THEN coalesce(td.final_intent, 'other') ELSE sd.final_intent END AS final_intent
        FROM k LEFT JOIN sd ON sd.subject = mapping LEFT JOIN td ON td.subject = cluster_id::VARCHAR)"""


def _decisions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n = table(spark, sf, "nation")
    k, size = F.col("n_nationkey").cast("long"), (F.col("n_regionkey") * 10 + F.col("n_nationkey") + 1).cast("long")
    mapping = F.when(k.isin(3, 8), "new").when(k % 4 == 0, "junk").when(k % 2 == 0, "b_seed").otherwise("a_seed")
    kinds = "subject string, decision string, final_intent string"
    seeds = spark.createDataFrame([("a_seed", "kept", "a_seed"), ("b_seed", "merged", "a_seed"), ("c_seed", "dropped", None)], kinds)
    themes = spark.createDataFrame([("3", "promoted", "c_theme"), ("8", "dropped", None)], kinds)
    intents = spark.createDataFrame([(0, "a_seed"), (1, "c_theme"), (2, "spare"), (3, "other")], "ord int, intent_id string")
    return n.select(k.alias("cluster_id"), size.alias("size"), mapping.alias("mapping")), seeds, themes, intents


@entry(f"WITH {_ROUTE} SELECT * FROM routed")
def reconcile_route(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.route(*_decisions(spark, sf)[:3])


@entry(f"WITH {_ROUTE} SELECT ord, intent_id, count(final_intent) AS clusters, coalesce(sum(size), 0)::BIGINT AS messages FROM i LEFT JOIN routed ON final_intent = intent_id GROUP BY 1, 2")
def reconcile_coverage(spark: SparkSession, sf: str) -> DataFrame:
    *parts, intents = _decisions(spark, sf)
    return reconcile.coverage(reconcile.route(*parts), intents)


@entry(f"WITH {_ROUTE} SELECT sum(size)::BIGINT AS messages, sum(size) FILTER (final_intent <> 'other')::BIGINT AS covered, sum(size) FILTER (final_intent <> 'other') / sum(size) AS covered_share FROM routed")
def reconcile_share(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.covered_share(reconcile_coverage(spark, sf))


@entry(f"""WITH {_ROUTE}, m(ord, mapping) AS (VALUES (0, 'a_seed'), (1, 'b_seed'), (2, 'c_seed'), (1048576, 'new'), (1048577, 'junk'))
    SELECT ord, mapping, count(size) AS clusters, coalesce(sum(size), 0)::BIGINT AS messages FROM m LEFT JOIN k USING (mapping) GROUP BY 1, 2""")
def discovery_report(spark: SparkSession, sf: str) -> DataFrame:
    clusters = _decisions(spark, sf)[0]
    seeds = spark.createDataFrame([(0, "a_seed"), (1, "b_seed"), (2, "c_seed"), (3, "other")], "ord int, intent_id string")
    return reconcile.discovery_report(clusters, seeds)


@entry("SELECT 'c_seed' AS subject, 'decision on an unknown seed' AS problem UNION ALL SELECT 'd_seed', 'seed without a decision'")
def decision_gaps(spark: SparkSession, sf: str) -> DataFrame:
    clusters, seeds, themes, _ = _decisions(spark, sf)
    own = spark.createDataFrame([("a_seed",), ("b_seed",), ("d_seed",), ("other",)], "intent_id string")
    return reconcile.decision_gaps(clusters, own, seeds, themes)


# ---- evaluation sets

_HINT = "h AS (SELECT o_orderkey AS interaction_id, c_mktsegment AS intent, CASE WHEN o_orderstatus = 'F' THEN 'escalate' ELSE 'auto' END AS decision FROM orders JOIN customer ON c_custkey = o_custkey)"
_STRATA = f"""{_HINT}, i AS (SELECT DISTINCT c_mktsegment AS intent, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS ord FROM customer),
    s AS (SELECT ord, intent, count(*) AS available, count(*) FILTER (decision = 'auto') AS auto, count(*) FILTER (decision = 'escalate') AS escalate FROM h JOIN i USING (intent) GROUP BY 1, 2),
    b AS (SELECT *, sum(available) OVER () AS total, least(200, sum(available) OVER ()) AS goal, least(available, greatest(10, least(200, sum(available) OVER ()) * available // sum(available) OVER ())) AS base FROM s),
    w AS (SELECT *, goal - sum(base) OVER () AS short FROM b),
    seats AS (SELECT ord, row_number() OVER (ORDER BY CASE WHEN short > 0 THEN -(goal::DOUBLE * available / total - (base + j - 1)) ELSE goal::DOUBLE * available / total - (base - j + 1) END, ord) AS rn, short
        FROM w, range(1, 201) t(j) WHERE short <> 0 AND j <= CASE WHEN short > 0 THEN available - base ELSE base - least(10, available) END),
    q AS (SELECT w.ord, intent, available, auto, escalate, (base + sign(short) * (SELECT count(*) FROM seats x WHERE x.ord = w.ord AND rn <= abs(x.short)))::BIGINT AS quota FROM w),
    l AS (SELECT *, quota - least(escalate, quota) AS lo, least(auto, quota) AS hi FROM q),
    g AS (SELECT *, greatest(sum(lo) OVER (), least(floor(sum(quota) OVER () * 0.6 + 0.5), sum(hi) OVER ())) - sum(lo) OVER () AS rest, coalesce(sum(hi - lo) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
    d AS (SELECT ord, intent, available, quota, (lo + least(hi - lo, greatest(0, rest - before)))::BIGINT AS auto_picks FROM g)"""
_QUEUE = f"""{_STRATA}, p AS (SELECT ord, intent, unnest(['auto', 'escalate']) AS decision, unnest([auto_picks, quota - auto_picks]) AS n FROM d),
    r AS (SELECT *, sha256(concat('42:', interaction_id::VARCHAR)) AS hash, row_number() OVER (PARTITION BY intent, decision ORDER BY sha256(concat('42:', interaction_id::VARCHAR)), interaction_id) AS k FROM h),
    c AS (SELECT r.*, p.ord, row_number() OVER (PARTITION BY r.intent ORDER BY hash, interaction_id) AS pos FROM r JOIN p USING (intent, decision) WHERE k <= n),
    queue AS (SELECT row_number() OVER (ORDER BY pos, ord) AS queue_pos, interaction_id, intent AS hint_intent, decision AS hint_decision FROM c)"""


def _hints(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    hints = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("interaction_id"), F.col("c_mktsegment").alias("intent"), F.when(F.col("o_orderstatus") == "F", "escalate").otherwise("auto").alias("decision"))
    intents = c.select(F.col("c_mktsegment").alias("intent")).distinct().withColumn("ord", F.row_number().over(Window.orderBy("intent")) - 1)
    return hints, intents


def _quotas(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    hints, intents = _hints(spark, sf)
    n = lambda d: F.count_if(F.col("decision") == d).alias(d)
    strata = hints.groupBy("intent").agg(F.count("*").alias("available"), n("auto"), n("escalate")).join(intents, "intent")
    return strata, golden.apportion(strata.select("ord", "intent", "available"))


@entry(f"WITH {_STRATA} SELECT ord::INT AS ord, intent, available, quota FROM q")
def quota_apportion(spark: SparkSession, sf: str) -> DataFrame:
    return _quotas(spark, sf)[1]


@entry(f"WITH {_STRATA} SELECT ord::INT AS ord, intent, quota, auto_picks, quota - auto_picks AS escalate_picks FROM d")
def decision_split(spark: SparkSession, sf: str) -> DataFrame:
    strata, quotas = _quotas(spark, sf)
    return golden.split_decisions(quotas.join(strata.select("ord", "auto", "escalate"), "ord"))


@entry(f"WITH {_QUEUE} SELECT * FROM queue")
def golden_queue(spark: SparkSession, sf: str) -> DataFrame:
    hints, intents = _hints(spark, sf)
    return golden.plan_queue(hints, intents).withColumn("queue_pos", F.col("queue_pos").cast("long"))


_GOLD = f"{_QUEUE}, gold AS (SELECT *, CASE WHEN interaction_id % 5 = 0 THEN 'AUTOMOBILE' ELSE hint_intent END AS gold_intent, CASE WHEN interaction_id % 7 = 0 THEN 'auto' ELSE hint_decision END AS gold_decision, CASE WHEN interaction_id % 2 = 0 THEN 'note' ELSE '' END AS notes FROM queue WHERE NOT (hint_intent = 'MACHINERY' AND hint_decision = 'escalate'))"


def _gold(queue: DataFrame) -> DataFrame:
    q = queue.where("not (hint_intent = 'MACHINERY' and hint_decision = 'escalate')")
    return q.withColumns({"gold_intent": F.when(F.col("interaction_id") % 5 == 0, "AUTOMOBILE").otherwise(F.col("hint_intent")), "gold_decision": F.when(F.col("interaction_id") % 7 == 0, "auto").otherwise(F.col("hint_decision")), "notes": F.when(F.col("interaction_id") % 2 == 0, "note").otherwise("")})


@entry(f"""WITH {_GOLD} SELECT i.intent, i.ord::INT AS ord, count(g.gold_intent) AS total, count(*) FILTER (gold_decision = 'auto') AS auto, count(*) FILTER (gold_decision = 'escalate') AS escalate, count(*) FILTER (notes <> '') AS notes_filled,
    count(*) FILTER (gold_intent = hint_intent) AS intent_agreed, count(*) FILTER (gold_decision = hint_decision) AS decision_agreed FROM i LEFT JOIN gold g ON g.gold_intent = i.intent GROUP BY 1, 2""")
def golden_report(spark: SparkSession, sf: str) -> DataFrame:
    queue = golden_queue(spark, sf)
    return golden.golden_report(queue, _gold(queue), _hints(spark, sf)[1])


@entry(f"WITH {_GOLD} SELECT interaction_id, queue_pos FROM queue WHERE interaction_id NOT IN (SELECT interaction_id FROM gold)")
def golden_remaining(spark: SparkSession, sf: str) -> DataFrame:
    queue = golden_queue(spark, sf)
    return golden.remaining(queue, _gold(queue)).select("interaction_id", "queue_pos")


@entry(f"WITH {_QUEUE} SELECT queue_pos, interaction_id, o_orderpriority FROM queue JOIN orders ON o_orderkey = interaction_id")
def queue_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("interaction_id"), "o_orderpriority")
    return golden.queue_join(golden_queue(spark, sf), rows).select("queue_pos", "interaction_id", "o_orderpriority")


# ---- development labels

_LABELS = "lab AS (SELECT doc_id AS interaction_id, concat('q', quality, toxic) AS intent, 'seen' AS justification, 'labeler' AS source, 'm1' AS model FROM labels), fix AS (SELECT interaction_id, 'q11' AS intent, 'by hand' AS justification FROM lab WHERE intent IN ('q01', 'q11')), over AS (SELECT l.interaction_id, coalesce(f.intent, l.intent) AS intent, coalesce(f.justification, l.justification) AS justification, CASE WHEN f.intent IS NULL THEN 'labeler' ELSE 'human' END AS source, CASE WHEN f.intent IS NULL THEN model END AS model FROM lab l LEFT JOIN fix f USING (interaction_id))"


def _overlaid(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "labels").select(F.col("doc_id").alias("interaction_id"), F.concat(F.lit("q"), F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("intent"), F.lit("seen").alias("justification"), F.lit("labeler").alias("source"), F.lit("m1").alias("model"))
    fix = own.where("intent in ('q01', 'q11')").select("interaction_id", F.lit("q11").alias("intent"), F.lit("  by \n hand ").alias("justification"))
    return labels.overlay(own, fix, ["q00", "q01", "q10", "q11"])


@entry("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')")
def pool_membership(spark: SparkSession, sf: str) -> DataFrame:
    return labels.outside_pool(table(spark, sf, "labels"), table(spark, sf, "documents").where("lang <> 'de'"), "doc_id")


@entry("SELECT p_partkey FROM part WHERE p_size % 4 = 0 OR p_brand IS NULL")
def record_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    changed = p.withColumn("p_brand", F.when(F.col("p_size") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")))
    return labels.mismatched(changed, p, "p_partkey")


@entry(f"WITH {_LABELS} SELECT * FROM over")
def corrections_overlay(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaid(spark, sf)


@entry(f"WITH {_LABELS}, i(ord, intent) AS (VALUES (0, 'q00'), (1, 'q01'), (2, 'q10'), (3, 'q11'), (4, 'none')) SELECT ord, i.intent, count(o.intent) AS total, count(*) FILTER (source = 'labeler') AS labeler, count(*) FILTER (source = 'human') AS human FROM i LEFT JOIN over o ON o.intent = i.intent GROUP BY 1, 2")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    intents = spark.createDataFrame(list(enumerate(["q00", "q01", "q10", "q11", "none"])), "ord int, intent string")
    return labels.distribution(_overlaid(spark, sf), intents)


@entry(f"WITH {_LABELS}, r AS (SELECT intent, interaction_id, source, row_number() OVER (PARTITION BY intent ORDER BY CASE source WHEN 'human' THEN 0 ELSE 1 END, interaction_id) AS rank, count(*) OVER (PARTITION BY intent) AS total FROM over) SELECT * FROM r WHERE rank <= 5")
def review_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return labels.review_rows(_overlaid(spark, sf)).select("intent", "interaction_id", "source", F.col("rank").cast("long").alias("rank"), "total")


# ---- inference with a model that answers by rule

_STUB = "SELECT doc_id AS interaction_id, CASE WHEN quality = 1 THEN 'resolved' WHEN toxic = 1 THEN 'unresolved' ELSE 'uncertain' END AS label FROM labels"


def _rule_model():
    """A model that finds its answer in the prompt, at first without JSON for every third row."""

    def model(prompt: str, system: str, temperature: float) -> tuple[str, str]:
        row = prompt.split("\n")[0]
        label = "resolved" if "quality 1" in row else "unresolved" if "toxic 1" in row else "uncertain"
        sound = "is not valid" in prompt or int(row.split()[0]) % 3
        return (f'{{"label": "{label}", "justification": "by rule"}}' if sound else "let me think"), "rule"

    return model


@entry(f"SELECT interaction_id, label, 'by rule' AS justification, 'rule' AS model FROM ({_STUB})")
def stub_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts, repair of invalid replies, the verdict log and reading it back, over all labels."""
    import json
    import uuid

    from ..operators import inference
    from ..plans.staging import stage_root

    def valid(reply: str) -> str | None:
        try:
            return None if json.loads(reply)["label"] in V.CLOSURE_LABELS else "unknown label"
        except ValueError:
            return "no JSON object"

    rows = table(spark, sf, "labels")
    prompt = F.format_string("%d quality %d toxic %d", F.col("doc_id"), F.col("quality").cast("long"), F.col("toxic").cast("long"))
    work = rows.select(F.col("doc_id").alias("interaction_id"), prompt.alias("prompt"))
    log = f"{stage_root(spark)}/threadmill/verdicts-{uuid.uuid4().hex[:12]}"
    said = inference.cached(work, log, _rule_model, "Judge.", valid, wave=max(200, work.count() // 2))
    r = inference.reply_fields(F.col("reply"), "label", V.CLOSURE_LABELS)
    return said.select("interaction_id", r["value"].alias("label"), r["text"].alias("justification"), "model")


@entry(f"""WITH {MESSAGES}, m AS (SELECT conv_id, list(struct_pack(turn := turn, side := side, text := text) ORDER BY turn, side, text) AS t FROM messages GROUP BY 1),
    lab AS ({_STUB}) SELECT conv_id AS conversation_id, t[1].text AS customer_message, list_filter(t, lambda x: x.side = 'brand')[1].text AS brand_reply, concat('i', conv_id % 4) AS intent, label AS resolution
    FROM m JOIN lab ON interaction_id = conv_id WHERE t[1].side = 'customer'""")
def case_rows(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("quality") == 1, "resolved").when(F.col("toxic") == 1, "unresolved").otherwise("uncertain")
    rows = interactions(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("interaction_id"), label.alias("label")), "interaction_id")
    intents = rows.select("interaction_id", F.concat(F.lit("i"), (F.col("interaction_id") % 4).cast("string")).alias("intent"))
    return metrics.case_format(rows, intents)


# ---- second tier

_PAIRS = "pairs AS (SELECT CASE quality WHEN 1 THEN 'auto' ELSE 'escalate' END AS gold, CASE WHEN toxic = 1 OR doc_id % 9 = 0 THEN 'escalate' ELSE 'auto' END AS predicted FROM labels)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.when(F.col("quality") == 1, "auto").otherwise("escalate").alias("gold"), F.when((F.col("toxic") == 1) | (F.col("doc_id") % 9 == 0), "escalate").otherwise("auto").alias("predicted"))


@entry(f"WITH {_PAIRS} SELECT gold, predicted, count(*) AS n FROM pairs GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_pairs(spark, sf))


_CLASSES = f"""{_PAIRS}, c AS (SELECT l AS label, count(*) FILTER (gold = l) AS support, count(*) FILTER (predicted = l) AS guessed, count(*) FILTER (gold = l AND predicted = l) AS hits FROM pairs, (VALUES ('auto'), ('escalate')) v(l) GROUP BY 1),
    f AS (SELECT label, support, coalesce(hits / nullif(guessed, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(guessed + support, 0), 0) AS f1 FROM c)"""


@entry(f"WITH {_CLASSES} SELECT label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def per_class_f1(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 9).alias(c)
    return metrics.per_class(_pairs(spark, sf)).select("label", "support", r("precision"), r("recall"), r("f1"))


@entry(f"WITH {_CLASSES} SELECT (SELECT count(*) FROM pairs) AS n, (SELECT round(count(*) FILTER (gold = predicted) / count(*), 9) FROM pairs) AS accuracy, round(avg(f1) FILTER (support > 0), 9) AS macro_f1 FROM f")
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.summary(_pairs(spark, sf)).select("n", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@entry(f"""WITH {_PAIRS} SELECT count(*) AS n, count(*) FILTER (predicted = 'auto') AS auto, count(*) FILTER (predicted = 'auto' AND gold = 'escalate') AS false_auto,
    round(count(*) FILTER (predicted = 'auto') / count(*), 9) AS auto_rate, round(count(*) FILTER (predicted = 'auto' AND gold = 'escalate') / count(*) FILTER (predicted = 'auto'), 9) AS false_auto_rate FROM pairs""")
def false_auto_rate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auto_rates(_pairs(spark, sf)).withColumns({"auto_rate": F.round("auto_rate", 9), "false_auto_rate": F.round("false_auto_rate", 9)})


@entry(f"""WITH {_PAIRS}, a AS (SELECT gold, predicted, count(*) AS n FROM pairs GROUP BY 1, 2), t AS (SELECT sum(n) AS t, sum(n) FILTER (gold = predicted) / sum(n) AS po FROM a),
    e AS (SELECT sum(x.na * y.nb) AS c FROM (SELECT gold AS k, sum(n) AS na FROM a GROUP BY 1) x JOIN (SELECT predicted AS k, sum(n) AS nb FROM a GROUP BY 1) y USING (k))
    SELECT t::BIGINT AS n, round(po, 9) AS agreement, round((po - c / (t * t)) / (1 - c / (t * t)), 9) AS kappa FROM t, e""")
def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.agreement(_pairs(spark, sf), "gold", "predicted")
    return out.select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@entry("SELECT c_mktsegment AS intent, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, intent LIMIT 1")
def majority_class(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.majority(table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "intent"))


_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


_BM25 = f"""t AS (SELECT doc_id, unnest({_TOKENS.format("text")}) AS term FROM documents), size AS (SELECT doc_id, len({_TOKENS.format("text")}) AS len FROM documents), st AS (SELECT count(*) AS n, avg(len) AS a FROM size),
    w AS (SELECT DISTINCT item_id AS asked_id, term FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark)),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM w) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT asked_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))) AS score FROM w JOIN tf USING (term) JOIN df USING (term) JOIN size USING (doc_id), st GROUP BY 1, 2)"""


@entry(f"""WITH {_BM25},
    r AS (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT asked_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank <= 5""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The index is written, opened again and asked for all benchmark items."""
    folder = scratch_folder(spark, "lexical")
    lexical.build(table(spark, sf, "documents"), folder)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("asked_id"), "text")
    return lexical.topk(lexical.opened(spark, folder), asked).select("asked_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@entry("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'escalate' WHEN o_orderpriority = '2-HIGH' THEN 'escalate' WHEN o_totalprice / 500000 < 0.3 THEN 'escalate' WHEN o_orderkey % 10 / 10 < 0.2 THEN 'escalate' ELSE 'auto' END AS decision,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'high-risk intent' WHEN o_orderpriority = '2-HIGH' THEN 'account-specific intent' WHEN o_totalprice / 500000 < 0.3 THEN 'low confidence' WHEN o_orderkey % 10 / 10 < 0.2 THEN 'weak evidence' ELSE 'confident and grounded' END AS reason FROM orders""")
def policy_decision(spark: SparkSession, sf: str) -> DataFrame:
    d = metrics.decide(F.col("o_orderpriority"), F.col("o_totalprice") / 500000, F.col("o_orderkey") % 10 / 10, ["1-URGENT"], ["2-HIGH"], 0.3, 0.2)
    return table(spark, sf, "orders").select("o_orderkey", d.alias("d")).select("o_orderkey", "d.decision", "d.reason")


@entry("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The windowed aggregation of the event stream, as a batch over the whole table."""
    made = streams.windowed_counts(table(spark, sf, "events"))
    return made.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@entry(f"""WITH {_UNIT}, {_BM25}, q AS (SELECT item_id AS asked_id, v, label FROM benchmark JOIN u ON vec_id = item_id),
    d AS (SELECT asked_id, vec_id AS doc_id, {_DOT.format(a="u.v", b="q.v")} AS d FROM u, q),
    b AS (SELECT asked_id, doc_id, coalesce(score, 0) AS l, coalesce(d, 0) AS d FROM (SELECT * FROM s WHERE asked_id IN (SELECT asked_id FROM q)) FULL JOIN d USING (asked_id, doc_id)),
    both_scores AS (SELECT asked_id, doc_id, CASE WHEN max(l) OVER w > 0 THEN l / max(l) OVER w ELSE 0 END * 0.5 + CASE WHEN max(d) OVER w > 0 THEN d / max(d) OVER w ELSE 0 END * 0.5
                 + CASE WHEN q.label = e.label THEN 0.1 ELSE 0 END AS score
          FROM b JOIN q USING (asked_id) LEFT JOIN embeddings e ON e.vec_id = doc_id WINDOW w AS (PARTITION BY asked_id)),
    r AS (SELECT asked_id, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY asked_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM both_scores) SELECT * FROM r WHERE rank <= 5""")
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over the documents and cosines of their vectors, for all benchmark items; labels are the intents."""
    words = lexical.build(table(spark, sf, "documents"), scratch_folder(spark, "lexical"))
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("intent"))
    index = vector_index.build(e.withColumnRenamed("vec_id", "interaction_id"), scratch_folder(spark, "vectors"), "given")
    asked = table(spark, sf, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("asked_id"), "text", "vector", "intent")
    out = hybrid.topk(words, index, asked, e.select(F.col("vec_id").alias("doc_id"), "intent"))[0]
    return out.select("asked_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@entry(ORACLE_SQL["vector_topk_batch"])
def vector_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same by an index in parts that is written, opened again and read where its bounds ask for it."""
    folder = scratch_folder(spark, "vectors")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("interaction_id"), F.col("embedding").alias("vector"))
    vector_index.build(rows, folder, "given")
    asked = rows.where("interaction_id % 50 = 0").withColumnRenamed("interaction_id", "asked_id")
    found = vector_index.topk(vector_index.opened(spark, folder, "given"), asked)
    return found.select("asked_id", "interaction_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
