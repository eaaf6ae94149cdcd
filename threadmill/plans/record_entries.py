"""Entries of sources and record contracts: rows of the fixture, some spoilt on purpose, and what is wrong with each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts, text
from ..functions import fixed_values as V
from ..operators import discovery, metrics, resolution, vectors
from ..sources import records, taxonomy
from . import catalogue as C
from .catalogue import entry, table
from .fixture import MESSAGES, TWEETS, quoted
from .staging import stage_root


def _cases(on: str, errors: dict[int, str]) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {k} THEN {quoted(e)}" for k, e in errors.items()) + " END AS error"


def _by(rest, column: str, **spoilt):
    """The column, but other values where the rest is that of ``r0``, ``r1`` and so on."""
    out = F.col(column)
    for name, value in spoilt.items():
        out = F.when(rest == int(name[1:]), value).otherwise(out)
    return out


# ---- sources


@entry(f"WITH {TWEETS} SELECT tweet_id, author_id, inbound, created_at AS seconds, text, parent_id FROM tweets")
def message_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Messages written as CSV in the source's own form and read strictly."""
    path = f"{stage_root(spark)}/threadmill/messages-{uuid.uuid4().hex[:12]}"
    t = C.tweets(spark, sf)
    when = F.date_format("created_at", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    rows = t.select("tweet_id", "author_id", F.when(F.col("inbound"), "True").otherwise("False").alias("inbound"), when.alias("created_at"), "text", F.lit("").alias("response_tweet_id"), F.col("parent_id").alias("in_response_to_tweet_id"))
    rows.write.csv(path, header=True, quoteAll=True, escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return records.read_tweets(spark, path).select("tweet_id", "author_id", "inbound", F.unix_timestamp("created_at").alias("seconds"), "text", "parent_id")


_SEED_ROWS = "SELECT n_nationkey, CASE n_nationkey WHEN 7 THEN 'other' ELSE lower(n_name) END AS intent_id, concat('What region ', n_regionkey, ' asks.') AS definition, concat('Hello from ', n_name) AS representative_message FROM"


@entry(f"SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS ord, intent_id, definition, representative_message FROM ({_SEED_ROWS} nation) QUALIFY intent_id <> 'other'")
def support_intents(spark: SparkSession, sf: str) -> DataFrame:
    """A seed taxonomy in Markdown, made of the nations and read back; its fallback is left out."""
    rows = spark.sql(f"{_SEED_ROWS} {{nation}} ORDER BY n_nationkey", nation=table(spark, sf, "nation")).collect()
    head = "| # | Intent | Definition | Messages |\n|---|---|---|---|\n"
    text = head + "".join(f"| {r[0] + 1} | `{r[1]}` | {r[2]} | 1 |\n" for r in rows) + "\n" + "".join(f'- `{r[1]}`: "{r[3]}"\n' for r in rows)
    return discovery.support_intents(taxonomy.seed_taxonomy(spark, text))


_MAPPED = "CASE WHEN text LIKE '%ank%' OR trim(text) = '' THEN 'junk' WHEN text LIKE '%laylist%' OR text LIKE '%songs%' THEN 'music' WHEN text LIKE '%log in%' THEN 'account' ELSE 'new' END"


def _rule_labeler():
    """A model that maps a cluster by its examples, at first in prose, then in fences."""

    def model(prompt: str, system: str, temperature: float) -> tuple[str, str]:
        said = prompt.split("nearest to its middle:\n")[1].split("\n\nCandidates")[0]
        mapping = "junk" if "ank" in said or not said.replace("-", "").strip() else "music" if "laylist" in said or "songs" in said else "account" if "log in" in said else "new"
        sound = "is not valid" in prompt or "e" not in said
        return (f'```json\n{{"mapping": "{mapping}", "justification": "by rule"}}\n```' if sound else "I would say it is one of them"), "rule"

    return model


@entry(f"WITH {MESSAGES} SELECT text AS message, count(*) AS size, {_MAPPED} AS mapping FROM messages WHERE side = 'customer' GROUP BY text")
def cluster_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Discovery over all customers' messages: as many clusters as there are different phrases, so each is a phrase; a model maps them by rule."""
    m = C.projected(spark, sf, MESSAGES, "messages").where("side = 'customer'")
    rows = m.select((F.col("conv_id") * 1000 + F.col("turn")).alias("interaction_id"), F.col("text").alias("message"))
    seeds = spark.createDataFrame([(0, "music", "Something with songs or lists."), (1, "account", "Getting into the account."), (2, "other", "The rest.")], "ord int, intent_id string, definition string")
    anchors = seeds.select("intent_id", F.col("definition").alias("message")).unionByName(seeds.select("intent_id", F.col("intent_id").alias("message")))
    log = f"{stage_root(spark)}/threadmill/mappings-{uuid.uuid4().hex[:12]}"
    found = discovery.discover(rows, anchors, seeds, vectors.hashing_embedder(64), _rule_labeler, log, k=rows.select("message").distinct().count(), restarts=3)
    return found.select(F.col("examples")[0]["message"].alias("message"), "size", "mapping")


@entry(f"{C._FINAL} SELECT interaction_id, 64 AS dim FROM final WHERE label = 'resolved'")
def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The opening texts of eligible rows as checked vectors, one for each."""
    made = resolution.build_dataset(C.final_rows(spark, sf), C.interactions_as_records(spark, sf))
    return vectors.build_index(made, vectors.hashing_embedder(64), 64)[0].select("interaction_id", F.size("vector").alias("dim"))


# ---- contracts

_INTERACTION = {1: "customer_id and brand_id must be strings", 2: "turns must not be empty", 3: "the first turn must be the customer's", 4: "a turn is malformed", 5: "a turn is malformed"}


@entry(f"WITH {MESSAGES} SELECT conv_id AS interaction_id, {_cases('conv_id % 7', _INTERACTION)} FROM messages GROUP BY conv_id HAVING arg_min(side, turn) = 'customer'")
def contract_interactions(spark: SparkSession, sf: str) -> DataFrame:
    k, turns = F.col("interaction_id") % 7, F.col("turns")
    put = lambda field, value: F.transform(turns, lambda t: t.withField(field, F.lit(value).cast("string")))
    spoilt = _by(k, "turns", r2=F.filter(turns, lambda t: F.lit(False)), r3=put("side", "brand"), r4=put("text", None), r5=put("side", "nobody"))
    rows = C.interactions_as_records(spark, sf).withColumns({"customer_id": F.when(k != 1, F.col("customer_id")), "turns": spoilt})
    return rows.select("interaction_id", contracts.interaction().alias("error"))


@entry(f"""{C._CLOSURE}, m AS (SELECT interaction_id, CASE WHEN interaction_id % 5 = 1 THEN 'maybe' ELSE label END AS label, CASE WHEN interaction_id % 5 = 2 THEN ' ' ELSE reason END AS reason, needs_adjudication <> (interaction_id % 5 = 3) AS needs_adjudication FROM closure)
    SELECT interaction_id, CASE WHEN label NOT IN ('resolved', 'uncertain', 'unresolved') THEN 'unknown label' WHEN trim(reason) = '' THEN 'reason must not be blank'
        WHEN needs_adjudication <> (label IS NULL) THEN 'needs_adjudication must say whether the label is missing' END AS error FROM m""")
def contract_closure_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("interaction_id") % 5
    rows = C.closure_rows(spark, sf).withColumns({"label": _by(k, "label", r1="maybe"), "reason": _by(k, "reason", r2=" "), "needs_adjudication": F.col("needs_adjudication") != (k == 3)})
    return rows.select("interaction_id", contracts.closure_label().alias("error"))


@entry(f"""{C._FINAL}, m AS (SELECT interaction_id, CASE WHEN interaction_id % 7 <> 4 THEN label END AS label, CASE WHEN interaction_id % 7 = 1 THEN 'guess' ELSE source END AS source, CASE WHEN interaction_id % 7 = 2 THEN '' ELSE reason END AS reason,
        CASE WHEN interaction_id % 7 <> 3 THEN flag_reason WHEN flag_reason IS NULL THEN 'x' END AS flag_reason, CASE WHEN interaction_id % 7 <> 5 THEN model END AS model FROM final)
    SELECT interaction_id, CASE WHEN label IS NULL THEN 'unknown label' WHEN source = 'guess' THEN 'unknown source' WHEN reason = '' THEN 'reason must not be blank'
        WHEN source = 'heuristic' AND (flag_reason IS NOT NULL OR model IS NOT NULL) THEN 'heuristic labels carry no flag_reason or model'
        WHEN source = 'labeler' AND (flag_reason IS NULL OR model IS NULL) THEN 'labeler labels need flag_reason and model' END AS error FROM m""")
def contract_final_labels(spark: SparkSession, sf: str) -> DataFrame:
    k, flag = F.col("interaction_id") % 7, F.col("flag_reason")
    changed = {"label": F.when(k != 4, F.col("label")), "source": _by(k, "source", r1="guess"), "reason": _by(k, "reason", r2=""), "flag_reason": F.when(k != 3, flag).when(flag.isNull(), "x"), "model": F.when(k != 5, F.col("model"))}
    return C.final_rows(spark, sf).withColumns(changed).select("interaction_id", contracts.final_label().alias("error"))


_RESOLUTION = {1: "dataset_version must be 1", 2: "retrieval_eligible must say whether the label is resolved", 3: "unknown label", 4: "turns must not be empty"}


@entry(f"{C._FINAL} SELECT interaction_id, {_cases('interaction_id % 6', _RESOLUTION)} FROM final")
def contract_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    k, eligible = F.col("interaction_id") % 6, F.col("retrieval_eligible")
    made = resolution.build_dataset(C.final_rows(spark, sf), C.interactions_as_records(spark, sf))
    changed = {"dataset_version": F.when(k == 1, 2).otherwise(F.col("dataset_version")), "retrieval_eligible": eligible != (k == 2), "label": _by(k, "label", r3="maybe"), "turns": _by(k, "turns", r4=F.filter("turns", lambda t: F.lit(False)))}
    return made.withColumns(changed).select("interaction_id", contracts.resolution().alias("error"))


@entry("""SELECT n_nationkey::BIGINT - 1 AS cluster_id, CASE WHEN n_nationkey = 0 THEN 'cluster_id must not be negative' WHEN n_regionkey = 0 THEN 'size must be positive' WHEN n_nationkey % 8 = 1 THEN 'unknown mapping'
    WHEN n_nationkey % 8 = 2 THEN 'justification must not be blank' WHEN n_nationkey % 8 = 3 THEN 'candidates must not be empty' WHEN n_nationkey % 8 = 4 THEN 'a candidate is malformed' WHEN n_nationkey % 8 = 5 THEN 'examples must not be empty'
    WHEN n_nationkey % 8 = 6 THEN 'an example is malformed' END AS error FROM nation""")
def contract_clusters(spark: SparkSession, sf: str) -> DataFrame:
    k, near = F.col("n_nationkey") % 8, F.lit(0.5)
    candidate = lambda name: F.array(F.struct(F.lit(name).alias("intent_id"), near.alias("similarity")))
    example = lambda s: F.array(F.struct(F.col("n_nationkey").cast("long").alias("interaction_id"), F.col("n_name").alias("message"), F.lit(s).cast("double").alias("similarity")))
    rows = table(spark, sf, "nation").select(
        (F.col("n_nationkey").cast("long") - 1).alias("cluster_id"),
        F.col("n_regionkey").cast("long").alias("size"),
        F.when(k == 1, "nowhere").otherwise("a_seed").alias("mapping"),
        F.when(k == 2, "\t").otherwise("seen").alias("justification"),
        F.when(k == 3, F.filter(candidate("a_seed"), lambda c: F.lit(False))).when(k == 4, candidate(" ")).otherwise(candidate("a_seed")).alias("candidates"),
        F.when(k == 5, F.filter(example(0.5), lambda c: F.lit(False))).when(k == 6, example(float("nan"))).otherwise(example(0.5)).alias("examples"),
    )
    return rows.select("cluster_id", contracts.cluster(["a_seed", "b_seed"]).alias("error"))


_GOLDEN = {1: "unknown hint_decision", 2: "taxonomy_version must be positive", 3: "customer_message must not be blank", 4: "unknown gold_intent", 5: "unknown gold_decision", 6: "notes must be a string", 7: "hint_intent must not be blank"}


@entry(f"WITH {C._GOLD} SELECT interaction_id, {_cases('interaction_id % 9', _GOLDEN)} FROM gold")
def contract_golden(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("interaction_id") % 9
    gold = C._gold(C.golden_queue(spark, sf)).withColumns({
        "hint_decision": _by(k, "hint_decision", r1="maybe"), "taxonomy_version": F.when(k == 2, 0).otherwise(1), "customer_message": F.when(k == 3, " ").otherwise("Hello"), "gold_intent": _by(k, "gold_intent", r4="NOWHERE"),
        "gold_decision": F.when(k != 5, F.col("gold_decision")), "notes": F.when(k != 6, F.col("notes")), "hint_intent": _by(k, "hint_intent", r7=""),
    })
    return gold.select("interaction_id", contracts.golden(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).alias("error"))


_INTENT = {1: "customer_message must not be blank", 2: "intent must not be blank", 3: "unknown source", 4: "labelers name their model, humans have none", 5: "taxonomy_version must be positive"}


@entry(f"WITH {C._LABELS} SELECT interaction_id, {_cases('interaction_id % 7', _INTENT)} FROM over")
def contract_intent_labels(spark: SparkSession, sf: str) -> DataFrame:
    k, model = F.col("interaction_id") % 7, F.col("model")
    rows = C._overlaid(spark, sf).withColumns({
        "customer_message": F.when(k == 1, "").otherwise("Hello"), "intent": _by(k, "intent", r2="\n"), "source": _by(k, "source", r3="robot"),
        "model": F.when(k != 4, model).when(model.isNull(), "m2"), "taxonomy_version": F.when(k == 5, 0).otherwise(1),
    })
    return rows.select("interaction_id", contracts.intent_label().alias("error"))


@entry("""WITH d AS (SELECT p_partkey, concat('i', p_partkey) AS subject, ['kept', 'merged', 'dropped', 'promoted', 'lost'][p_size % 5 + 1] AS decision, CASE p_partkey % 3 WHEN 0 THEN concat('i', p_partkey) WHEN 1 THEN 'elsewhere' END AS final_intent FROM part)
    SELECT p_partkey, CASE WHEN decision = 'lost' THEN 'unknown decision' WHEN decision = 'kept' AND final_intent IS DISTINCT FROM subject THEN 'a kept intent keeps its id'
        WHEN decision = 'merged' AND coalesce(final_intent = subject, true) THEN 'a merged intent has another target' WHEN decision = 'dropped' AND final_intent IS NOT NULL THEN 'a dropped intent has no target'
        WHEN decision = 'promoted' AND final_intent IS NULL THEN 'a promoted theme needs a target' END AS error FROM d""")
def contract_decisions(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["kept", "merged", "dropped", "promoted", "lost"]))
    own = F.concat(F.lit("i"), F.col("p_partkey").cast("string"))
    rows = table(spark, sf, "part").select("p_partkey", own.alias("subject"), F.element_at(kinds, (F.col("p_size") % 5 + 1).cast("int")).alias("decision"), F.when(F.col("p_partkey") % 3 == 0, own).when(F.col("p_partkey") % 3 == 1, "elsewhere").alias("final_intent"))
    return rows.select("p_partkey", contracts.decision().alias("error"))


_VECTOR = {1: "a vector must have 64 numbers", 2: "a vector must hold finite numbers", 3: "a vector must hold finite numbers"}


@entry(f"SELECT vec_id AS interaction_id, {_cases('vec_id % 5', _VECTOR)} FROM embeddings")
def contract_vectors(spark: SparkSession, sf: str) -> DataFrame:
    k, v = F.col("vec_id") % 5, F.transform("embedding", lambda x: x.cast("double"))
    all_of = lambda x: F.transform(v, lambda _: F.lit(x).cast("double"))
    spoilt = F.when(k == 1, F.slice(v, 1, 63)).when(k == 2, all_of(float("nan"))).when(k == 3, all_of(float("inf"))).otherwise(v)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("interaction_id"), spoilt.alias("vector")).select("interaction_id", contracts.vector(64).alias("error"))


# ---- answers and a trained baseline

_ANSWERS = [(i, c, e, d, *V.KEYWORD_REPLIES[i]) for _, i, c, e, d in V.KEYWORD_RULES] + [(*V.KEYWORD_FALLBACK, *V.KEYWORD_REPLIES[V.KEYWORD_FALLBACK[0]])]
_ANSWER_ROWS = ", ".join(f"({quoted(i)}, {c}, {quoted(','.join(e))}, {quoted(r)}, {quoted(why)})" for i, c, e, _, r, why in _ANSWERS)


@entry(f"""WITH {MESSAGES}, k AS (SELECT conv_id, turn, CASE {C._RULES} ELSE {quoted(V.KEYWORD_FALLBACK[0])} END AS intent FROM messages), a(intent, confidence, evidence, reply, reason) AS (VALUES {_ANSWER_ROWS})
    SELECT conv_id, turn, confidence::DOUBLE AS confidence, evidence, reply, reason FROM k JOIN a USING (intent)""")
def keyword_answers(spark: SparkSession, sf: str) -> DataFrame:
    m = C.projected(spark, sf, MESSAGES, "messages").withColumn("r", text.keyword_answer(F.col("text")))
    return m.select("conv_id", "turn", "r.confidence", F.array_join("r.evidence", ",").alias("evidence"), "r.reply", "r.reason")


@entry()
def tfidf_lr_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The trained baseline's guess of a document's language, for all documents; fitted on those whose id is not divisible by 5."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("message"), F.col("lang").alias("intent"))
    model = metrics.tfidf_baseline(docs.where("doc_id % 5 <> 0 and intent is not null"))
    names = F.array(*map(F.lit, model.stages[0].labels))
    return model.transform(docs).select("doc_id", F.try_element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))
