"""Sub-commands over files: each reads strictly, works, and swaps its outputs in together. Errors end with status 1."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed_values as V
from .operators import closure, discovery, golden, inference, labels, language, reconcile, resolution, sampling, stitch, vectors
from .plans.staging import session
from .sources import archive, config, records, sinks, taxonomy

ERRORS = (ValueError, OSError, RuntimeError)
TAXONOMY_COLUMNS = (["intent", "definition", "origin", "examples"], ["seed intent", "decision", "final intent"], ["cluster", "decision", "final intent"])


def _write(*outputs: tuple[DataFrame | str, str, list[str]]) -> None:
    """Stage all outputs, then swap them in."""
    sinks.distinct_paths(*(path for _, path, _ in outputs))
    staged = [(sinks.stage_text(what, path) if isinstance(what, str) else sinks.stage_json_lines(what, path, order), path) for what, path, order in outputs]
    sinks.commit(staged)


def _records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if not sinks.exists(path):
        raise archive.SourceError(f"{path} does not exist")
    return records.read_records(spark, path, kind)


def _iso(made: DataFrame) -> DataFrame:
    stamp = lambda t: F.date_format(t["created_at"], "yyyy-MM-dd'T'HH:mm:ssxxx")
    turn = lambda t: F.struct(t["tweet_id"].alias("tweet_id"), t["author_id"].alias("author_id"), t["side"].alias("side"), stamp(t).alias("created_at"), t["text"].alias("text"))
    return made.withColumn("turns", F.transform("turns", turn))


def _one(df: DataFrame) -> str:
    return json.dumps(df.first().asDict(True), ensure_ascii=False)


def read_source(spark, a):
    r = archive.read_source_archive(spark, a.archive, a.output)
    return json.dumps({"extracted": r.extracted, "files": [vars(f) for f in r.files]})


def build_interactions(spark, a):
    sinks.distinct_paths(a.input, a.output)
    t = records.read_tweets(spark, a.input)
    _write((_iso(stitch.stitch(t, a.brand)), a.output, ["interaction_id"]))
    return _one(stitch.stitch_report(t, a.brand))


def filter_english(spark, a):
    sinks.distinct_paths(a.input, a.output)
    rows = _records(spark, a.input, "interactions")
    samples = json.loads(Path(a.samples).read_text())
    taught = spark.createDataFrame([(name, t) for name, texts in samples.items() for t in texts], "language string, text string")
    found = rows.join(language.detect(stitch.opening_text(rows), language.train(taught)), "interaction_id")
    _write((language.keep(found).drop("language"), a.output, ["interaction_id"]))
    return _one(language.report(found))


def sample_split(spark, a):
    sinks.both_or_neither(a.pool, a.holdout, "pools")
    sinks.distinct_paths(a.input, a.pool, a.holdout)
    got = sampling.sample_split(_records(spark, a.input, "interactions"), a.sample_size, a.holdout_size, a.seed)
    _write(*[(got.where(F.col("split") == s).drop("split"), p, ["interaction_id"]) for s, p in (("pool", a.pool), ("holdout", a.holdout)) if p])
    return _one(got.agg(F.count_if(F.col("split") == "pool").alias("pool"), F.count_if(F.col("split") == "holdout").alias("holdout")))


def label_closure(spark, a):
    sinks.distinct_paths(a.input, a.output)
    got = closure.label_interactions(_records(spark, a.input, "interactions"))
    _write((got, a.output, ["interaction_id"]))
    return _one(closure.closure_report(got))


def adjudicate_closures(spark, a):
    sinks.distinct_paths(a.interactions, a.labels, a.output)
    rows, own = _records(spark, a.interactions, "interactions"), _records(spark, a.labels, "closure_labels")
    joined = resolution.exact_join(rows, own).where("needs_adjudication")
    work = joined.select("interaction_id", inference.adjudication_prompt(F.col("turns"), F.col("reason"), V.CLOSURE_LABELS).alias("prompt"))
    said = inference.cached(work, a.log, a.make_model(), "Judge how the conversation ended. Reply with a JSON object with label and justification.", a.valid("label", V.CLOSURE_LABELS), current=_names("label", V.CLOSURE_LABELS))
    fields = inference.reply_fields(F.col("reply"), "label", V.CLOSURE_LABELS)
    final = resolution.merge_verdicts(own, said.select("interaction_id", fields["value"].alias("label"), fields["text"].alias("reason"), "model"))
    _write((final, a.output, ["interaction_id"]))
    return json.dumps([r.asDict() for r in resolution.adjudication_report(final).collect()])


def build_resolution_dataset(spark, a):
    sinks.distinct_paths(a.interactions, a.labels, a.output)
    made = resolution.build_dataset(_records(spark, a.labels, "final_labels"), _records(spark, a.interactions, "interactions"))
    _write((made, a.output, ["interaction_id"]))
    return json.dumps([r.asDict() for r in resolution.by_source(made).collect()])


def build_index(spark, a):
    import time

    began = time.perf_counter()
    rows, counts = vectors.build_index(_records(spark, a.input, "resolutions"), vectors.hashing_embedder(a.dim), a.dim)
    records.write_index(rows, a.output, f"trigram-hash-{a.dim}", a.dim, time.perf_counter() - began)
    return json.dumps(counts)


def retrieve(spark, a):
    docs, meta = records.read_index(spark, a.index)
    if not a.query.strip():
        return "[]"
    query = vectors.hashing_embedder(meta["embedding_dim"])()([a.query])[0]
    return json.dumps([r.asDict() for r in vectors.topk(docs, query, a.top_k).collect()])


def discover_intents(spark, a):
    seeds = taxonomy.seed_taxonomy(spark, Path(a.seeds).read_text())
    anchors = seeds.select("intent_id", F.col("definition").alias("message")).unionByName(seeds.select("intent_id", F.col("representative_message").alias("message")))
    rows = stitch.opening_text(stitch.with_opening(_records(spark, a.input, "interactions"))).select("interaction_id", "message")
    made = discovery.discover(rows, anchors, seeds, vectors.hashing_embedder(a.dim), a.make_model(), a.log, a.clusters, a.seed)
    report = reconcile.discovery_report(made, seeds)
    _write((made, a.output, ["cluster_id"]), (labels.discovery_markdown(report, made), a.review, []))
    return json.dumps([r.asDict() for r in report.collect()])


def _taxonomy(spark, path):
    return taxonomy.final_taxonomy(spark, Path(path).read_text(), *TAXONOMY_COLUMNS)


def reconcile_intents(spark, a):
    got = reconcile.reconcile(_records(spark, a.clusters, "clusters"), taxonomy.seed_taxonomy(spark, Path(a.seeds).read_text()), _taxonomy(spark, a.taxonomy))
    _write((got, a.output, ["ord"]))
    return _one(reconcile.covered_share(got))


def sample_golden(spark, a):
    final = _taxonomy(spark, a.taxonomy)
    names = [r[0] for r in final["intents"].select("intent_id").collect()]
    rows = stitch.opening_text(stitch.with_opening(_records(spark, a.input, "interactions")))
    rule = "Escalate what a reply cannot settle by itself: accounts, payments, safety, anger."
    work = rows.select("interaction_id", inference.intent_prompt(inference.definitions_text(final["intents"]), F.col("message"), rule).alias("prompt"))
    valid, current = a.valid("intent", names, decision=V.DECISIONS), _names("intent", names) & _names("decision", V.DECISIONS)
    said = inference.cached(work, a.log, a.make_model(THINKING_OFF), "Name the intent and whether to escalate. Reply with a JSON object with intent, decision (auto or escalate) and justification.", valid, current=current, stale="redo", attempts=3)
    found = inference.json_object(F.col("reply"))
    hints = said.select("interaction_id", F.get_json_object(found, "$.intent").alias("intent"), F.get_json_object(found, "$.decision").alias("decision"))
    queue = golden.plan_queue(hints, final["intents"].select("ord", F.col("intent_id").alias("intent")), a.target, a.floor, a.auto_share, a.seed)
    sinks.commit([(sinks.stage_json_lines(queue, a.output, ["queue_pos"], hide=["queue_pos"]), a.output)])
    return _one(queue.agg(F.count("*").alias("queued"), F.count_if(F.col("hint_decision") == "auto").alias("auto")))


def label_golden(spark, a):
    final = _taxonomy(spark, a.taxonomy)
    names = [r[0] for r in final["intents"].orderBy("ord").select("intent_id").collect()]
    queue = [json.loads(x) for x in Path(a.queue).read_text().splitlines() if x.strip()]
    rows = {r["interaction_id"]: r for r in _records(spark, a.input, "interactions").where(F.col("interaction_id").isin([q["interaction_id"] for q in queue])).collect()}
    items = [{**q, "message": rows[q["interaction_id"]]["turns"][0]["text"], "transcript": "\n".join(f"{t['side']:>8} {t['text']}" for t in rows[q["interaction_id"]]["turns"])} for q in queue]
    done = [json.loads(x) for x in Path(a.output).read_text().splitlines()] if Path(a.output).exists() else []
    save = lambda got: sinks.commit([(sinks.stage_text("".join(json.dumps(g) + "\n" for g in got), a.output), a.output)])
    got = golden.label_session(items, done, names, final["version"], input, print, save)
    return json.dumps({"labelled": len(got), "remaining": len(items) - len(got)})


def label_intents(spark, a):
    final = _taxonomy(spark, a.taxonomy)
    names = [r[0] for r in final["intents"].select("intent_id").collect()]
    pool = stitch.opening_text(_records(spark, a.input, "interactions"))
    part = sampling.dev_slice(pool, a.slice_size, a.seed)
    work = part.select("interaction_id", inference.intent_prompt(inference.definitions_text(final["intents"]), F.col("message")).alias("prompt"))
    said = inference.cached(work, a.log, a.make_model(), "Name the intent. Reply with a JSON object with intent and justification.", a.valid("intent", names), current=_names("intent", names))
    r = inference.reply_fields(F.col("reply"), "intent", names)
    own = said.join(part, "interaction_id").select("interaction_id", F.col("message").alias("customer_message"), r["value"].alias("intent"), F.lit("labeler").alias("source"), r["text"].alias("justification"), "model", F.lit(final["version"]).alias("taxonomy_version"))
    if a.corrections:
        own = labels.overlay(own, _records(spark, a.corrections, "corrections"), names)
    intents = final["intents"].select("ord", F.col("intent_id").alias("intent"))
    _write((own, a.output, ["interaction_id"]), (labels.review_report(own, intents), a.review, []))
    return json.dumps([x.asDict() for x in labels.distribution(own, intents).orderBy("ord").collect()])


def _names(choice: str, allowed) -> object:
    """Whether a logged reply names an allowed choice."""
    return F.get_json_object(inference.json_object(F.col("reply")), f"$.{choice}").isin(*allowed)


def smoke_model(spark, a):
    return a.make_model()()("Say hello.", "You are brief.", 0.0)[0]


#: Name, function, required options, options with defaults.
COMMANDS = {
    "smoke-llm": (smoke_model, (), {}),
    "read-source": (read_source, ("archive", "output"), {}),
    "build-interactions": (build_interactions, ("input", "output", "brand"), {}),
    "filter-english": (filter_english, ("input", "output", "samples"), {}),
    "sample-split": (sample_split, ("input",), {"pool": None, "holdout": None, "sample-size": V.SAMPLE_SIZE, "holdout-size": V.HOLDOUT_SIZE, "seed": V.SEED}),
    "label-closure": (label_closure, ("input", "output"), {}),
    "adjudicate-closures": (adjudicate_closures, ("interactions", "labels", "output", "log"), {}),
    "build-resolution-dataset": (build_resolution_dataset, ("interactions", "labels", "output"), {}),
    "build-minilm-index": (build_index, ("input", "output"), {"dim": 256}),
    "retrieve-minilm": (retrieve, ("index", "query"), {"top-k": V.TOP_K}),
    "discover-intents": (discover_intents, ("input", "seeds", "output", "review", "log"), {"clusters": V.CLUSTERS, "seed": V.SEED, "dim": 256}),
    "reconcile-intents": (reconcile_intents, ("clusters", "seeds", "taxonomy", "output"), {}),
    "sample-golden": (sample_golden, ("input", "taxonomy", "output", "log"), {"target": V.GOLDEN_TARGET, "floor": V.GOLDEN_FLOOR, "auto-share": V.AUTO_SHARE, "seed": V.SEED}),
    "label-golden": (label_golden, ("input", "taxonomy", "queue", "output"), {}),
    "label-intents": (label_intents, ("input", "taxonomy", "output", "review", "log"), {"corrections": None, "slice-size": V.DEV_SLICE, "seed": V.SEED}),
}


#: Sent with each request for a hint: a label is wanted, no reasoning.
THINKING_OFF = {"chat_template_kwargs": {"enable_thinking": False}}


def http_model(path: str | None = None, role: str = "labeler", extra: dict | None = None):
    """A chat model of the configured service; ``extra`` is added to each request."""

    def make():
        import urllib.error
        import urllib.request

        conf, key = config.load(path), config.api_key(("THREADMILL_API_KEY", "OPENAI_API_KEY"))

        def call(prompt: str, system: str, temperature: float) -> tuple[str, str]:
            body = {"model": conf["roles"][role], "temperature": temperature, **(extra or {}), "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
            ask = urllib.request.Request(f"{conf['base_url'].rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            try:
                with urllib.request.urlopen(ask, timeout=120) as r:
                    got = json.load(r)
            except urllib.error.HTTPError as e:
                raise inference.InferenceError(str(e), e.code) from e
            except urllib.error.URLError as e:
                raise ConnectionError(str(e)) from e
            if not got.get("choices"):
                raise inference.InferenceError("the service returned no choice")
            return got["choices"][0]["message"]["content"], got.get("model") or conf["roles"][role]

        return call

    return make


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="threadmill")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, needed, optional) in COMMANDS.items():
        p = sub.add_parser(name)
        for o in needed:
            p.add_argument(f"--{o}", required=True)
        for o, default in optional.items():
            p.add_argument(f"--{o}", default=default, type=type(default) if default is not None else str)
        p.add_argument("--config")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, make_model=None) -> int:
    a = parser().parse_args(argv)
    a.valid = inference.valid_reply
    a.make_model = lambda extra=None: make_model or http_model(a.config, extra=extra)
    try:
        print(COMMANDS[a.command][0](spark or session(), a))
    except ERRORS as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
