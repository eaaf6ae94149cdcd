"""Inference as an operator: prompts, a cached verdict log, repair retries, backoff, and validated replies.

The model is any callable ``(prompt, system, temperature) -> (text, model)``; each worker makes one. Only rows that the log
has no valid verdict for are sent; verdicts are written wave by wave and stay for later runs.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import gate
from ..functions.text import is_blank, json_object, prompt_hash, squeeze
from ..plans.staging import stage_table

Infer = Callable[[str, str, float], tuple[str, str]]
TRANSIENT = (408, 409, 425, 429)


class InferenceError(RuntimeError):
    """A call failed; ``status`` is the service's code if there is one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def with_backoff(call: Callable[[], tuple[str, str]], attempts: int = 5, base: float = 2.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: random.uniform(0.5, 1.5)) -> tuple[str, str]:
    """Repeat transient failures (timeouts, conflicts, limits, server errors, connections) after growing pauses."""
    for n in range(attempts):
        try:
            return call()
        except (InferenceError, ConnectionError) as e:
            status = getattr(e, "status", None)
            transient = isinstance(e, ConnectionError) or status in TRANSIENT or (status or 0) >= 500
            if not transient or n == attempts - 1:
                raise
            sleep(base * 2**n * jitter())
    raise AssertionError("no attempt was made")


def infer(work: DataFrame, make: Callable[[], Infer], system: str, valid: Callable[[str], str | None], attempts: int = 2, workers: int = 8, key: str = "interaction_id") -> DataFrame:
    """``key, prompt_sha256, reply, model, error`` for rows ``key, prompt``.

    ``valid(reply)`` says what is wrong with a reply (None: nothing); it is then asked for again with that remark. An
    error is kept with its row, so that verdicts of other rows are not lost.
    """

    def one(model: Infer, prompt: str) -> tuple[str | None, str | None, str | None]:
        said, remark = prompt, None
        for _ in range(attempts):
            try:
                reply, name = with_backoff(lambda s=said: model(s, system, 0.0))
            except (InferenceError, ConnectionError) as e:
                return None, None, f"call failed: {e}"
            remark = valid(reply)
            if remark is None:
                return reply, name, None
            said = f"{prompt}\n\nYour last reply was:\n{reply}\n\nIt is not valid: {remark}. Reply with the JSON object only."
        return None, None, f"invalid reply: {remark}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            if not len(b):
                continue
            model = model or make()
            got = [one(model, p) for p in b["prompt"]]
            yield pd.DataFrame({key: b[key], "prompt_sha256": b["prompt_sha256"], "reply": [g[0] for g in got], "model": [g[1] for g in got], "error": [g[2] for g in got]})

    asked = work.select(key, "prompt", prompt_hash(F.lit(system), F.col("prompt")).alias("prompt_sha256"))
    return asked.repartition(workers).mapInPandas(run, f"{key} long, prompt_sha256 string, reply string, model string, error string")


LOG = "prompt_sha256 string, reply string, model string, error string, recorded long"


def latest_valid(log: DataFrame, key: str) -> DataFrame:
    """``key, prompt_sha256, reply, model`` of the last record without an error of each row and prompt."""
    last = F.max_by(F.struct("reply", "model"), "recorded").alias("r")
    return log.where("error is null").groupBy(key, "prompt_sha256").agg(last).select(key, "prompt_sha256", "r.reply", "r.model")


def cached(
    work: DataFrame, log_path: str, make: Callable[[], Infer], system: str, valid: Callable[[str], str | None], key: str = "interaction_id",
    current: Column | None = None, stale: str = "raise", wave: int = 200, **options,
) -> DataFrame:
    """Verdicts of all rows, from the log where its prompt is the same, else inferred and appended to the log.

    ``current`` says of a logged ``reply`` whether it still holds (its choice may have left the taxonomy since): rows for which
    it does not are an error, or with ``stale="redo"`` inferred again. Rows are sent in waves of about ``wave``; each is appended before the next
    is sent, so a run that dies loses one wave at most. The last record of a row and prompt counts.
    """
    spark = work.sparkSession
    schema = f"{key} long, {LOG}"
    holds = F.lit(True) if current is None else F.coalesce(current, F.lit(False))
    asked = work.withColumn("prompt_sha256", prompt_hash(F.lit(system), F.col("prompt")))
    keys = [key, "prompt_sha256"]
    missing = asked
    if _exists(spark, log_path):
        known = latest_valid(spark.read.schema(schema).parquet(log_path), key)
        if stale == "raise":
            gate(known.where(~holds).join(asked.select(*keys), keys, "left_semi"), "logged verdicts that no longer hold", key)
        missing = asked.join(known.where(holds), keys, "left_anti")
    missing = stage_table(missing, "asked")
    waves = -(-missing.count() // wave)
    if waves > 1:  # each wave reads its own folder, not all rows again
        own = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(waves)).cast("int")
        missing = stage_table(missing.withColumn("_wave", own).repartition("_wave"), "waves", by=("_wave",))
    for k in range(waves):
        part = missing.where(F.col("_wave") == k).drop("_wave") if waves > 1 else missing
        infer(part, make, system, valid, key=key, **options).withColumn("recorded", F.lit(time.time_ns())).write.mode("append").parquet(log_path)
    if not waves and not _exists(spark, log_path):
        return spark.createDataFrame([], f"{key} long, prompt_sha256 string, reply string, model string")
    log = spark.read.schema(schema).parquet(log_path)
    got = latest_valid(log, key).where(holds)
    failed = stage_table(asked.join(got, keys, "left_anti").select(*keys), "failed")
    if not failed.isEmpty():
        why = log.where("error is not null").join(failed, keys).groupBy(key).agg(F.max_by("error", "recorded").alias("error")).orderBy(key).limit(5).collect()
        gate(failed, "rows without a verdict (" + "; ".join(f"{r[0]}: {r[1]}" for r in why) + ")", key)
    return got.join(asked.select(*keys), keys, "left_semi")


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def reply_fields(reply: Column, choice: str, allowed: Sequence[str], text: str = "justification") -> Column:
    """``value, text, error`` of a reply: its object must name an allowed choice and say why."""
    found = json_object(reply)
    value, said = F.get_json_object(found, f"$.{choice}"), squeeze(F.get_json_object(found, f"$.{text}"))
    error = (
        F.when(found.isNull(), "no JSON object")
        .when(value.isNull() | ~value.isin(*allowed), f"unknown {choice}")
        .when(is_blank(said), f"no {text}")
    )
    return F.struct(value.alias("value"), said.alias("text"), error.alias("error"))


def object_in(reply: str) -> dict | None:
    """The JSON object in a reply, as ``functions.text.json_object`` finds it: without code fences, else from the first ``{`` to the last ``}``."""
    bare = re.sub(r"(?i)^```(?:json)?\s*|\s*```$", "", reply.strip()).strip()
    for text in (bare, bare[bare.find("{") : bare.rfind("}") + 1]):
        try:
            got = json.loads(text)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return None


def valid_reply(choice: str, allowed: Sequence[str], **more: Sequence[str]) -> Callable[[str], str | None]:
    """What is wrong with a reply, for the repair prompt; ``more`` are further choices and what they may be. All stages judge replies by this."""
    choices = {choice: list(allowed), **{k: list(v) for k, v in more.items()}}

    def check(reply: str) -> str | None:
        got = object_in(reply)
        if got is None:
            return "no JSON object"
        for name, values in choices.items():
            if got.get(name) not in values:
                return f"unknown {name}"
        said = got.get("justification")
        return None if isinstance(said, str) and said.strip() else "no justification"

    return check


#: How a conversation may have ended, for the model that judges it.
ENDINGS = {
    "resolved": "the customer's problem was solved, or the customer says so",
    "uncertain": "the turns do not show how it ended, for it goes on elsewhere or stops",
    "unresolved": "the problem was left open, or the customer says that it remains",
}


def adjudication_prompt(turns: Column, flag: Column, labels: Sequence[str] = ()) -> Column:
    """The labels with their meaning, why the rules could not decide, and the conversation as numbered lines."""
    meant = "".join(f"- {x}: {ENDINGS.get(x, x.replace('_', ' '))}\n" for x in labels)
    rules = f"Labels:\n{meant}\nJudge by the last turns first; a promise is no solution, and thanks alone are none.\n\n" if labels else ""
    lines = F.array_join(F.transform(turns, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t["side"], F.lit(": "), t["text"])), "\n")
    return F.concat(F.lit(f"{rules}Flag: "), flag, F.lit("\n\n"), lines)


def intent_prompt(definitions: str, message: Column, rules: str = "") -> Column:
    """The intents with their definitions, further rules, and the message."""
    return F.concat(F.lit(f"Intents:\n{definitions}\n\n" + (f"{rules}\n\n" if rules else "") + "Message: "), message)


#: What the verdict on a cluster may be, besides one of the intents.
CLUSTER_RULES = """How to choose:
- an intent's id, if most of the messages ask for what its definition says;
- new, if they share one concern that support has to act on and no definition covers it;
- junk, if none of them holds a problem or a request: thanks, jokes, advertising, a lone name or greeting. A message may be short and still name a problem.
What the messages say counts; the similarities are a hint, and a weak one where messages are short. The fallback intent is no choice."""


def cluster_prompt(size: Column, examples: Column, candidates: Column, definitions: str = "", rules: str = "") -> Column:
    """The intents with their definitions, how to choose, further rules, and the cluster: its size, its examples and its candidate intents."""
    said = F.array_join(F.transform(examples, lambda e: F.concat(F.lit("- "), e["message"])), "\n")
    names = F.array_join(F.transform(candidates, lambda c: F.concat(c["intent_id"], F.lit(" "), F.format_number(c["similarity"], 6))), "\n")
    head = (f"Intents:\n{definitions}\n\n" if definitions else "") + CLUSTER_RULES + (f"\n{rules}" if rules else "")
    count = F.concat(F.lit("\n\nThe cluster has "), size.cast("string"), F.lit(" messages; the "), F.size(examples).cast("string"), F.lit(" nearest to its middle:\n"))
    return F.concat(F.lit(head), count, said, F.lit("\n\nCandidates, most similar first:\n"), names)


def definitions_text(intents: DataFrame) -> str:
    return "\n".join(f"- {r['intent_id']}: {r['definition']}" for r in intents.orderBy("ord").collect())


def hint_is_current(known: Sequence[str], digest: Column) -> Column:
    """A hint counts if its intent and decision are known and its prompt, if it has one, is the present one."""
    return F.col("intent").isin(*known) & F.col("decision").isin("auto", "escalate") & (F.col("prompt_sha256").isNull() | (F.col("prompt_sha256") == digest))
