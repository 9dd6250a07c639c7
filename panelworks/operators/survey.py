"""Running sessions through a model: prompts, answers, status, logs; and the same for attribute inference.

A row is a whole session, so what must be asked in order is.  A task keeps a bounded window of sessions in flight and takes the next
one as soon as any ends; results leave it in the order in which they end.  ``run_survey`` is one job.  ``run_to_log`` runs a survey bucket
by bucket of agents, appends every finished session to a durable log at once, and asks only what the log lacks, so what a
failure costs is the sessions in hand.  What is asked once of each agent, before any condition, is a table of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import traceback
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from functools import cached_property
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import recode as R
from ..functions import vocab
from ..sources import readers, sinks
from ..sources.recordlog import RecordLog, Work
from .budget import not_done
from .models import ChatResult, DummyClient, FixedClient, ModelError, RetryableModelError, make_client
from .session import pairs, pretreatment_plan, session_plan, with_steps

__all__ = ["ChatResult", "DummyClient", "FixedClient", "ModelError", "RetryableModelError", "make_client"]

PRE = "__pretreatment__"


@dataclass
class RunOptions:
    conditions: list[str] | None = None
    battery_steps: int = 1
    battery_mode: str = "sequential"
    pretreatment: bool = False
    include_demographics: bool = True
    explanation_style: str = "brief"
    max_attempts: int = 3
    seed: int = 7
    #: Sessions in flight at the same time, all tasks together; None: in_flight of each task, and as many tasks as the cluster has slots.
    workers: int | None = None
    #: Sessions that one task has in flight at the same time.
    in_flight: int = 16
    #: Independent steps of one session in flight at the same time.
    independent_concurrency: int = 1
    store_prompts: str = "hash"  # or full
    cleanup: bool = False
    system: str | None = None
    #: Sessions of a bucket of run_to_log's log, about.
    batch_sessions: int = 500
    #: Whether answers are logged as the model gave them.
    keep_raw: bool = True
    #: Wording by key: pages, item questions and anchors, templates.  What is missing is made from the key.
    texts: dict = field(default_factory=dict)

    @cached_property
    def pages(self) -> dict:
        """Pages made so far, by element and, where it is answered, its answer: sessions show the same ones again and again."""
        return {}

    @cached_property
    def asked(self) -> dict:
        """Pages to be answered made so far and their titles, by element."""
        return {}


# --- Prompts ---------------------------------------------------------------------------------------------------------

def scale_text(key: str, texts: dict) -> str:
    if key in vocab.CHOICES:
        return "\n".join(f"{s}) {label}" for s, label, _ in vocab.CHOICES[key]) + "\nAnswer with exactly one of the symbols above."
    low, high = texts.get(f"{key}:low", "lowest"), texts.get(f"{key}:high", "highest")
    return f'Slider from 0 = "{low}" to 100 = "{high}". Answer with an integer between 0 and 100.'


def item_text(key: str, texts: dict) -> str:
    return texts.get(key) or key.replace("_", " ")


def page(body: str) -> str:
    return "--- Page ---\n" + body


def seen_page(e: str, given: str | None, texts: dict) -> str:
    kind, _, key = e.partition(":")
    if kind == "p":
        return page(texts.get(key, f"[{key}]"))
    label = {s: label for s, label, _ in vocab.CHOICES.get(key, [])}
    reply = texts.get("unanswered", "left blank") if given is None else label.get(given, given)
    return page(f"{item_text(key, texts)}\n{texts.get('reply', 'Their answer:')} {reply}")


def asked_page(e: str, texts: dict) -> str:
    return seen_page(e, None, texts) if e.startswith("p:") else page(f"{vocab.title(e[2:])}:\n{item_text(e[2:], texts)}\n{scale_text(e[2:], texts)}")


def made_once(pages: dict, make: Callable, *of) -> str:
    """make(*of, ...) of a few elements and answers, out of pages where it is there."""
    name = (make, *of[:-1])
    if (text := pages.get(name)) is None:
        text = pages[name] = make(*of)
    return text


def seen_text(elements: list[str], answers: dict, o: RunOptions) -> str:
    """Pages already shown, items with the answers given."""
    return "\n\n".join([made_once(o.pages, seen_page, e, answers.get(e[2:]) if e.startswith("i:") else None, o.texts) for e in elements])


def demographics_text(d: dict, state: str | None) -> str:
    return "\n".join([*(f"{k.replace('_', ' ')}: {d[k]}" for k in vocab.MODERATORS), f"US state of residence: {state or 'unknown'}"])


def step_prompt(persona: dict, prefix: list[str], earlier: list[str], elements: list[str], answers: dict, o: RunOptions) -> str:
    """The message of one step: the person, what they have seen and answered, and the items to answer now.  Pages before the first
    item belong to what they have seen."""
    first = next(i for i, e in enumerate(elements) if e.startswith("i:"))
    asked = o.asked
    shown = [asked.get(e) or asked.setdefault(e, (asked_page(e, o.texts), vocab.title(e[2:]) if e.startswith("i:") else None)) for e in elements[first:]]
    now, titles = "\n\n".join([text for text, _ in shown]), [title for _, title in shown if title]
    t = lambda k, default: o.texts.get(k, default)
    explain = {"brief": "Explain each answer in one sentence.", "long": "Explain each answer in detail.", "none": "Leave explanations empty."}[o.explanation_style]
    return "\n\n".join([
        t("preamble", "Answer a survey as the user described below would."), "=== USER DATA ===",
        *([demographics_text(persona["demographics"], persona.get("assigned_state"))] if o.include_demographics else []), persona["profile_text"], "=== SURVEY SESSION ===",
        seen_text([*prefix, *earlier, *elements[:first]], answers, o), "=== YOUR TASK ===", t("instructions", "Answer every title."), "BEGIN SURVEY ITEMS", now, "END SURVEY ITEMS",
        t(f"explanation_{o.explanation_style}", explain), t("output_format", "For each title:\n**title: TITLE**\n**explanation: ...**\n**answer: ...**\n**speculation: 0-100**"),
        f"There are {len(titles)} titles to answer: {', '.join(titles)}.",
    ])


def cleanup_prompt(raw: str, items: list[str]) -> str:
    return f"Rewrite the answers below in the exact output format, for the titles {', '.join(map(vocab.title, items))}. Change no answer.\n\n{raw}"


# --- Answering -------------------------------------------------------------------------------------------------------

def stable_seed(*parts) -> int:
    return int(hashlib.sha256("||".join(map(str, parts)).encode()).hexdigest()[-8:], 16)


def gaps(parsed: dict) -> int:
    """Items that a parse lacks."""
    return len(parsed["missing"]) + len(parsed["invalid"])


_CALL_FIELDS = {
    "step": "int", "step_name": "string", "attempt": "int", "kind": "string", "model": "string", "provider": "string", "prompt": "string", "prompt_sha256": "string",
        "response": "string", "error": "string",
    "input_tokens": "bigint", "output_tokens": "bigint", "cached_tokens": "bigint", "latency_s": "double", "finish_reason": "string",
    "parse_missing": "array<string>", "parse_invalid": "array<string>", "parse_duplicated": "array<string>",
}
CALL = f"struct<{','.join(f'{k}:{v}' for k, v in _CALL_FIELDS.items())}>"
_TOKENS = ("input_tokens", "output_tokens", "cached_tokens")


class Asker:
    """Asks one model on behalf of one agent in one condition, and keeps a record of every call; hashed: with its prompt's hash."""

    def __init__(self, model, persona: dict, condition: str, o: RunOptions, tidy=None, hashed: bool = True):
        self.model, self.persona, self.condition, self.o, self.hashed = model, persona, condition, o, hashed
        self.tidy = tidy if tidy is not None else model if o.cleanup else None
        self.calls: list[dict] = []

    def step(self, number: int, name: str, elements: list[str], items: list[str], prefix: list[str], earlier: list[str], known: dict) -> dict | None:
        """The most complete of the parses that up to max_attempts tries give, the first of equals; None if none gave any."""
        prompt = step_prompt(self.persona, prefix, earlier, elements, known, self.o)
        parses: list[dict] = []
        for attempt in range(1, self.o.max_attempts + 1):
            record = {"step": number, "step_name": name, "attempt": attempt}
            seed = stable_seed(self.o.seed, self.persona["profile_id"], self.condition, f"{number}:{attempt}")
            text, parse = self._parsed(self.model, "primary", prompt, items, seed, None, record)
            if parse is None:
                continue
            parses.append(parse)
            if gaps(parse) and self.tidy is not None:
                _, tidied = self._parsed(self.tidy, "cleanup", cleanup_prompt(text, items), items, seed, 0.0, record)
                if tidied is not None:
                    for key, item in tidied["items"].items():
                        item["explanation"] = item["explanation"] or parse["items"].get(key, {}).get("explanation", "")
                    parses.append(tidied)
            if not all(map(gaps, parses)):
                break
        return min(parses, key=gaps, default=None)

    def _parsed(self, model, kind: str, prompt: str, items: list[str], seed: int, temperature: float | None, record: dict) -> tuple[str, dict | None]:
        call = dict.fromkeys(_CALL_FIELDS) | record | {"kind": kind, "model": model.model, "provider": model.provider}
        if self.hashed:
            call["prompt_sha256"] = hashlib.sha256(prompt.encode()).hexdigest()
        if self.o.store_prompts == "full":
            call["prompt"] = prompt
        self.calls.append(call)
        try:
            r = model.chat(prompt, seed, temperature, self.o.system)
        except ModelError as e:
            call |= {"error": str(e)[:2000], **dict.fromkeys(_TOKENS, 0)}
            return "", None
        parse = A.parse_answers(r.text, items)
        call |= {k: getattr(r, k) for k in (*_TOKENS, "latency_s", "finish_reason")} | {"response": r.text if self.o.keep_raw else None,
            **{f"parse_{k}": parse[k] for k in ("missing", "invalid", "duplicated")}}
        return r.text, parse


class _Sheet:
    """What a session has answered so far."""

    def __init__(self):
        self.answers, self.speculation, self.explanations, self.statuses = {}, {}, {}, []

    def take(self, parse: dict | None) -> None:
        self.statuses.append("failed" if parse is None else "partial" if gaps(parse) else "complete")
        for key, item in (parse["items"] if parse else {}).items():
            if item["ok"]:
                self.answers[key], self.explanations[key] = item["answer"], item["explanation"]
                if item["speculation"] is not None:
                    self.speculation[key] = item["speculation"]

    def status(self, wanted: list[str]) -> str:
        if "failed" in self.statuses:
            return "failed"
        return "complete" if set(self.statuses) <= {"complete"} and all(k in self.answers for k in wanted) else "partial"


_BLOCK_OF = {item: key for _, key, items in vocab.BLOCKS for item in items}


def run_session(asker: Asker, prefix: list[str], steps: list[dict], pre: dict | None = None) -> dict:
    """One agent in one condition.  Steps that follow each other in order see all earlier answers; independent ones see those of the
    treatment alone, and may be asked together."""
    sheet, earlier, o = _Sheet(), [], asker.o
    numbered = list(enumerate(steps))
    ordered = [(n, s) for n, s in numbered if not s["independent"]]
    apart = [(n, s) for n, s in numbered if s["independent"]]

    def ask(n: int, s: dict, known: dict) -> dict | None:
        return asker.step(n, s["step_name"], s["elements"], s["items"], prefix, earlier, {**(pre or {}), **known})

    for n, s in ordered:
        sheet.take(ask(n, s, sheet.answers))
        if sheet.statuses[-1] == "failed":
            apart = []
            break
        earlier.extend(s["elements"])
    if apart:
        known = dict(sheet.answers)
        if o.independent_concurrency > 1:
            with ThreadPoolExecutor(o.independent_concurrency) as pool:
                for parse in pool.map(lambda x: ask(*x, known), apart):
                    sheet.take(parse)
        else:
            for n, s in apart:
                sheet.take(ask(n, s, known))
                if sheet.statuses[-1] == "failed":
                    break
    order = dict.fromkeys(_BLOCK_OF[i] for s in steps for i in s["items"] if i in _BLOCK_OF)
    return {"answers": sheet.answers, "speculation": sheet.speculation, "explanations": sheet.explanations, "status": sheet.status(vocab.ITEM_KEYS),
            "missing_outcome_items": [k for k in vocab.ITEM_KEYS if k not in sheet.answers], "n_steps": len(steps),
            "session_meta": {"battery_mode": o.battery_mode, "block_order": list(order), "pretreatment_order": [e[2:] for e in prefix if e.startswith("i:")]}}


_MAPS = "answers map<string,string>, speculation map<string,int>, explanations map<string,string>"
RESPONSE = (f"profile_id string, condition string, codename string, model string, provider string, {_MAPS}, status string, missing_outcome_items array<string>, n_steps int, n_calls int, seconds double, "
            "session_meta struct<battery_mode:string,block_order:array<string>,pretreatment_order:array<string>>, "
            f"demographics map<string,string>, assigned_state string, year_birth int, calls array<{CALL}>")
PRETREATMENT = f"profile_id string, {_MAPS}, block_order array<string>, status string, n_calls int, seconds double, calls array<{CALL}>"


def _names(schema: str) -> list[str]:
    return re.findall(r"(?:^|, )(\w+) ", schema)


def _person() -> list:
    """What a session needs of its agent."""
    return [F.to_json("demographics").alias("demographics"), "assigned_state", "year_birth", "profile_text"]


def _people(personas: DataFrame) -> DataFrame:
    return personas.select("profile_id", *_person())


def in_flight(rows: Iterator, work: Callable, window: int) -> Iterator:
    """work of each row, in the order in which they end.  At most ``window`` rows are at work or taken from rows ahead of it; with a
    window of one they are worked on one after another, without threads."""
    if window == 1:
        yield from map(work, rows)
        return
    with ThreadPoolExecutor(window) as pool:
        running = set()
        for r in rows:
            running.add(pool.submit(work, r))
            if len(running) >= window:
                ended, running = wait(running, return_when=FIRST_COMPLETED)
                yield from (f.result() for f in ended)
        while running:
            ended, running = wait(running, return_when=FIRST_COMPLETED)
            yield from (f.result() for f in ended)


def dealt(rows: DataFrame, workers: int | None, window: int, *keys: str) -> tuple[DataFrame, int]:
    """(rows in as many partitions as tasks may ask at once, the window of each).  The number is given, so that adaptive execution
    doesn't merge partitions that are small in bytes and long in calls."""
    slots = rows.sparkSession.sparkContext.defaultParallelism
    tasks = slots if workers is None else min(slots, -(-workers // window))
    return rows.repartition(tasks, *keys), window if workers is None else max(1, workers // tasks)


#: Records that leave a task together: one by one, making a table of each would cost more than what a quick client does.
_TOGETHER = 128


def _batches(records: Iterator[dict], columns: list[str]) -> Iterator[pd.DataFrame]:
    for some in iter(lambda: list(islice(records, _TOGETHER)), []):
        yield pd.DataFrame([[r.get(c) for c in columns] for r in some], columns=columns, dtype=object)


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches as dicts, a few at a time: a batch of long texts is large."""
    for batch in batches:
        for at in range(0, batch.num_rows, _TOGETHER):
            yield from batch.slice(at, _TOGETHER).to_pylist()


def _arrow(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records as Arrow batches; a map is given as pairs."""
    maps = [f.name for f in schema if pa.types.is_map(f.type)]
    for some in iter(lambda: list(islice(records, _TOGETHER)), []):
        told = {f.name: [r.get(f.name) for r in some] for f in schema}
        told |= {c: [None if v is None else list(v.items()) for v in told[c]] for c in maps}
        yield pa.RecordBatch.from_arrays([pa.array(told[f.name], f.type) for f in schema], schema=schema)


def _asked(rows: DataFrame, schema: str, o: RunOptions, client: Callable[[], object], ask: Callable, tidy: Callable[[], object] | None, log: Work | None = None,
    stamps: dict | None = None, then: Callable[[DataFrame], DataFrame] = lambda df: df, wanted: list[str] | None = None) -> DataFrame:
    """rows, dealt out, made ready by then, and asked session by session: ask(asker, row) gives a record; what goes wrong in one is
    recorded and stops none of the others.  wanted: columns of the records that leave Python; None: all.

    With a log, tasks append the records to it, with stamps, and give ``keys, status, segment`` instead."""
    columns, keys = _names(schema), log.keys if log else ()
    spread, window = dealt(rows, o.workers, o.in_flight, *[k for k in ("profile_id", "condition") if k in rows.columns])
    empty = rows.sparkSession.createDataFrame([], ", ".join(f"{k} string" for k in (*keys, "status", "segment")) if log else schema)
    gives = empty if wanted is None or log else empty.select(*wanted)
    hashed = bool(log) or "calls" in gives.columns
    arrow = gives.toArrow().schema

    def asked(model, second, r: dict) -> dict:
        person = {"profile_id": r["profile_id"], "demographics": json.loads(r["demographics"]), "assigned_state": r["assigned_state"], "profile_text": r["profile_text"]}
        asker = Asker(model, person, r.get("condition", PRE), o, second, hashed)
        began = time.monotonic()
        try:
            made = ask(asker, r)
        except Exception:
            made = {"status": "failed", "answers": {}, "speculation": {}, "explanations": {}, "missing_outcome_items": list(vocab.ITEM_KEYS)}
            asker.calls.append(dict.fromkeys(_CALL_FIELDS) | {"kind": "session", "error": traceback.format_exc()[-2000:], **dict.fromkeys(_TOKENS, 0)})
        told = {k: r.get(k) for k in ("profile_id", "condition", "codename", "assigned_state", "year_birth")}
        told |= {"model": model.model, "provider": model.provider, "demographics": person["demographics"], "n_calls": len(asker.calls), "calls": asker.calls,
            "seconds": round(time.monotonic() - began, 2)}
        return told | made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, second = client(), tidy() if tidy else None
        at_work = 1 if all(getattr(m.chat, "at_once", False) for m in (model, second) if m) else window
        records = _dicts(batches)
        if log is None:
            yield from _arrow(in_flight(records, lambda r: asked(model, second, r), at_work), arrow)
            return
        at = TaskContext.get()
        # Attempts of a task and of its stage count as one series.
        attempt = at.attemptNumber() + 100 * at.stageAttemptNumber() if hasattr(at, "stageAttemptNumber") else at.attemptNumber()
        segment, before = log.segment(at.partitionId(), attempt), log.earlier(at.partitionId(), attempt)
        name = lambda r: tuple(r[k] for k in keys)
        told = lambda key, status, where: dict(zip(keys, key, strict=True)) | {"status": status, "segment": where}
        todo = []
        try:
            def left() -> Iterator[dict]:
                for r in records:
                    if name(r) in before:
                        todo.append(told(name(r), *before[name(r)]))
                    else:
                        yield r

            def kept() -> Iterator[dict]:
                for made in in_flight(left(), lambda r: asked(model, second, r), at_work):
                    now = datetime.now(UTC)
                    segment.append({c: _plain(made.get(c)) for c in columns} | (stamps or {}) | {"timestamp": now.isoformat(timespec="seconds"), "seq": int(now.timestamp() * 1e6)})
                    yield told(name(made), made["status"], segment.name)
                yield from todo

            yield from _arrow(kept(), arrow)
        finally:
            segment.close()

    return then(spread).mapInArrow(run, gives.schema)


def _plain(value):
    """A value as JSON knows it: no numpy numbers, no NaN."""
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and value != value else value


def run_pretreatment(personas: DataFrame, client: Callable[[], object], options: RunOptions | None = None, tidy: Callable[[], object] | None = None,
    log: Work | None = None, stamps: dict | None = None) -> DataFrame:
    """Answers before any treatment, asked once of each agent, in the agent's own order."""
    o = options or RunOptions()
    rows = pretreatment_plan(personas, o.seed).join(_people(personas), "profile_id")

    def ask(asker: Asker, r: dict) -> dict:
        sheet, items = _Sheet(), list(r["items"])
        sheet.take(asker.step(0, "pretreatment", list(r["elements"]), items, [], [], {}))
        return {"answers": sheet.answers, "speculation": sheet.speculation, "explanations": sheet.explanations, "status": sheet.status(items), "block_order": items}

    return _asked(rows, PRETREATMENT, o, client, ask, tidy, log, stamps)


def run_survey(personas: DataFrame, client: Callable[[], object], options: RunOptions | None = None, done: DataFrame | None = None, pretreatment: DataFrame | None = None,
               tidy: Callable[[], object] | None = None, log: Work | None = None, stamps: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """Responses, one row per agent and condition that ``done`` (``profile_id, condition``) lacks.  client makes a client on an executor, and
    tidy another one for cleanup.  pretreatment: what run_pretreatment gave, already written; only complete rows are used.  log: append
    responses to it and give their keys and statuses.  columns: those of a response that are wanted; all sessions run whole, but nothing
    else is brought back of them."""
    o = options or RunOptions()
    rows = pairs(personas, o.conditions, *_person())
    if done is not None:
        rows = not_done(rows, done, ["profile_id", "condition"])
    if pretreatment is not None:
        before = pretreatment.where("status = 'complete'").groupBy("profile_id").agg(F.to_json(F.max_by("answers", "n_calls")).alias("pre"))
        rows = rows.join(before, "profile_id", "left")

    def ready(df: DataFrame) -> DataFrame:
        made = with_steps(df, o.seed, o.battery_steps, o.battery_mode, o.pretreatment)
        return made.withColumn("steps", F.to_json("steps")).drop("ord", "seed")

    def ask(asker: Asker, r: dict) -> dict:
        steps = [s | {"step_name": s["name"], "items": [e[2:] for e in s["elements"] if e.startswith("i:")]} for s in json.loads(r["steps"])]
        return run_session(asker, r["prefix"], steps, json.loads(r["pre"]) if r.get("pre") else None)

    return _asked(rows, RESPONSE, o, client, ask, tidy, log, stamps, ready, columns)


def run_to_log(spark: SparkSession, personas: DataFrame, client: Callable[[], object], out: str, options: RunOptions | None = None, run_id: str = "run",
               tidy: Callable[[], object] | None = None, told: Callable[[str], None] = print) -> dict:
    """Runs what the logs under out lack, bucket by bucket of agents; returns the summary of the run.

    A bucket reads its own personas, keys and statuses, whatever the log has come to."""
    o, began = options or RunOptions(), time.monotonic()
    each = len(o.conditions or vocab.CONDITIONS)
    agents = personas.count()
    stamps, more = {"run_id": run_id}, ", run_id string, timestamp string, seq bigint"
    responses = RecordLog(spark, f"{out}/responses-{run_id}.jsonl", ["profile_id", "condition"], RESPONSE + more, max(1, -(-agents * each // o.batch_sessions)))
    before = RecordLog(spark, f"{out}/pretreatment-{run_id}.jsonl", ["profile_id"], PRETREATMENT + more, responses.buckets)
    # Personas by bucket, so a bucket reads its own.
    staged = f"{out}/agents-{run_id}-{uuid.uuid4().hex}"
    personas.withColumn("bucket", responses.bucket("profile_id")).repartition("bucket").write.partitionBy("bucket").parquet(staged)
    for i in range(responses.buckets):
        if readers.exists(spark, f"{staged}/bucket={i}"):
            some = spark.read.parquet(f"{staged}/bucket={i}")
            pre = None
            if o.pretreatment:
                done = before.done(i)
                before.commit(run_pretreatment(some if done is None else not_done(some, done, ["profile_id"]), client, o, tidy, before.work(i), stamps), i)
                pre = before.records(i)
            responses.commit(run_survey(some, client, o, responses.done(i), pre, tidy, responses.work(i), stamps), i)
        spent = (time.monotonic() - began) / 60
        told(f"[{run_id}] bucket {i + 1} of {responses.buckets}, {spent:.1f} min, {spent / (i + 1) * (responses.buckets - i - 1):.1f} min to go")
    made, pre = responses.records(), before.records()
    counts = {r.status: r.n for r in made.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()} if made is not None else {}
    summary = {"run_id": run_id, "n_agents": agents, "conditions": o.conditions or vocab.CONDITIONS, **{f"n_{k}": counts.get(k, 0) for k in ("complete", "partial", "failed")},
               "elapsed_min": round((time.monotonic() - began) / 60, 2), "usage": usage(made, pre).first().asDict() if made is not None else {}, "options": asdict(o)}
    return summary


def call_rows(responses: DataFrame, pretreatment: DataFrame | None = None) -> DataFrame:
    """A row per model call, those before the treatment included."""
    some = responses.select("profile_id", "condition", F.inline("calls"))
    if pretreatment is not None:
        some = some.unionByName(pretreatment.select("profile_id", F.lit(PRE).alias("condition"), F.inline("calls")))
    return some


def usage(responses: DataFrame, pretreatment: DataFrame | None = None) -> DataFrame:
    """Calls, tokens and failures of a run."""
    c = call_rows(responses, pretreatment)
    return c.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failures"), *[F.sum(n).alias(n) for n in _TOKENS])


def prompts_of(personas: DataFrame, profile_id: str, condition: str, options: RunOptions | None = None) -> list[tuple[str, str]]:
    """(step name, prompt) of each step of one session, earlier items answered by a stand-in: 50, or the first option."""
    o = options or RunOptions()
    one = personas.where(F.col("profile_id") == profile_id)
    steps = session_plan(one, o.seed, [condition], o.battery_steps, o.battery_mode, o.pretreatment).orderBy("step").collect()
    who = _people(one).first()
    person = {"profile_id": profile_id, "demographics": json.loads(who.demographics), "assigned_state": who.assigned_state, "profile_text": who.profile_text}
    stand_in = lambda k: vocab.CHOICES[k][0][0] if k in vocab.CHOICES else "50"
    answers = {e[2:]: stand_in(e[2:]) for e in steps[0].prefix if e.startswith("i:")}
    out, earlier = [], []
    for s in steps:
        out.append((s.step_name, step_prompt(person, list(s.prefix), earlier, list(s.elements), answers, o)))
        if not s.independent:
            answers |= {k: stand_in(k) for k in s["items"]}
            earlier += s.elements
    return out


# --- Attribute inference ----------------------------------------------------------------------------------------------

def inference_prompt(mould: str, background: str, levels: dict[str, list[str]], order: list[str]) -> str:
    wanted = "\n".join(f"- {name}: one of {json.dumps(levels[name], ensure_ascii=False)}" for name in order)
    return "\n\n".join(x for x in [background, "Records of one author, oldest first:\n" + mould,
        "For each attribute give reasoning, top_guess, up to two alternates and a confidence from 0 to 100, as one JSON object:\n" + wanted] if x)


def response_schema(levels: dict[str, list[str]]) -> dict:
    """The JSON schema of an inference answer, for endpoints that can hold a model to one."""
    part = lambda known: {"type": "object", "required": ["reasoning", "top_guess", "alternates", "confidence"], "properties": {
        "reasoning": {"type": "string"}, "top_guess": {"enum": known}, "alternates": {"type": "array", "items": {"enum": known}, "maxItems": 2},
            "confidence": {"type": "number", "minimum": 0, "maximum": 100}}}
    return {"type": "object", "required": list(levels), "properties": {m: part(known) for m, known in levels.items()}}


INFERRED = "author string, model_used string, status string, " + ", ".join(f"{m} string, {m}_confidence double, {m}_alternates string" for m in vocab.MODERATORS) + ", raw_response string"


def infer_attributes(moulds: DataFrame, client: Callable[[], object], seed: int = 42, workers: int | None = None, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Levels guessed for each author from ``author, mould[, background]``: success, refusal, malformed_json or error.  A malformed
    answer is asked for once more in the right form."""
    levels = levels or vocab.MODERATORS
    refusals = [re.compile(p, re.I) for p in vocab.REFUSALS]
    columns = [c.split(" ")[0] for c in INFERRED.split(", ")]

    def one(model, r: dict) -> dict:
        order = sorted(levels, key=lambda k: stable_seed(seed, r["author"], k))
        prompt = inference_prompt(r["mould"], r.get("background") or "", levels, order)
        row = dict.fromkeys(columns) | {"author": r["author"], "model_used": model.model}
        try:
            text = model.chat(prompt, stable_seed(seed, r["author"])).text
            guess = A.last_valid_guess(text, levels)
            if guess is None and not any(p.search(text) for p in refusals):
                text = model.chat(prompt + "\n\nAnswer with the JSON object only.", stable_seed(seed, r["author"], "again")).text
                guess = A.last_valid_guess(text, levels)
        except ModelError as e:
            return row | {"status": "error", "raw_response": str(e)[:2000]}
        row["raw_response"] = text
        if guess is None:
            return row | {"status": "refusal" if any(p.search(text) for p in refusals) else "malformed_json"}
        for m in levels:
            row |= {m: guess[m]["top_guess"], f"{m}_confidence": float(guess[m]["confidence"]), f"{m}_alternates": ";".join(guess[m].get("alternates", []))}
        return row | {"status": "success"}

    spread, window = dealt(moulds, workers, RunOptions.in_flight, "author")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        yield from _batches(in_flight((r for batch in batches for r in batch.to_dict("records")), lambda r: one(model, r), window), columns)

    return spread.mapInPandas(run, INFERRED)


def seed_column(seed: int, *parts):
    return R.seed(F.lit(str(seed)), *parts)
