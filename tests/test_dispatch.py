"""Model calls in flight, and the durable log: what is lost, what is asked again, what is read."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from panelworks.functions import vocab
from panelworks.operators import models, survey
from panelworks.operators.budget import not_done
from panelworks.sources import readers, recordlog


def people(spark, n):
    agents = readers.synthetic_agents(spark, n)
    return agents.select("profile_id", F.struct(*vocab.MODERATORS).alias("demographics"), "assigned_state", F.lit(1).alias("state_case"), "year_birth", F.concat(F.lit("text "), "profile_id").alias("profile_text"))


def slow(pause, folder=None):
    """A stand-in that takes its time and notes how many calls are in flight in its process."""

    class Slow(models.DummyClient):
        def __init__(self):
            import threading

            self.lock, self.now, self.most = threading.Lock(), 0, 0

        def chat(self, prompt, seed, temperature=None, system=None):
            with self.lock:
                self.now += 1
                self.most = max(self.most, self.now)
                if folder:
                    with open(f"{folder}/{os.getpid()}", "w") as f:
                        f.write(str(self.most))
            time.sleep(pause)
            with self.lock:
                self.now -= 1
            return models.DummyClient.chat(self, prompt, seed, temperature, system)

    return Slow


def shape(df):
    return sorted((r.profile_id, r.condition, r.status, json.dumps(r.answers, sort_keys=True), r.n_calls) for r in df.collect())


def test_results_come_in_the_order_in_which_they_end():
    import threading

    taken, gate = [], threading.Event()

    def rows():
        for i in range(6):
            taken.append(i)
            yield i

    def work(i):
        if i == 0:
            gate.wait(10)
        return i

    it = survey.in_flight(rows(), work, 2)
    first = [next(it) for _ in range(3)]
    assert 0 not in first and len(taken) <= 5
    gate.set()
    assert sorted(first + list(it)) == list(range(6)) and list(survey.in_flight(iter([]), work, 3)) == []


def test_calls_in_flight(spark, tmp_path):
    some = spark.createDataFrame(people(spark, 125).collect(), people(spark, 1).schema)
    o = survey.RunOptions(conditions=["control", "Funding", "Consensus", "High public trust"])
    folder = str(tmp_path)

    def timed(pause):
        began = time.monotonic()
        return survey.run_survey(some, slow(pause, folder), o).collect(), time.monotonic() - began

    (_, without), (got, took) = timed(0.0), timed(0.1)
    calls = sum(r.n_calls for r in got)
    assert len(got) == 500 and calls == 125 * (1 + 4 + 4 + 2)
    slots = spark.sparkContext.defaultParallelism
    most = [int((tmp_path / f).read_text()) for f in os.listdir(folder)]
    assert took - without < calls * 0.1 / 20 and max(most) > 4 and max(most) <= o.in_flight and len(most) <= slots
    serial = survey.run_survey(some.limit(12), models.DummyClient, survey.RunOptions(conditions=o.conditions, workers=1))
    ids = {r.profile_id for r in serial.select("profile_id").collect()}
    assert shape(serial) == sorted((r.profile_id, r.condition, r.status, json.dumps(r.answers, sort_keys=True), r.n_calls) for r in got if r.profile_id in ids)


@pytest.mark.parametrize("workers,window,tasks,each", [(None, 16, 4, 16), (1, 16, 1, 1), (20, 16, 2, 10), (400, 16, 4, 100), (6, 2, 3, 2)])
def test_workers_bound_what_is_in_flight(spark, workers, window, tasks, each):
    spread, got = survey.dealt(spark.range(50), workers, window, "id")
    assert (spread.rdd.getNumPartitions(), got) == (tasks, each)


def test_a_killed_task_loses_the_session_in_hand_alone(spark, tmp_path):
    """The job fails for good in its second half; the next run asks only what was not finished."""
    some, out = people(spark, 8), str(tmp_path / "out")
    o = survey.RunOptions(conditions=["control"], workers=1, in_flight=1)
    counted = str(tmp_path / "asked")

    def dies(after):
        class Dies(models.DummyClient):
            def chat(self, prompt, seed, temperature=None, system=None):
                with open(counted, "a") as f:
                    f.write(prompt.split("text ")[1].split()[0] + "\n")
                if after is not None and sum(1 for _ in open(counted)) > after:
                    raise SystemExit("killed")
                return models.DummyClient.chat(self, prompt, seed, temperature, system)

        return Dies

    with pytest.raises(Exception):
        survey.run_to_log(spark, some, dies(5), out, o, told=lambda s: None)
    finished = {r["profile_id"] for d, _, names in os.walk(f"{out}/responses-run.jsonl") for n in names if n.endswith(".jsonl") for r in recordlog.whole_records(open(f"{d}/{n}", "rb").read())}
    assert len(finished) == 5
    os.remove(counted)
    summary = survey.run_to_log(spark, some, dies(None), out, o, told=lambda s: None)
    asked = open(counted).read().split()
    assert summary["n_complete"] == 8 and len(asked) == 3 and not finished & set(asked)


def test_a_second_attempt_goes_on_with_the_first(tmp_path):
    work = recordlog.Work(str(tmp_path / "b"), "job", ("k",))
    one = work.segment(3, 0)
    one.append({"k": "a", "status": "complete", "x": "é"})
    one.append({"k": "b", "status": "failed"})
    one.close()
    with open(tmp_path / "b" / one.name, "ab") as f:
        f.write(b'{"k": "c", "status": "compl')
    assert work.earlier(3, 1) == {("a",): ("complete", one.name)} and work.earlier(3, 0) == {} and work.earlier(2, 1) == {}


def test_half_a_line_is_no_record_and_the_tail_counts(spark, tmp_path):
    log = recordlog.RecordLog(spark, str(tmp_path / "log"), ["k"], "k string, status string, n int", 4)
    assert log.done(1) is None and log.records() is None
    seg = log.work(1).segment(0, 0)
    seg.append({"k": "a", "status": "complete", "n": 1})
    seg.append({"k": "b", "status": "failed", "n": 2})
    seg.close()
    with open(tmp_path / "log" / "bucket=000001" / seg.name, "ab") as f:
        f.write(b'{"k": "c", "status": "complete", "n"')
    assert [r.k for r in log.done(1).collect()] == ["a"] and sorted(tuple(r) for r in log.records(1).collect()) == [("a", "complete", 1), ("b", "failed", 2)]
    assert log.done(0) is None
    log.commit(spark.createDataFrame([("a", "complete", seg.name), ("b", "failed", seg.name)], "k string, status string, segment string"), 1)
    # Now the snapshot tells, and the segment is no longer read.
    assert "text" not in log.told(1)._jdf.queryExecution().executedPlan().toString().lower()
    assert [r.k for r in log.done(1).collect()] == ["a"]
    assert recordlog.RecordLog(spark, str(tmp_path / "log"), ["k"], "k string", 9).buckets == 4


def test_what_a_bucket_reads_does_not_grow(spark, tmp_path):
    """50 buckets: each reads its own keys, as many bytes for the last as for the first; and asks what an anti join says."""
    log = recordlog.RecordLog(spark, str(tmp_path / "log"), ["k", "c"], "k string, c string, status string", 50)
    todo = spark.range(2000).select(F.format_string("p%05d", "id").alias("k"), F.lit("x").alias("c")).withColumn("bucket", log.bucket("k"))
    part = todo.where("pmod(xxhash64(k, 1), 3) > 0").select("k", "c", F.lit("complete").alias("status"), F.lit("s.jsonl").alias("segment"), "bucket").collect()
    of = {}
    for r in part:
        of.setdefault(r.bucket, []).append((r.k, r.c, r.status, r.segment))
    sizes = []
    for b in range(50):
        log.commit(spark.createDataFrame(of[b], "k string, c string, status string, segment string").coalesce(1), b)
        files = log.told(b).inputFiles()
        assert all(f"/bucket={b:06d}/" in f for f in files)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in files))
    assert max(sizes) < 1.5 * min(sizes)
    everything = spark.createDataFrame([x[:2] for v in of.values() for x in v], "k string, c string")
    for b in (0, 7, 49):
        some = todo.where(F.col("bucket") == b)
        assert {r.k for r in not_done(some, log.done(b), ["k", "c"]).collect()} == {r.k for r in not_done(some, everything, ["k", "c"]).collect()}
