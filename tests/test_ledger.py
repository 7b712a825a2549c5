"""The ledger of model calls: nothing finished is asked twice, whatever fails."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.operators import ledger


@pytest.fixture
def counted(spark, tmp_path):
    """A client that notes each prompt it is asked, and fails for some while a file is there."""
    log, broken = tmp_path / "log", tmp_path / "broken"
    log.mkdir()

    def client():
        import os
        import uuid

        def call(prompts):
            for p in prompts:
                (log / uuid.uuid4().hex).write_text(p)
            if broken.exists() and any(p.endswith("3") for p in prompts):
                if broken.read_text() == "die":
                    os._exit(1)
                raise RuntimeError("no answer")
            return [{"length": len(p)} for p in prompts]

        return call

    return client, lambda: sorted(f.read_text() for f in log.iterdir()), broken


def test_finished_calls_are_made_once(spark, tmp_path, counted):
    client, calls, broken = counted
    path = str(tmp_path / "ledger")
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(20)] + [(1, "p1"), (30, None)], "key long, prompt string")
    broken.write_text("raise")
    got = {r.key: r for r in ledger.ask(prompts, client, "m", path).collect()}
    assert len(got) == 21 and {k for k, r in got.items() if r.error} == {"3", "13"}
    assert got["3"].error == "RuntimeError: no answer" and got["3"].result is None and json.loads(got["12"].result) == {"length": 3} and json.loads(got["30"].result) == {"length": 0}
    assert len(calls()) == 21
    broken.unlink()
    got = ledger.ask(prompts, client, "m", path).collect()
    assert len(calls()) == 23 and all(r.error is None and r.result for r in got)  # the two that failed, no other
    assert len(ledger.ask(prompts, client, "m", path).collect()) == 21 and len(calls()) == 23
    changed = prompts.where("key = 5").withColumn("prompt", F.lit("new"))
    assert ledger.ask(changed, client, "m", path).first().result == '{"length": 3}' and len(calls()) == 24
    ledger.ask(changed, client, "other model", path)
    assert len(calls()) == 25


def test_a_lost_run_keeps_its_finished_waves(spark, tmp_path, counted):
    client, calls, broken = counted
    path = str(tmp_path / "ledger")
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(60)], "key long, prompt string")
    broken.write_text("die")  # the worker process ends in the middle of its calls
    with pytest.raises(Exception):
        ledger.ask(prompts, client, "m", path, calls_per_task=3)
    done = {(r.key, r.prompt_hash) for r in ledger.read(spark, path).collect()}
    before = calls()
    broken.unlink()
    assert len(ledger.ask(prompts, client, "m", path, calls_per_task=3).collect()) == 60
    again = calls()
    for p in before:
        again.remove(p)
    assert len(again) == 60 - len(done)  # all that had finished is kept


def test_no_prompts(spark, tmp_path, counted):
    client, calls, _ = counted
    none = spark.createDataFrame([], "key long, prompt string")
    assert ledger.ask(none, client, "m", str(tmp_path / "ledger")).count() == 0 and calls() == []
