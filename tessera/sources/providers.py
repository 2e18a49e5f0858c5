"""Providers that answer a stage's requests, tried in order.

A provider maps a DataFrame of requests (key, request: JSON text) to answers
(key, status, output, latency_ms); status is ok, unavailable or error. Requests
that one provider leaves open go on to the next.
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "key string, status string, output string, latency_ms long"
Provider = Callable[[DataFrame], DataFrame]


def command(prefix: Sequence[str], stage: str, timeout: float = 300, env: dict[str, str] | None = None) -> Provider:
    """An outside program: JSON file in, JSON file out. A timeout or a bad answer is an error of that request."""
    def one(request: str) -> tuple[str, str | None, int]:
        if not prefix:
            return "unavailable", None, 0
        began = time.monotonic()
        with tempfile.TemporaryDirectory() as d:  # of this task alone
            there, back = os.path.join(d, "request.json"), os.path.join(d, "response.json")
            with open(there, "w", encoding="utf-8") as f:
                f.write(request)
            try:
                run = subprocess.run([*prefix, "--stage", stage, "--request-json", there, "--response-json", back], timeout=timeout, capture_output=True, env=os.environ | (env or {}))
                with open(back, encoding="utf-8") as f:
                    out = json.dumps(json.load(f), sort_keys=True)
                status = "ok" if run.returncode == 0 else "error"
            except FileNotFoundError:
                status, out = "unavailable" if not os.path.exists(there) else "error", None
            except (subprocess.TimeoutExpired, OSError, ValueError):
                status, out = "error", None
        return status, out if status == "ok" else None, int((time.monotonic() - began) * 1000)

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(k, *one(r)) for k, r in zip(b["key"], b["request"])], columns=["key", "status", "output", "latency_ms"])

    return lambda requests: requests.select("key", "request").mapInPandas(run, ANSWER)


def model(load: Callable[[], Callable[[list[str]], list[str]]]) -> Provider:
    """A model loaded once a task, asked in batches."""
    def run(batches):
        import pandas as pd

        answer = load()
        for b in batches:
            began = time.monotonic()
            out = answer(b["request"].tolist())
            took = int((time.monotonic() - began) * 1000 / max(1, len(b)))
            yield pd.DataFrame({"key": b["key"], "status": "ok", "output": out, "latency_ms": took})

    return lambda requests: requests.select("key", "request").mapInPandas(run, ANSWER)


def rules(output) -> Provider:
    """An answer by a Column expression over the request."""
    return lambda requests: requests.select("key", F.lit("ok").alias("status"), output.cast("string").alias("output"), F.lit(0).cast("long").alias("latency_ms"))


def named(names: Sequence[str], known: dict[str, Provider]) -> list[tuple[str, Provider]]:
    """The providers of a configured chain; an unknown name is an error before anything is asked."""
    return [(n, known[n]) for n in names]


def chain(requests: DataFrame, providers: Sequence[tuple[str, Provider]], keep, tries: int = 1, valid=None) -> DataFrame:
    """Attempts (key, priority, provider, status, output, latency_ms, attempt) of each provider on what is still open.

    ``keep`` writes a table and reads it back (a stage's answers are not asked
    for twice). An unknown key never appears; a request that all providers fail
    has no attempt that is ok. What is an error is asked again, ``tries`` times
    in all; an answer for which the Column function ``valid`` does not hold is one.
    """
    attempts, left = [], requests
    for i, (name, provider) in enumerate(providers):
        again = left
        for attempt in range(1, tries + 1):
            got = provider(again).withColumn("output", F.when(F.col("status") == "ok", F.col("output")))
            if valid is not None:
                got = got.withColumn("status", F.when((F.col("status") == "ok") & ~F.coalesce(valid(F.col("output")), F.lit(False)), "error").otherwise(F.col("status")))
            got = keep(got.select("key", F.lit(i).alias("priority"), F.lit(name).alias("provider"), "status", "output", "latency_ms", F.lit(attempt).alias("attempt")), f"attempts_{name}_{attempt}")
            attempts.append(got)
            left = left.join(got.filter("status = 'ok'").select("key"), "key", "left_anti")
            again = again.join(got.filter("status = 'error'").select("key"), "key", "left_semi")
            if attempt < tries and again.isEmpty():
                break
    return reduce(DataFrame.unionByName, attempts)


@dataclass
class Asked:
    """What a stage's chain said: (key, provider, output) of each request that has an answer, and all attempts."""

    answers: DataFrame
    attempts: DataFrame


def ask(stage: str, requests: DataFrame, providers: Sequence[tuple[str, Provider]], keep, store=None, tries: int = 1, valid=None) -> Asked:
    """Asks the chain for requests (key, request) that ``store`` doesn't answer, each key once, and stores the answers.

    A stored answer for which ``valid`` does not hold is void. Answers from the store have the provider "store" and no attempt.
    """
    each = keep(requests.select("key", "request").groupBy("key").agg(F.first("request").alias("request")), f"{stage}_requests")
    answers = None
    if store is not None:
        known = store.lookup(each)[0]
        if valid is not None:
            known = known.filter(F.coalesce(valid(F.col("output")), F.lit(False)))
        answers = keep(known.select("key", F.lit("store").alias("provider"), "output"), f"{stage}_known")
        each = keep(each.join(answers, "key", "left_anti"), f"{stage}_open")
    attempts = chain(each, providers, lambda df, name: keep(df, f"{stage}_{name}"), tries, valid)
    best = F.min(F.when(F.col("status") == "ok", F.struct("priority", "attempt", "provider", "output"))).alias("b")
    new = attempts.groupBy("key").agg(best).filter("b IS NOT NULL").select("key", "b.provider", "b.output")
    if store is not None:
        store.add(new.select("key", F.lit(stage).alias("stage"), "output"))
        new = answers.unionByName(new)
    return Asked(new, attempts.withColumn("stage", F.lit(stage)))
