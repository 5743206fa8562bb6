"""Reader for task-style REST answers: the envelope as rows, and a data source with an injectable transport.

Answers have the form {status_code, status_message, cost, tasks: [{id, status_code, status_message, result: [...]}]}.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from adlens.session import written
from adlens.sources.caches import alive, newest, request_key

OK = 20000
ENVELOPE = "struct<status_code:int,status_message:string,cost:double,tasks:array<struct<id:string,status_code:int,status_message:string,result:array<string>>>>"

def flattened(answers: DataFrame, column: str = "body") -> DataFrame:
    """One row per result: the other columns, ok, error, task_id, result (JSON text). An answer without results is one row.

    ``ok`` needs the envelope's and the task's status to be ``OK``; text that is no envelope is not ok.
    """
    others = [c for c in answers.columns if c != column]
    rows = answers.select(*others, F.from_json(column, ENVELOPE).alias("e"))
    tasks = rows.select(*others, "e", F.explode_outer("e.tasks").alias("t"))
    fine = F.coalesce((F.col("e.status_code") == OK) & (F.coalesce(F.col("t.status_code"), F.lit(OK)) == OK), F.lit(False))
    error = F.when(~fine, F.coalesce(F.when(F.col("e.status_code") != OK, F.col("e.status_message")), F.col("t.status_message"), F.lit("no envelope")))
    flat = tasks.select(*others, fine.alias("ok"), error.alias("error"), F.col("e.cost").alias("cost"), F.col("t.id").alias("task_id"), F.explode_outer("t.result").alias("result"))
    return flat


def send(transport: Callable[[str, str, str], tuple[int, str]], method: str, path: str, payload: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str]:
    """One request; answers 429 and 5xx are tried again after 0.5, 1, 2, ... seconds, failures of the transport are not."""
    status, body = 0, ""
    for k in range(attempts):
        status, body = transport(method, path, payload)
        if status != 429 and status < 500:
            break
        if k + 1 < attempts:
            sleep(0.5 * 2**k)
    return status, body


def location_options(value, language=None) -> dict:
    """Numbers become codes, texts names, nothing is left out."""
    out = {}
    for name, v in (("location", value), ("language", language)):
        if v is not None:
            out[f"{name}_{'code' if isinstance(v, int) else 'name'}"] = v
    return out


# Paths of the service, with the fields that a task has besides its place and language.
ENDPOINTS = {
    "search_volume": ("/v3/keywords_data/google_ads/search_volume/live", ("keywords",)),
    "keywords_for_site": ("/v3/keywords_data/google_ads/keywords_for_site/live", ("target",)),
    "keywords_for_keywords": ("/v3/keywords_data/google_ads/keywords_for_keywords/live", ("keywords",)),
    "ad_traffic_by_keywords": ("/v3/keywords_data/google_ads/ad_traffic_by_keywords/live", ("keywords", "bid", "match")),
    "google_trends": ("/v3/keywords_data/google_trends/explore/live", ("keywords",)),
    "keyword_ideas": ("/v3/dataforseo_labs/google/keyword_ideas/live", ("keywords",)),
    "keyword_suggestions": ("/v3/dataforseo_labs/google/keyword_suggestions/live", ("keyword",)),
    "keyword_difficulty": ("/v3/dataforseo_labs/google/bulk_keyword_difficulty/live", ("keywords",)),
    "search_intent": ("/v3/dataforseo_labs/google/search_intent/live", ("keywords",)),
    "serp": ("/v3/serp/google/organic/live/advanced", ("keyword",)),
    "serp_competitors": ("/v3/dataforseo_labs/google/serp_competitors/live", ("keywords",)),
    "autocomplete": ("/v3/serp/google/autocomplete/live/advanced", ("keyword",)),
}
#: What a field is where the caller does not say.
DEFAULTS = {"match": "broad"}


def request_for(endpoint: str, location=None, language=None, **fields) -> tuple[str, str]:
    """(path, payload as canonical JSON text) of one task. Lists are copied, unknown and missing fields are errors."""
    if endpoint not in ENDPOINTS:
        raise ValueError(f"unknown endpoint: {endpoint}; known: {', '.join(sorted(ENDPOINTS))}")
    path, names = ENDPOINTS[endpoint]
    given = DEFAULTS | fields if "match" in names else fields
    if set(given) != set(names):
        raise ValueError(f"{endpoint} takes {', '.join(names)}")
    if "keywords" in given and isinstance(given["keywords"], str):
        raise ValueError("keywords is a list of texts")
    task = {k: list(v) if k == "keywords" else v for k, v in given.items()} | location_options(None if endpoint == "search_intent" else location, language)
    return path, json.dumps([task], sort_keys=True, ensure_ascii=False)


def requests_table(spark: SparkSession, endpoint: str, tasks: Iterable[dict]) -> DataFrame:
    """(path, payload): one row per task of the endpoint, a task being the keyword arguments of ``request_for``."""
    return spark.createDataFrame([request_for(endpoint, **t) for t in tasks], "path string, payload string")


def answered(requests: DataFrame, cache: DataFrame | None, transport: Callable[[str, str, str], tuple[int, str]], now: Column, ttl_seconds: float | None = None, method: str = "POST") -> tuple[DataFrame, DataFrame]:
    """((path, payload, body, cached), entries to add to the cache) of distinct ``requests`` (path, payload).

    ``cache``: key, body, cached_at. A request with an entry not older than ``ttl_seconds`` is answered from it and not sent; all others
    are sent once each, and fine answers make new entries. The sent answers are written first, so that nothing is paid for twice.
    """
    keyed = requests.filter("path IS NOT NULL AND payload IS NOT NULL").select("path", "payload").distinct().withColumn("key", request_key(F.col("path"), F.col("payload")))
    if cache is None:
        held = keyed.sparkSession.createDataFrame([], "key string, body string")
    else:
        held = newest(alive(cache, "cached_at", now, ttl_seconds).filter("key IS NOT NULL AND body IS NOT NULL").select("key", "body", "cached_at"), ["key"], "cached_at", "body").select("key", "body")

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = [send(transport, method, p, x) for p, x in zip(part["path"], part["payload"])]
            yield part.assign(status=[s for s, _ in answers], body=[b for _, b in answers])

    sent = written(keyed.join(held.select("key"), "key", "left_anti").mapInPandas(ask, "path string, payload string, key string, status int, body string"))
    known = keyed.join(held, "key").select("path", "payload", "body", F.lit(True).alias("cached"))
    fine = flattened(sent.filter("status = 200").select("key", "body", F.col("body").alias("kept"))).groupBy("key").agg(F.min("ok").alias("ok"), F.first("kept").alias("body")).filter("ok")
    return known.unionByName(sent.select("path", "payload", "body", F.lit(False).alias("cached"))), fine.select("key", "body", now.alias("cached_at"))


def tasks_ready(transport: Callable, base_path: str) -> list[str]:
    """Ids of the tasks that the service has ready to fetch; at most one answer of the service."""
    status, body = send(transport, "GET", base_path.rstrip("/") + "/tasks_ready", "")
    if status != 200:
        raise RuntimeError(f"the service answered {status}")
    return [r["id"] for t in json.loads(body).get("tasks") or [] for r in t.get("result") or [] if r.get("id")]


class RestSource(DataSource):
    """``format("adlens_rest")``: options ``transport`` (module:function), ``path`` or ``endpoint``, ``payloads`` (JSON array), ``method``.

    With option ``ready_path`` the request is a task: its answer names a task id, and ``ready_path`` + id is asked until its task
    is ready or ``timeout`` seconds are over.
    """

    @classmethod
    def name(cls) -> str:
        return "adlens_rest"

    def schema(self) -> str:
        return "path string, payload string, status int, body string"

    def reader(self, schema):
        return _RestReader(dict(self.options))


class _Request(InputPartition):
    def __init__(self, payload: str):
        self.payload = payload


class _RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Request(json.dumps(p, sort_keys=True)) for p in json.loads(self.options.get("payloads", "[{}]"))]

    def read(self, partition: _Request) -> Iterator[tuple]:
        import importlib

        module, _, function = self.options["transport"].partition(":")
        transport = getattr(importlib.import_module(module), function)
        path, ready = self.options.get("path") or ENDPOINTS[self.options["endpoint"]][0], self.options.get("ready_path")
        status, body = send(transport, self.options.get("method", "POST"), path, partition.payload)
        if ready and status == 200:
            status, body = await_task(transport, ready, body, float(self.options.get("timeout", "60")), float(self.options.get("interval", "2")))
        yield path, partition.payload, status, body


def await_task(transport: Callable, ready_path: str, submitted: str, timeout: float, interval: float, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic) -> tuple[int, str]:
    """Ask for a submitted task until its status is ``OK``; after ``timeout`` the answer is 504 with the task's id."""
    task = ((json.loads(submitted).get("tasks") or [{}])[0]).get("id")
    if task is None:
        return 502, submitted
    end = now() + timeout
    while True:
        status, body = send(transport, "GET", f"{ready_path}{task}", "", sleep=sleep)
        if status == 200 and ((json.loads(body).get("tasks") or [{}])[0]).get("status_code") == OK:
            return status, body
        if now() + interval > end:
            return 504, json.dumps({"status_code": 504, "status_message": "task not ready", "tasks": [{"id": task}]})
        sleep(interval)
