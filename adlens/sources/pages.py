"""Page and snapshot tables: reading with a fetch policy, writing versions and outputs."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.text import slug


def fetched(pages: DataFrame, policy: str = "body") -> DataFrame:
    """``pages`` (status, html, error) with ``ok``: by ``body`` any page with html, by ``status`` only status 200 with html,
    by ``response`` any answer below 400 whether or not it has html, by ``strict`` status 200 with html that is not blank."""
    there, fine = F.col("html").isNotNull(), F.coalesce(F.col("status") == 200, F.lit(False))
    rules = {"body": there, "status": fine & there, "response": F.coalesce(F.col("status") < 400, F.lit(False)) & F.col("error").isNull(), "strict": fine & F.coalesce(F.trim("html") != "", F.lit(False))}
    if policy not in rules:
        raise ValueError(f"unknown policy: {policy}")
    ok = rules[policy]
    return pages.withColumn("ok", ok)


@F.pandas_udf(T.StringType())
def decoded_body(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes of an answer as text in the declared charset, UTF-8 where none or an unknown one is declared; what can't be read is U+FFFD."""

    def one(raw: bytes | None, kind: str | None) -> str | None:
        if raw is None:
            return None
        m = re.search(r"""charset\s*=\s*["']?([\w.:-]+)""", kind or "", re.IGNORECASE)
        try:
            name = codecs.lookup(m[1]).name if m else "utf-8"
        except LookupError:
            name = "utf-8"
        return raw.decode(name, errors="replace")

    return pd.Series([one(b, k) for b, k in zip(body, content_type)], dtype=object)


def received(answers: DataFrame, html_only: bool = False) -> DataFrame:
    """Answers (status, body bytes, content_type, error) with ``html`` and ``ok``: an answer other than 200 is not ok, its body is kept.

    With ``html_only`` bodies of other types than html are not read; no declared type counts as html.
    """
    is_html = (F.coalesce(F.trim("content_type"), F.lit("")) == "") | F.lower("content_type").contains("html")
    text = decoded_body("body", F.coalesce("content_type", F.lit("")))
    html = F.when(is_html, text) if html_only else text
    return answers.withColumn("html", F.when(F.col("error").isNull(), html)).withColumn("ok", F.col("error").isNull() & F.coalesce(F.col("status") == 200, F.lit(False)))


def scan(table: DataFrame, filters: list[Column] = (), since: str | None = None, until: str | None = None, at: str = "seen_at") -> DataFrame:
    """Rows within a date range (both ends included) that meet all filters; conditions reach the file scan."""
    for f in filters:
        table = table.filter(f)
    if since:
        table = table.filter(F.col(at) >= F.lit(since).cast("timestamp_ntz"))
    if until:
        table = table.filter(F.col(at) < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz"))
    return table


def domain_slug(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.when(host.isNull() | (host == ""), F.lit("unknown-domain")).otherwise(F.regexp_replace(host, r"[^a-z0-9.-]+", "-"))


def url_slug(url: Column) -> Column:
    """Slug of path and query, of the host where these are empty."""
    rest = F.concat_ws(" ", F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY")))
    own = slug(rest, "")
    return F.when(own == "", slug(domain_slug(url))).otherwise(own)


def output_format(name: Column) -> Column:
    """Known formats by their names and short names, others by their slug."""
    low = F.lower(F.trim(name))
    return F.when(low.isin("md", "markdown"), "markdown").when(low.isin("htm", "html"), "html").when(low.isin("json", "jsonl"), "json").when(low.isin("txt", "text"), "text").otherwise(slug(name))


def output_path(url: Column, form: Column, at: Column) -> Column:
    """outputs/<domain>/<format>/<time>-<slug>-<hash>: the hash of the url keeps names apart."""
    return F.concat_ws("/", F.lit("outputs"), domain_slug(url), output_format(form), F.concat_ws("-", F.date_format(at, "yyyy-MM-dd-HH-mm"), url_slug(url), F.substring(F.sha1(url), 1, 6)))


def inline(content: Column, saved: Column, limit: int = 60_000) -> Column:
    """Content to return: cut at ``limit`` only if it was saved as a whole."""
    return F.when(saved & (F.length(content) > limit), F.substring(content, 1, limit)).otherwise(content)


def append_versions(versions: DataFrame, path: str) -> None:
    """Append (url, fetched_at, text) with hash and domain to the version table at ``path``, partitioned by domain."""
    rows = versions.filter("text IS NOT NULL").select("url", "fetched_at", F.sha2("text", 256).alias("hash"), "text", domain_slug(F.col("url")).alias("domain"))
    rows.write.mode("append").partitionBy("domain").parquet(path)
