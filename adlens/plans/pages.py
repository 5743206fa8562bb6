"""Queries over pages, their links and their versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.functions.text import keyword_tokens, ngrams
from adlens.operators.graph import checked, crawl, redirect_chains, site_of
from adlens.operators.html import coverage, missing_pages, parsed, phrase_matches, resolved, signals
from adlens.operators.versions import diffs, flagged, listed
from adlens.plans import page_sql
from adlens.session import table, written
from adlens.sources.pages import domain_slug, fetched, inline, output_path, scan, url_slug

def _pages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages")


def t1_content(spark: SparkSession, root: str) -> DataFrame:
    c = F.col("content")
    return parsed(_pages(spark, root), ("content",)).select("page_id", "ok", c["title"].alias("title"), c["description"].alias("description"), F.size(c["h1"]).alias("h1"), F.size(c["h2"]).alias("h2"), c["words"].alias("words"))


def t1_titles(spark: SparkSession, root: str) -> DataFrame:
    return parsed(_pages(spark, root), ("content",)).filter("ok").select("page_id", F.col("content.title").alias("title"))


def t2_audit(spark: SparkSession, root: str) -> DataFrame:
    return parsed(_pages(spark, root), ("audit",)).select("page_id", "ok", "audit.*")


def t3_text(spark: SparkSession, root: str) -> DataFrame:
    return parsed(_pages(spark, root), ("text",)).select("page_id", "text", F.sha2("text", 256).alias("hash"))


def t4_links(spark: SparkSession, root: str) -> DataFrame:
    return parsed(_pages(spark, root), ("links",)).select("page_id", F.posexplode("links").alias("pos", "href"))


def d1_structured_data(spark: SparkSession, root: str) -> DataFrame:
    p = F.col("product")
    return parsed(_pages(spark, root), ("product",)).filter("ok").select("page_id", p["found"].alias("found"), F.array_join(p["types"], ",").alias("types"), F.array_join(p["missing"], ",").alias("missing"), F.array_join(p["advised"], ",").alias("advised"))


def d3_types(spark: SparkSession, root: str) -> DataFrame:
    types = parsed(_pages(spark, root), ("product",)).select(F.explode("product.types").alias("type"))
    return types.groupBy("type").agg(F.count("*").alias("pages"))


def l1_images(spark: SparkSession, root: str) -> DataFrame:
    a = F.col("audit")
    rows = parsed(_pages(spark, root), ("audit",)).join(_pages(spark, root).select("page_id", site_of(F.col("url")).alias("site")), "page_id")
    return rows.groupBy("site").agg(F.sum(a["images"]).alias("images"), F.sum(a["images_no_alt"]).alias("images_no_alt"))


def l3_bytes(spark: SparkSession, root: str) -> DataFrame:
    return signals(_pages(spark, root)).select("page_id", "ok", "https", F.col("bytes").cast("long").alias("bytes"))


def l4_flags(spark: SparkSession, root: str) -> DataFrame:
    return signals(_pages(spark, root)).select("page_id", F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("pages"))


def l2_calls(spark: SparkSession, root: str) -> DataFrame:
    return parsed(_pages(spark, root), ("audit",)).filter("ok").select("page_id", "audit.ctas", F.array_join("audit.cta_words", ",").alias("words"), F.slice("audit.cta_samples", 1, 10).alias("samples"))


def c1_summary(spark: SparkSession, root: str) -> DataFrame:
    w = F.col("content.words")
    return parsed(_pages(spark, root), ("content",)).agg(F.count_if("ok").alias("ok_pages"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.min(w), F.lit(0)).alias("min_words"), F.coalesce(F.max(w), F.lit(0)).alias("max_words"), F.coalesce(F.bround(F.avg(w), 0), F.lit(0.0)).alias("mean_words"))


def _phrases(spark: SparkSession, root: str) -> DataFrame:
    """All word pairs of the keywords."""
    pairs = table(spark, root, "keywords").filter("text IS NOT NULL").select(F.explode(ngrams(keyword_tokens(F.col("text")), (2,))).alias("g"))
    return pairs.select(F.col("g.ngram").alias("keyword")).distinct()


def c3_coverage(spark: SparkSession, root: str) -> DataFrame:
    """All word pairs of the keywords against all pages: the cells that are not 0."""
    return phrase_matches(parsed(_pages(spark, root), ("content",)), _phrases(spark, root))


def c3_matrix(spark: SparkSession, root: str) -> DataFrame:
    """The whole matrix of a list of phrases."""
    return coverage(parsed(_pages(spark, root), ("content",)), ["rain jacket", "kask rowerowy", "sac à dos", "bürostuhl", "not there at all"])


def c4_gaps(spark: SparkSession, root: str) -> DataFrame:
    return missing_pages(written(parsed(_pages(spark, root), ("content",))), _phrases(spark, root))


def s3_fetch_policy(spark: SparkSession, root: str) -> DataFrame:
    counted = [fetched(_pages(spark, root), p).groupBy(F.lit(p).alias("policy"), "ok").agg(F.count("*").alias("pages")) for p in ("body", "status", "response", "strict")]
    return reduce(DataFrame.unionByName, counted)


def s2_scan(spark: SparkSession, root: str) -> DataFrame:
    rows = scan(table(spark, root, "search_terms"), [F.col("clicks") >= 5], "2024-04-01", "2024-04-30")
    return rows.select("st_id", "campaign", "clicks")


def s11_inline(spark: SparkSession, root: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return _pages(spark, root).select("page_id", F.length(inline(html, F.length(html) > 2000, 2000)).alias("shown"))


def s12_paths(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root).filter("url IS NOT NULL").select("page_id", domain_slug(F.col("url")).alias("domain"), url_slug(F.col("url")).alias("slug"), output_path(F.col("url"), F.lit("md"), F.col("fetched_at")).alias("path"))


def f19_domains(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "snapshots").filter("url IS NOT NULL").groupBy(domain_slug(F.col("url")).alias("domain")).agg(F.count("*").alias("rows"))


def u1_rollup(spark: SparkSession, root: str) -> DataFrame:
    p = _pages(spark, root).filter("url IS NOT NULL").withColumn("site", site_of(F.col("url")))
    return p.groupBy("site").agg(F.count("*").alias("checked"), F.count_if(F.col("status") == 200).alias("fine"), F.count_if(F.col("status") >= 400).alias("broken"), F.count_if((F.col("status") >= 300) & (F.col("status") < 400)).alias("redirects"))


def _moves(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Urls of the snapshots, and answers that lead each of them step by step to its normal form, which answers 200.

    Steps: no fragment, no tracking parameters, host in lower case, no slash at the end.
    """
    urls = table(spark, root, "snapshots").filter("url IS NOT NULL").select("url").distinct()
    bare = F.regexp_replace("url", "#.*$", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"([?&])utm_[^&]*", "$1"), r"([?&])&+", "$1"), r"[?&]+$", "")
    low = F.concat(F.lower(F.regexp_extract(plain, r"^([^/?]*//[^/?]*)", 1)), F.regexp_extract(plain, r"^[^/?]*//[^/?]*(.*)$", 1))
    forms = urls.select("url", F.array_distinct(F.array("url", bare, plain, low, F.regexp_replace(low, "/+$", ""))).alias("forms"))
    steps = forms.select(F.explode(F.arrays_zip(F.col("forms").alias("url"), F.slice("forms", 2, 9).alias("location"))).alias("s"))
    answers = steps.select("s.url", F.when(F.col("s.location").isNull(), 200).otherwise(301).alias("status"), "s.location", F.lit(None).cast("string").alias("error"))
    return urls, answers


def u2_redirects(spark: SparkSession, root: str) -> DataFrame:
    urls, answers = _moves(spark, root)
    return redirect_chains(urls, answers).select("url", "final_url", "final_status", "redirects", "downgrade", "ok")


def u1_checked(spark: SparkSession, root: str) -> DataFrame:
    """Checked urls by site with the lists of broken and redirected ones."""
    urls, answers = _moves(spark, root)
    out = checked(redirect_chains(urls, answers))
    return out.select("site", "checked", "broken", "redirected", F.array_join("broken_urls", "|").alias("broken_urls"), F.array_join("redirected_urls", "|").alias("redirected_urls"))


def u3_crawl(spark: SparkSession, root: str) -> DataFrame:
    p = _pages(spark, root).filter("url IS NOT NULL")
    links = parsed(p, ("links",), "url").select("url", F.posexplode("links").alias("ordinal", "link")).select(F.col("url").alias("page"), resolved(F.col("url"), F.col("link")).alias("href"), "ordinal")
    starts = p.groupBy(site_of(F.col("url")).alias("site")).agg(F.min("url").alias("start")).select("start")
    return crawl(starts, links.distinct(), 50)


def w1_changed(spark: SparkSession, root: str) -> DataFrame:
    return flagged(table(spark, root, "snapshots")).select("snap_id", "url", "previous", "changed")


def m3_diffs(spark: SparkSession, root: str) -> DataFrame:
    return diffs(table(spark, root, "snapshots")).select("snap_id", "previous", "added", "removed")


def m4_listed(spark: SparkSession, root: str) -> DataFrame:
    return listed(table(spark, root, "snapshots"))


def f25_hashes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "snapshots").filter("text IS NOT NULL").select("snap_id", F.sha2("text", 256).alias("own_hash"), (F.sha2("text", 256) == F.col("hash")).alias("agrees"))


QUERIES = {
    "t1_content": t1_content, "t1_titles": t1_titles, "t2_audit": t2_audit, "t3_text": t3_text, "t4_links": t4_links, "d1_structured_data": d1_structured_data, "d3_types": d3_types, "l1_images": l1_images, "l2_calls": l2_calls, "l3_bytes": l3_bytes, "l4_flags": l4_flags,
    "c1_summary": c1_summary, "c3_coverage": c3_coverage, "c3_matrix": c3_matrix, "u1_checked": u1_checked, "c4_gaps": c4_gaps, "s2_scan": s2_scan, "s3_fetch_policy": s3_fetch_policy, "s11_inline": s11_inline, "s12_paths": s12_paths, "f19_domains": f19_domains, "u1_rollup": u1_rollup, "u2_redirects": u2_redirects, "u3_crawl": u3_crawl,
    "w1_changed": w1_changed, "m3_diffs": m3_diffs, "m4_listed": m4_listed, "f25_hashes": f25_hashes,
}

_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"

_LOW = "lower(regexp_extract(f2, '^([^/?]*//[^/?]*)', 1)) || regexp_extract(f2, '^[^/?]*//[^/?]*(.*)$', 1)"
_FORMS = rf"""one AS (SELECT DISTINCT url, regexp_replace(url, '#.*$', '') AS f1 FROM snapshots WHERE url IS NOT NULL),
two AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(f1, '([?&])utm_[^&]*', '\1', 'g'), '([?&])&+', '\1', 'g'), '[?&]+$', '') AS f2 FROM one),
forms AS (SELECT *, {_LOW} AS f3, regexp_replace({_LOW}, '/+$', '') AS f4 FROM two)"""

SQL = page_sql.SQL | {
    "l3_bytes": "SELECT page_id, html IS NOT NULL AS ok, coalesce(starts_with(final_url, 'https://'), false) AS https, coalesce(CAST(octet_length(encode(html)) AS BIGINT), 0) AS bytes FROM pages",
    "s2_scan": "SELECT st_id, campaign, clicks FROM search_terms WHERE clicks >= 5 AND seen_at >= TIMESTAMP '2024-04-01' AND seen_at < TIMESTAMP '2024-05-01'",
    "s3_fetch_policy": """SELECT 'body' AS policy, html IS NOT NULL AS ok, count(*) AS pages FROM pages GROUP BY 2 UNION ALL SELECT 'status', coalesce(status = 200, false) AND html IS NOT NULL, count(*) FROM pages GROUP BY 2
UNION ALL SELECT 'response', coalesce(status < 400, false) AND error IS NULL, count(*) FROM pages GROUP BY 2 UNION ALL SELECT 'strict', coalesce(status = 200, false) AND coalesce(trim(html) <> '', false), count(*) FROM pages GROUP BY 2""",
    "u2_redirects": f"WITH {_FORMS} SELECT url, f4 AS final_url, 200 AS final_status, CAST(len(list_distinct([url, f1, f2, f3, f4])) - 1 AS INTEGER) AS redirects, false AS downgrade, true AS ok FROM forms",
    "u1_checked": f"WITH {_FORMS} SELECT {_HOST} AS site, count(*) AS checked, 0::BIGINT AS broken, count(*) FILTER (WHERE f4 <> url) AS redirected, '' AS broken_urls, coalesce(string_agg(url, '|' ORDER BY url) FILTER (WHERE f4 <> url), '') AS redirected_urls FROM forms GROUP BY 1",
    "u3_crawl": f"""WITH site_starts AS (SELECT {_HOST} AS site, min(url) AS start FROM pages WHERE url IS NOT NULL GROUP BY 1),
{page_sql.LINKS},
near AS (SELECT start, regexp_extract(start, '^[a-zA-Z]+://[^/?#]+') || href AS url, min(pos) AS pos FROM site_starts JOIN pages ON pages.url = start JOIN linked USING (page_id) WHERE starts_with(href, '/') GROUP BY 1, 2),
ranked AS (SELECT start, url, row_number() OVER (PARTITION BY start ORDER BY pos, url) AS r FROM near WHERE url <> start)
SELECT start, start AS url, NULL::VARCHAR AS found_on, 0 AS depth, 0::BIGINT AS ordinal FROM site_starts UNION ALL SELECT start, url, start, 1, r FROM ranked WHERE r <= 49""",
    "s12_paths": f"""WITH u AS (SELECT page_id, url, fetched_at, regexp_replace(coalesce(nullif({_HOST}, ''), 'unknown-domain'), '[^a-z0-9.-]+', '-', 'g') AS domain,
 trim(regexp_replace(lower(strip_accents(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) || ' ' || regexp_extract(url, '[?]([^#]*)', 1))), '[^a-z0-9]+', '-', 'g'), '-') AS own FROM pages WHERE url IS NOT NULL),
n AS (SELECT *, CASE WHEN own = '' THEN trim(regexp_replace(domain, '[^a-z0-9]+', '-', 'g'), '-') ELSE own END AS slug FROM u)
SELECT page_id, domain, slug, 'outputs/' || domain || '/markdown/' || strftime(fetched_at, '%Y-%m-%d-%H-%M') || '-' || slug || '-' || sha1(url)[1:6] AS path FROM n""",
    "s11_inline": "SELECT page_id, CAST(CASE WHEN length(coalesce(html, '')) > 2000 THEN 2000 ELSE length(coalesce(html, '')) END AS INTEGER) AS shown FROM pages",
    "f19_domains": f"SELECT {_HOST} AS domain, count(*) AS rows FROM snapshots WHERE url IS NOT NULL GROUP BY 1",
    "u1_rollup": f"SELECT {_HOST} AS site, count(*) AS checked, count(*) FILTER (WHERE status = 200) AS fine, count(*) FILTER (WHERE status >= 400) AS broken, count(*) FILTER (WHERE status >= 300 AND status < 400) AS redirects FROM pages WHERE url IS NOT NULL GROUP BY 1",
    "w1_changed": "WITH r AS (SELECT snap_id, url, fetched_at, sha256(text) AS h FROM snapshots WHERE text IS NOT NULL AND url IS NOT NULL) SELECT snap_id, url, lag(snap_id) OVER w AS previous, lag(h) OVER w <> h AS changed FROM r WINDOW w AS (PARTITION BY url ORDER BY fetched_at NULLS FIRST, snap_id)",
    "m4_listed": "SELECT url, count(*) AS versions, count(DISTINCT text) AS texts, min(fetched_at) AS first_at, max(fetched_at) AS last_at FROM snapshots WHERE text IS NOT NULL AND url IS NOT NULL GROUP BY url",
    "f25_hashes": "SELECT snap_id, sha256(text) AS own_hash, sha256(text) = hash AS agrees FROM snapshots WHERE text IS NOT NULL",
}
