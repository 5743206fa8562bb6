"""Graphs as edge tables: connected components, redirect chains, breadth-first crawls.

Every loop writes its state as a table in the shared folder, so the lineage stays short and a lost executor costs one step.

Defined cases: edges with a null end are ignored; self-loops and repeated edges change nothing; nodes without edges are in no
component of ``components`` (callers add them); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for edges (a, b).

    Alternates linking every node's larger neighbours to its smallest and its smaller neighbours to its smallest (large-star
    and small-star), which ends after about log(n) rounds. Hot nodes are combined before the shuffle.
    """
    both = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    links = written(both)
    before = None
    while True:
        # large-star: neighbours above a node point to the least of its neighbourhood.
        around = links.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(links.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        least = around.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        large = around.filter("m > n").join(least, "n").select(F.col("low").alias("lo"), F.col("m").alias("hi")).filter("lo <> hi").distinct()
        # small-star: neighbours below a node, and the node, point to the least of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(low, "hi").select(F.col("low").alias("lo"), F.col("lo").alias("hi")).filter("lo <> hi").unionByName(low.select(F.col("low").alias("lo"), "hi")).distinct()
        links = written(small)
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def ranked_components(labels: DataFrame, id_column: str = "node") -> DataFrame:
    """Adds ``component``: 0, 1, ... by the components' smallest members, without gathering the members in one task."""
    roots = labels.select("root").distinct()
    parts = max(1, int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = written(roots.repartitionByRange(parts, "root").sortWithinPartitions("root").select("root", F.spark_partition_id().alias("part")))
    # Two-level numbering: rank inside a range plus the number of roots in the ranges before it.
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    numbered = ordered.join(F.broadcast(offsets), "part").select("root", (F.row_number().over(Window.partitionBy("part").orderBy("root")) - 1 + F.col("offset")).cast("long").alias("component"))
    return labels.join(numbered, "root")


def redirect_chains(starts: DataFrame, responses: DataFrame, max_hops: int = 10) -> DataFrame:
    """(url, final_url, final_status, redirects, downgrade, chain, ok, error) of every start url.

    ``responses``: url, status, location (absolute), error, and optionally fetched_at: of several answers of a url the newest counts,
    ties and answers without a time by the greatest (status, location, error). A chain follows 3xx responses that have a location, for at most
    ``max_hops`` redirects; it stops where a url comes again (the 3xx status stays final). A url that
    answers with an error, or not at all, ends the chain without a status: an error for the start, a null final status later.
    """
    at = F.col("fetched_at") if "fetched_at" in responses.columns else F.lit(None).cast("timestamp_ntz")
    answer = F.struct("status", "location", "error")
    known = responses.filter("url IS NOT NULL").groupBy("url").agg(F.max_by(answer, F.struct(at.alias("at"), answer.alias("r"))).alias("r")).select(F.col("url").alias("current"), F.col("r.status").alias("status"), F.col("r.location").alias("location"), F.col("r.error").alias("error"))
    state = starts.filter("url IS NOT NULL").select("url").distinct().select("url", F.col("url").alias("current"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<url:string,status:int>>").alias("chain"))
    ended = None
    for hop in range(max_hops + 1):
        step = state.join(known, "current", "left")
        step = step.withColumn("chain", F.concat("chain", F.array(F.struct(F.col("current").alias("url"), F.col("status").cast("int").alias("status")))))
        moves = F.coalesce((F.col("status") >= 300) & (F.col("status") < 400) & F.col("location").isNotNull() & F.col("error").isNull(), F.lit(False))
        again = F.coalesce(F.array_contains("seen", F.col("location")), F.lit(False))
        out = step.withColumn("goes", moves & ~again).withColumn("hop", F.lit(hop))
        done = out.filter(~F.col("goes") | F.lit(hop == max_hops))
        done = done.select("url", F.when(F.col("goes"), F.col("location")).otherwise(F.col("current")).alias("final_url"), F.when(~F.col("goes") & F.col("error").isNull(), F.col("status")).cast("int").alias("final_status"), "chain", "hop", "error", "goes")
        done = written(done)
        ended = done if ended is None else ended.unionByName(done)
        state = written(out.filter(F.col("goes")).select("url", F.col("location").alias("current"), F.concat("seen", F.array("current")).alias("seen"), "chain"))
        if not state.limit(1).count():
            break
    redirects = F.col("hop") + F.col("goes").cast("int")
    steps = F.transform(F.col("chain"), lambda x: x["url"].startswith("https://"))
    final_https = F.col("final_url").startswith("https://")
    downgrade = F.exists(F.arrays_zip(F.slice(F.concat(steps, F.array(final_https)), 1, F.size(steps)).alias("a"), F.slice(F.concat(steps, F.array(final_https)), 2, F.size(steps)).alias("b")), lambda p: p["a"] & ~p["b"])
    failed = (F.col("hop") == 0) & (F.col("error").isNotNull() | F.col("chain")[0]["status"].isNull())
    return ended.select("url", "final_url", "final_status", redirects.cast("int").alias("redirects"), downgrade.alias("downgrade"), "chain", (~failed).alias("ok"), F.when(failed, F.coalesce("error", F.lit("no response"))).alias("error"))


def site_of(url):
    """Host in lower case without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def checked(chains: DataFrame) -> DataFrame:
    """(site, checked, broken, redirected, broken_urls, redirected_urls) of ``redirect_chains``.

    Broken: no final status, or one from 400. The lists are sorted and meant for one site's report; for many urls take ``chains`` itself.
    """
    broken = F.coalesce(F.col("final_status") >= 400, F.lit(True))
    rows = chains.select(site_of(F.col("url")).alias("site"), "url", broken.alias("broken"), (F.col("redirects") > 0).alias("redirected"))
    lists = [F.array_sort(F.collect_list(F.when(F.col(c), F.col("url")))).alias(f"{c}_urls") for c in ("broken", "redirected")]
    return rows.groupBy("site").agg(F.count("*").alias("checked"), F.count_if("broken").alias("broken"), F.count_if("redirected").alias("redirected"), *lists)


def crawl(starts: DataFrame, links: DataFrame, max_pages: int = 50) -> DataFrame:
    """(start, url, found_on, depth, ordinal) of the pages a breadth-first crawl visits within each start's site.

    ``links``: page, href (absolute, without fragment), ordinal. Pages are visited level by level, in the order in which
    they were found (the order of the page that names them first, then the link's ordinal); at most ``max_pages`` a start.
    """
    # Written once: every level reads the links again, and finding them may mean parsing all pages.
    hrefs = written(links.filter("page IS NOT NULL AND href IS NOT NULL").select("page", "href", "ordinal").filter(F.col("href").rlike("^https?://")).withColumn("site", site_of(F.col("href"))))
    visited = written(starts.filter("start IS NOT NULL").select("start").distinct().select("start", F.col("start").alias("url"), F.lit(None).cast("string").alias("found_on"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ordinal")))
    frontier, depth = visited, 0
    while True:
        depth += 1
        room = visited.groupBy("start").agg(F.count("*").alias("used"))
        found = frontier.select("start", F.col("url").alias("page"), F.col("ordinal").alias("at")).join(hrefs, "page").filter(F.col("site") == site_of(F.col("start")))
        fresh = found.groupBy("start", "href").agg(F.min_by(F.struct("page", "at", "ordinal"), F.struct("at", "ordinal", "page")).alias("by"))
        fresh = fresh.withColumnRenamed("href", "url").join(visited.select("start", "url"), ["start", "url"], "left_anti")
        # A crawl of one start is bounded by max_pages, so is what a window keeps of it.
        order = Window.partitionBy("start").orderBy("by.at", "by.ordinal", "url")
        fresh = fresh.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max_pages).join(room, "start")
        fresh = fresh.filter(F.col("used") + F.col("r") <= max_pages)
        frontier = written(fresh.select("start", "url", F.col("by.page").alias("found_on"), F.lit(depth).alias("depth"), (F.col("used") + F.col("r") - 1).cast("long").alias("ordinal")))
        if not frontier.limit(1).count():
            return visited
        visited = written(visited.unionByName(frontier))
