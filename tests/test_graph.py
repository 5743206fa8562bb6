"""Components, similarity joins, groups, redirects, crawls, caches on small tables."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from adlens.functions.text import norm_keyword
from adlens.operators.graph import checked, components, crawl, ranked_components, redirect_chains
from adlens.operators.keyword_clusters import cluster_ids, distinct_labels, keyword_clusters, keyword_rows, labels, resolve_method, rollup, title_case, two_stage_clusters, vector_clusters
from adlens.operators.similarity import blocked_links, blocked_vector_links, cosine, lexical_ratio, token_links, token_sort_ratio
from adlens.operators.text_groups import group_links
from adlens.operators.whitening import whitened
from adlens.sources.caches import alive, newest, split_requests
from adlens.sources.embeddings import embedded, load_background, model_slug
from adlens.sources.pages import append_versions


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    for n, m in ((30, 20), (60, 50), (40, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1, 1), (None, 2)]
        out = components(spark.createDataFrame(edges, "a long, b long"))
        assert {r["node"]: r["root"] for r in out.collect()} == brute(edges)
    path = [(i, i + 1) for i in range(70)] + [(0, i) for i in range(200, 260)]
    assert {r["root"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_numbers(spark):
    df = spark.createDataFrame([(5, 5), (9, 5), (7, 7), (30, 7), (1, 1)], "node long, root long")
    assert {r["node"]: r["component"] for r in ranked_components(df).collect()} == {1: 0, 5: 1, 9: 1, 7: 2, 30: 2}


KW = "kw_id long, text string, avg_monthly_searches long, cpc_low double, cpc_high double, competition string"


def test_token_links_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 5))) for _ in range(120)] + [None, "", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = {i: set(t.split()) for i, t in enumerate(texts) if t is not None}

    def sim(x, y):
        return 1.0 if not x and not y else len(x & y) / len(x | y)

    for least in (0.5, 0.7, 1.0):
        expected = {i: sum(sim(s, t) >= least for j, t in sets.items() if j != i) for i, s in sets.items()}
        assert {r["id"]: r["links"] for r in token_links(df, least).collect()} == expected


def test_token_links_form_no_pairs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(16)]
    texts = [" ".join(rng.choices(words, k=rng.choice((1, 2, 3, 5, 8, 9, 12)))) for _ in range(150)] + [" ".join(words[:n]) for n in range(1, 17)] + ["w1 w2"] * 3
    sets = [set(t.split()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for least in (0.3, 0.5, 0.8):
        expected = {i: sum(len(s & t) / len(s | t) >= least for t in sets) - 1 for i, s in enumerate(sets)}
        assert {r["id"]: r["links"] for r in token_links(df, least).collect()} == expected
    # 6 000 short sets with a common word have 18 million links; none of these may become a row.
    many = spark.range(6000).select("id", F.concat(F.lit("lamp m"), "id").alias("text")).union(spark.createDataFrame([(9999, "lamp")], "id long, text string"))
    out = token_links(many, 0.3)
    assert {r["links"] for r in out.collect()} == {6000}
    todo, most = [out._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < most <= 60000


def test_blocked_links_equal_brute_force(spark):
    texts = ["buty trekkingowe", "trekkingowe buty tanie", "rower gorski", "rower gorskie", "", "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for measure in (lexical_ratio, token_sort_ratio):
        expected = {(i, j) for i in range(6) for j in range(i + 1, 6) if measure(texts[i], texts[j]) >= 0.6}
        assert {(r["a"], r["b"]) for r in blocked_links(df, measure, 0.6, block=2).collect()} == expected


def test_group_links_connect_what_all_pairs_do(spark):
    rng = random.Random(8)
    words = ["lamp", "tent", "red", "hose", "garden", "oak", "shelf", "стул", "półka"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 4))) + f" {rng.randrange(30)}" for _ in range(110)] + ["".join(rng.choices("abcdefghijkl", k=rng.randrange(4, 80))) for _ in range(40)] + [None, "", "lamp red 1", "lamp red 1", "x" * 70, "x" * 80]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    norm = {r["id"]: r["norm"] for r in df.filter("text IS NOT NULL").select("id", norm_keyword(F.col("text")).alias("norm")).collect()}
    for measure, least in ((token_sort_ratio, 0.75), (lexical_ratio, 0.8)):
        expected = brute([(i, j) for i in norm for j in norm if i < j and measure(norm[i], norm[j]) >= least])
        for hub in (20, 1000):
            found = [(r["a"], r["b"]) for r in group_links(df, measure, least, hub=hub, block=16).collect()]
            assert brute(found) == expected and len(set(expected.values())) > 3
    # A group of 3 000 has 4.5 million links; no more come out than connect it.
    many = spark.range(3000).select("id", F.concat(F.lit("garden hose lamp "), "id").alias("text"))
    links = group_links(many, token_sort_ratio, 0.7, hub=500).select("a", "b").collect()
    assert len(links) < 20000 and set(brute([(r["a"], r["b"]) for r in links]).values()) == {0}


def test_cluster_methods(spark):
    rows = [(3, "buty trekkingowe", None, None, None, None), (1, "trekkingowe buty tanie", None, None, None, None), (2, "rower gorski", None, None, None, None), (4, None, 5, None, None, None)]
    df = spark.createDataFrame(rows, KW)
    for method in ("tokens", "lexical", "fuzzy"):
        got = {r["kw_id"]: (r["root"], r["component"]) for r in cluster_ids(df, method, 0.5).collect()}
        assert got == {1: (1, 0), 3: (1, 0), 2: (2, 1)}


def test_rollup_and_labels(spark):
    rows = [("c", 1, "buty trekkingowe", 1000, 0.4, 1.2, "HIGH"), ("c", 2, "buty trekkingowe damskie", 500, 0.5, 1.0, "MEDIUM"), ("d", 3, "rower gorski damski", None, 0.5, None, None), ("d", 4, "rower gorski", None, None, None, None), ("e", 5, "rower gorski x", None, None, None, "LOW")]
    df = spark.createDataFrame(rows, "cluster string, " + KW)
    out = {r["cluster"]: r for r in rollup(df).collect()}
    assert (out["c"]["total_volume"], round(out["c"]["avg_cpc"], 6), out["c"]["dominant_competition"], out["c"]["representative_keyword"]) == (1500, 0.775, "HIGH", "buty trekkingowe")
    assert (out["d"]["total_volume"], out["d"]["avg_cpc"], out["d"]["representative_keyword"]) == (None, None, "rower gorski")
    named = labels(df)
    got = {r["cluster"]: r["label"] for r in named.collect()}
    assert got["c"] == "buty trekkingowe" and got["d"] == "rower gorski" and got["e"] == "gorski"
    both = df.filter("cluster IN ('c', 'd')").unionByName(df.filter("cluster = 'd'").withColumn("cluster", F.lit("f")))
    assert {r["cluster"]: r["label"] for r in distinct_labels(labels(both), both).collect()}["f"] == "rower gorski damski"


def test_redirects(spark):
    responses = [
        ("http://a.example/", 301, "https://a.example/", None), ("https://a.example/", 200, None, None), ("https://b.example/", 301, "http://b.example/x", None), ("http://b.example/x", 200, None, None),
        ("https://c.example/", 301, "https://c.example/2", None), ("https://c.example/2", 302, "https://c.example/3", None), ("https://c.example/3", 200, None, None), ("https://d.example/", 404, None, None), ("https://e.example/", None, None, "reset"),
        ("https://f.example/", 301, "https://f.example/g", None), ("https://f.example/g", 301, "https://f.example/", None), ("https://h.example/", 301, "https://h.example/i", None), ("https://h.example/i", None, None, "reset"), ("https://k.example/", 302, None, None),
    ]
    starts = [(u,) for u in ("http://a.example/", "https://b.example/", "https://c.example/", "https://d.example/", "https://e.example/", "https://f.example/", "https://h.example/", "https://k.example/", None)]
    out = {r["url"][8 if r["url"][4] == "s" else 7]: r for r in redirect_chains(spark.createDataFrame(starts, "url string"), spark.createDataFrame(responses, "url string, status int, location string, error string")).collect()}
    assert (out["a"]["redirects"], out["a"]["final_status"], out["a"]["downgrade"]) == (1, 200, False)
    assert out["b"]["downgrade"] and out["c"]["redirects"] == 2 and out["d"]["final_status"] == 404 and out["d"]["ok"]
    assert not out["e"]["ok"] and out["f"]["final_status"] == 301 and out["h"]["ok"] and out["h"]["final_status"] is None and out["k"]["final_status"] == 302


def test_long_redirect_chain_ends(spark):
    responses = spark.createDataFrame([(f"u{i}", 301, f"u{i + 1}", None) for i in range(30)], "url string, status int, location string, error string")
    r = redirect_chains(spark.createDataFrame([("u0",)], "url string"), responses).first()
    assert (r["redirects"], r["final_status"], len(r["chain"])) == (11, None, 11)


def test_crawl(spark):
    s = "https://s.example/"
    links = [(s, s + "a", 0), (s, s + "b", 1), (s, "https://www.s.example/c", 2), (s, "mailto:x@y", 3), (s, "https://other.example/", 4), (s, s + "a", 5), (s + "a", s + "d", 0), (s + "b", s + "d", 0), (s + "d", s, 0)]
    links = spark.createDataFrame(links, "page string, href string, ordinal int")
    starts = spark.createDataFrame([(s,)], "start string")
    out = {r["url"]: (r["found_on"], r["depth"], r["ordinal"]) for r in crawl(starts, links).collect()}
    assert out == {s: (None, 0, 0), s + "a": (s, 1, 1), s + "b": (s, 1, 2), "https://www.s.example/c": (s, 1, 3), s + "d": (s + "a", 2, 4)}
    assert {r["url"] for r in crawl(starts, links, 2).collect()} == {s, s + "a"}


def test_caches(spark):
    rows = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:00:10", 2), ("k", "2024-01-01 00:00:10", 3), ("o", "2024-01-01 00:00:00", 4)], "key string, at string, id long").withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert {r["key"]: r["id"] for r in newest(rows, ["key"], "at", "id").collect()} == {"k": 3, "o": 4}
    now = F.lit("2024-01-01 00:00:10").cast("timestamp_ntz")
    assert alive(rows, "at", now, 10.0).count() == 4 and alive(rows, "at", now, 9.999).count() == 2 and alive(rows, "at", now, None).count() == 4
    hits, misses = split_requests(spark.createDataFrame([("k",), ("k",), ("z",), (None,)], "key string"), rows, "key")
    assert [r[0] for r in hits.collect()] == ["k"] and [r[0] for r in misses.collect()] == ["z"]


def test_cosine_and_whitening(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [1.0, 1.0, 0.0]), (2, [0.0, 0.0, 3.0]), (3, None), (4, [1.0])], "id long, vec array<double>")
    assert round(df.filter("id < 2").agg(F.first("vec").alias("a"), F.last("vec").alias("b")).select(cosine(F.col("a"), F.col("b"))).first()[0], 6) in (0.707107, 1.0)
    out = whitened(df, 3).collect()
    assert len(out) == 3 and all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-9 for r in out)
    assert whitened(df.filter("id = 0"), 3).first()["vec"] == [1.0, 0.0, 0.0]
    assert whitened(df.limit(0), 3).count() == 0


def test_vector_clusters(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    groups, noise = vector_clusters(df, 0.9, 2)
    assert {r["id"]: (r["root"], r["component"]) for r in groups.collect()} == {1: (1, 0), 2: (1, 0)}
    assert {r["id"] for r in noise.collect()} == {3, 4, 5, 6, 7}


def test_vector_links_copy_no_block(spark):
    rng = np.random.default_rng(4)
    vecs = [rng.normal(size=3 + i % 2) for i in range(90)]
    vecs[5:30] = [vecs[5] * (i + 1) for i in range(25)]  # numbered apart, of one direction, in several blocks
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vec array<double>").repartition(3)
    unit = [v / np.linalg.norm(v) for v in vecs]
    expected = {(i, j) for i in range(90) for j in range(i + 1, 90) if len(vecs[i]) == len(vecs[j]) and unit[i] @ unit[j] >= 0.9}
    links = blocked_vector_links(df, 0.9, block=8)
    assert sorted((r["a"], r["b"]) for r in links.collect()) == sorted(expected)
    assert all(abs(r["score"] - unit[r["a"]] @ unit[r["b"]]) < 1e-12 for r in links.collect())
    # Blocks are not copied to the pairs they belong to by way of the disk, and groups need no list of all pairs.
    assert "Exchange" not in links._jdf.queryExecution().executedPlan().toString()
    some = [(r["a"], r["b"]) for r in blocked_vector_links(df.coalesce(1), 0.9, block=1000, forest=True).collect()]
    assert len(some) < 90 < len(expected) and brute(some) == brute(expected)
    groups = vector_clusters(df, 0.9)[0]
    assert {r["id"]: r["root"] for r in groups.collect()} == {i: brute(expected).get(i, i) for i in range(90)}


def test_embedding_cache(spark, tmp_path):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    cache = spark.createDataFrame([("a", [9.0], "2024-01-01", 1), ("a", [8.0], "2024-01-02", 2)], "text string, vec array<float>, cached_at string, vec_id long")
    full, fresh = embedded(texts, cache, lambda batch: [[float(len(t))] for t in batch])
    assert {r["text"]: r["vec"] for r in full.collect()} == {"a": [8.0], "b": [1.0]} and fresh.count() == 1
    with pytest.raises(Exception, match="without a vector"):
        embedded(texts, cache.limit(0), lambda batch: [])[0].collect()
    np.save(tmp_path / "mean_m_2.npy", np.zeros(2))
    assert load_background(str(tmp_path), "m", 2) is None
    np.save(tmp_path / "matrix_m_2.npy", np.eye(2))
    assert load_background(str(tmp_path), "m", 2)[1].shape == (2, 2)
    assert spark.range(1).select(model_slug(F.lit("Org/Model-X v2"))).first()[0] == "org-model-x-v2"


def test_title_case(spark):
    df = spark.createDataFrame([("3latka o'neil buty",), (None,)], "t string")
    assert [r[0] for r in df.select(title_case("t")).collect()] == ["3Latka O'Neil Buty", None]


def test_keyword_rows(spark):
    rows = keyword_rows(spark, ["red tent", {"text": "blue tent", "avg_monthly_searches": 5, "kw_id": 9}]).collect()
    assert [(r["kw_id"], r["text"], r["avg_monthly_searches"]) for r in rows] == [(0, "red tent", None), (9, "blue tent", 5)]
    for bad in ([{"kw_id": 1}], [""], [{"text": None}]):
        with pytest.raises(ValueError):
            keyword_rows(spark, bad)


def test_semantic_and_two_stages(spark):
    texts = ["red tent", "tent red big", "oak shelf", "shelf of oak", "garden hose", "garden hoses", "lamp"]
    keywords = keyword_rows(spark, [{"text": t, "avg_monthly_searches": 10 * i, "competition": "LOW"} for i, t in enumerate(texts)])
    vectors = spark.createDataFrame([(texts[0], [1.0, 0.0, 0.1]), (texts[1], [1.0, 0.1, 0.0]), (texts[2], [0.0, 1.0, 0.0]), (texts[3], [0.0, 1.0, 0.1]), (texts[4], [0.0, 0.0, -1.0]), (texts[5], [0.5, 0.5, 1.0]), (None, [1.0, 1.0, 1.0])], "text string, vec array<double>")
    out, noise = keyword_clusters(keywords, "auto", 0.9, vectors=vectors, whitening="none")
    assert {r["cluster"]: r["members"] for r in out.collect()} == {0: texts[:2], 2: texts[2:4]}
    assert {r["kw_id"] for r in noise.collect()} == {4, 5, 6}
    both = {(r["stage"], r["cluster"]): r["members"] for r in two_stage_clusters(keywords, vectors, 0.9, whitening="none").collect()}
    assert both == {("semantic", 0): texts[:2], ("semantic", 2): texts[2:4], ("fuzzy", 4): texts[4:6]}
    mapped = keyword_clusters(keywords, "semantic", 0.9, vectors=vectors, background=(np.zeros(3), np.eye(3)))[0]
    assert {r["cluster"] for r in mapped.collect()} == {0, 2}
    assert keyword_clusters(keywords, "semantic", 0.9, vectors=vectors)[0].count() >= 0
    assert resolve_method("auto", False) == "fuzzy"
    for bad in ({"method": "other"}, {"method": "semantic"}, {"method": "semantic", "vectors": vectors, "whitening": "odd"}):
        with pytest.raises(ValueError):
            keyword_clusters(keywords, **bad)


def test_newest_answer_counts_and_lists(spark):
    answers = [("http://a/", 200, None, None, "2024-01-01"), ("http://a/", 301, "https://a/x", None, "2024-02-01"), ("https://a/x", 404, None, None, None), ("http://b/", None, None, "refused", None)]
    df = spark.createDataFrame(answers, "url string, status int, location string, error string, at string").withColumn("fetched_at", F.col("at").cast("timestamp_ntz"))
    chains = redirect_chains(spark.createDataFrame([("http://a/",), ("http://b/",), (None,)], "url string"), df)
    got = {r["url"]: (r["final_url"], r["final_status"], r["redirects"]) for r in chains.collect()}
    assert got == {"http://a/": ("https://a/x", 404, 1), "http://b/": ("http://b/", None, 0)}
    sites = {r["site"]: r for r in checked(chains).collect()}
    assert sites["a"]["broken_urls"] == sites["a"]["redirected_urls"] == ["http://a/"] and sites["b"]["broken"] == 1 and sites["b"]["redirected_urls"] == []


def test_versions_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([("https://www.h.example/a", "x"), ("https://h.example/b", None), (None, "y")], "url string, text string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    for _ in range(2):
        append_versions(rows, str(tmp_path / "v"))
    out = spark.read.parquet(str(tmp_path / "v"))
    assert sorted((r["domain"], r["text"]) for r in out.collect()) == [("h.example", "x")] * 2 + [("unknown-domain", "y")] * 2
