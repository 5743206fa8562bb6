"""Page views, versions, deliveries, sources on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from adlens.operators.html import coverage, gaps, known_availability, missing_pages, parsed, phrase_matches, product_view, resolved, signals
from adlens.operators.snapshot_diff import changes as changes_between
from adlens.operators.snapshot_diff import bits_for, normal_url, open_rows, row_digests, snapshot_changes
from adlens.operators.versions import diffs, flagged
from adlens.sources.embeddings import EmbeddingSettings, embedding_model, embedding_request
from adlens.sources.pages import domain_slug, inline, output_format, received, url_slug
from adlens.sources.rest import ENDPOINTS, RestSource, answered, await_task, flattened, location_options, request_for, requests_table, send, tasks_ready
from adlens.streaming.page_changes import changes
from adlens.streaming.search_terms import drained, read_files

PAGE = """<html lang="pl"><head><title>Buty trekkingowe</title><meta name="description" content="Krótki opis"><meta name="viewport" content="width=device-width">
<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"Product","name":"But","image":["a.jpg"],"offers":{"@type":"Offer","price":0,"priceCurrency":"PLN","availability":"https://schema.org/InStock"}}]}</script></head>
<body><h1>Buty <a href="/x">trekkingowe</a></h1><svg><text>ikona</text></svg><p>Wygodne bút<b>y</b>.</p><a href="/kup">Kup teraz</a><img src="a.jpg" alt=""></body></html>"""
PAGES = "page_id long, final_url string, html string"


def test_views_of_one_page(spark):
    df = spark.createDataFrame([(1, "https://shop.example/p/1", PAGE), (2, "http://x", None), (3, None, ""), (4, "http://x", "<p>" + "słowo " * 50_000)], PAGES)
    rows = {r["page_id"]: r for r in parsed(df, ("content", "audit", "text", "links", "product")).collect()}
    one = rows[1]
    assert (one["content"]["words"], one["audit"]["words"], one["audit"]["ctas"], one["audit"]["cta_words"], one["audit"]["images_no_alt"]) == (7, 8, 1, ["kup teraz"], 1)
    assert one["text"] == "Buty trekkingowe\nWygodne búty.\nKup teraz" and one["links"] == ["/x", "/kup"]
    assert one["product"]["types"] == ["WebPage", "Product", "Offer"] and one["product"]["missing"] == [] and one["product"]["advised"] == ["description", "brand", "sku/mpn/gtin"]
    assert not rows[2]["ok"] and rows[2]["content"] is None and rows[3]["ok"] and rows[3]["content"]["words"] == 0 and rows[4]["content"]["words"] == 50_000
    flags = {r["page_id"]: r["flags"] for r in signals(df).collect()}
    assert flags[1] == ["meta description too short", "thin content (<200 words)", "images without alt (1/1)"] and flags[2] is None


def test_unclosed_head_elements(spark):
    df = spark.createDataFrame([(1, "<head><noscript>x</head><body><p>seen</p></body>"), (2, "<title>t<body><p>y")], "page_id long, html string")
    rows = {r["page_id"]: r for r in parsed(df, ("text", "content")).collect()}
    assert rows[1]["text"].endswith("seen") and rows[1]["content"]["text"] == ""


def test_coverage(spark):
    df = spark.createDataFrame([(1, "", PAGE)], PAGES)
    matrix = coverage(parsed(df, ("content",)), ["BÚTY", "kup teraz", "ikona", "c++"])
    got = {r["keyword"]: (r["count"], r["in_title"], r["in_headings"]) for r in matrix.collect()}
    assert got == {"BÚTY": (1, True, True), "kup teraz": (1, False, False), "ikona": (0, False, False), "c++": (0, False, False)}
    assert {r["keyword"] for r in gaps(matrix).collect()} == {"ikona", "c++"}


def test_offers():
    def missing(offer):
        return product_view([json.dumps({"@type": "Product", "name": "n", "image": "i", "offers": offer})])["missing"]

    assert missing({"@type": "AggregateOffer", "lowPrice": 1, "priceCurrency": "PLN"}) == []
    assert missing({"@type": ["https://schema.org/AggregateOffer"], "priceCurrency": "PLN"}) == ["offers.lowPrice"]
    assert missing({"@type": "Offer"}) == ["offers.price", "offers.priceCurrency", "offers.availability"]
    assert missing([]) == ["offers"] and product_view(["{bad"])["errors"]
    assert product_view(["[" * 5000 + "]" * 5000])["found"] is False


def test_availability(spark):
    df = spark.createDataFrame([("https://schema.org/InStock",), (" instock ",), ("soon",), (None,)], "v string")
    assert [r[0] for r in df.select(known_availability(F.col("v"))).collect()] == [True, True, False, False]


def test_resolved_links(spark):
    df = spark.createDataFrame([("https://s.example/d/", h) for h in ("/a", "b#f", "mailto:x@y", None, "//o.example/z", "http://[bad")], "b string, h string")
    assert [r[0] for r in df.select(resolved("b", "h")).collect()] == ["https://s.example/a", "https://s.example/d/b", None, None, "https://o.example/z", None]


VERSIONS = "snap_id long, url string, fetched_at string, text string"


def versions(spark, rows):
    return spark.createDataFrame(rows, VERSIONS).withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz")).withColumn("old", F.lit("clash")).withColumn("hash", F.lit(None).cast("string"))


def test_versions(spark):
    df = versions(spark, [(1, "u", "2024-01-01", "A\nB"), (2, "u", "2024-01-02", "A\nB"), (3, "u", "2024-01-03", "A\nC"), (4, "u", "2024-01-04", "A\nC\n++x"), (5, "u", None, None), (6, "v", "2024-01-01", "")])
    assert {r["snap_id"]: r["changed"] for r in flagged(df).collect()} == {1: None, 2: False, 3: True, 4: True, 6: None}
    assert {r["snap_id"]: (r["added"], r["removed"]) for r in diffs(df).collect()} == {3: (1, 1), 4: (0, 0)}


def test_versions_of_a_domain(spark):
    df = versions(spark, [(1, "http://d.example/a", "2024-01-01", "A"), (2, "http://www.d.example/b", "2024-01-02", "B"), (3, "http://d.example/a", "2024-01-03", "A")])
    assert {r["snap_id"]: r["changed"] for r in flagged(df).collect()} == {1: None, 2: None, 3: False}
    assert {r["snap_id"]: r["changed"] for r in flagged(df, scope="domain").collect()} == {1: None, 2: True, 3: True}


def test_version_stream(spark, tmp_path):
    df = versions(spark, [(1, "u", "2024-01-01", "A"), (2, "u", "2024-01-02", "A"), (3, "u", "2024-01-03", "B"), (4, "w", "2024-01-01", "x")])
    df.coalesce(1).write.parquet(f"{tmp_path}/v.parquet")
    out = drained(changes(read_files(spark, f"{tmp_path}/v.parquet")), "append").collect()
    assert sorted((r["url"], str(r["fetched_at"])[:10], r["changed"]) for r in out if r["changed"] is not None) == [("u", "2024-01-02", False), ("u", "2024-01-03", True)]
    assert len(out) == 4


def test_normal_url(spark):
    urls = ["HTTPS://WWW.A.Example/P/x/?utm_source=1&b=2#top", "http://a.example", "http://a.example//", "https://a.example/x?utm_a=1", "https://a.example/?q=/a/", "#"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(normal_url(F.col("u"))).collect()]
    assert got == ["https://www.a.example/P/x?b=2", "http://a.example", "http://a.example", "https://a.example/x", "https://a.example?q=/a/", ""]


def brute_changes(rows):
    latest = {}
    for snap, delivery, url, at, text in rows:
        if text is not None and url is not None:
            key = (delivery, url)
            if key not in latest or (at or "", snap) > latest[key][0]:
                latest[key] = ((at or "", snap), " ".join(text.replace("\t", " ").replace("\n", " ").split(" ")).split())
    held = {d for d, _ in latest}
    out = set()
    for d in held:
        if d - 1 in held:
            new, old = ({u: t for (x, u), (_, t) in latest.items() if x == y} for y in (d, d - 1))
            out |= {(d, u, "added") for u in new.keys() - old.keys()} | {(d, u, "removed") for u in old.keys() - new.keys()} | {(d, u, "changed") for u in new.keys() & old.keys() if new[u] != old[u]}
    return out


def test_snapshot_changes(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice([1, 2, 3, 5]), rng.choice([f"http://h/{j}" for j in range(25)] + [None]), rng.choice(["2024-01-01", "2024-01-02", None]), rng.choice([None, "a b", "a  b\n", "a\tc", "", "z" * 100_000])) for i in range(150)]
    df = spark.createDataFrame(rows, "snap_id long, delivery int, url string, fetched_at string, text string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz")).withColumn("page", F.lit("clash")).withColumn("digest", F.lit(1))
    for bits, step in ((16, 8), (4, 3), (5, 5)):
        got = {tuple(r) for r in snapshot_changes(df, leaf_bits=bits, level_bits=step).collect()}
        assert got == brute_changes(rows)
    assert {tuple(r) for r in snapshot_changes(df).collect()} == brute_changes(rows)
    assert snapshot_changes(df.limit(0)).count() == 0
    # Digests kept of the earlier deliveries serve as well as their texts.
    kept = row_digests(df.filter("delivery < 3")).unionByName(row_digests(df.filter("delivery >= 3")))
    assert {tuple(r) for r in changes_between(kept).collect()} == brute_changes(rows)


def test_few_rows_are_compared(spark):
    """The leaves follow the number of pages, so that about as many rows are compared as changed."""
    for pages in (300, 6000):
        ids = spark.range(pages)
        old = ids.select(F.lit(1).alias("delivery"), F.concat(F.lit("http://h/"), "id").alias("url"), F.lit("a").alias("text"), F.col("id").alias("snap_id"), F.lit(None).cast("timestamp_ntz").alias("fetched_at"))
        new = old.withColumn("delivery", F.lit(2)).withColumn("text", F.when(F.col("snap_id") % 50 == 0, "b").otherwise(F.col("text")))
        digests = row_digests(old.unionByName(new))
        opened = open_rows(digests).filter("side = 1").count()
        assert pages // 50 <= opened <= 3 * pages // 50
    assert [bits_for(n) for n in (0, 1, 16, 17, 10**9)] == [4, 4, 4, 5, 30]


def answer(status, results, task=20000):
    return json.dumps({"status_code": status, "status_message": "m", "cost": 0.1, "tasks": [{"id": "t", "status_code": task, "status_message": "q", "result": results}]})


def test_envelope(spark):
    df = spark.createDataFrame([(1, answer(20000, [{"a": 1}, {"a": 2}])), (2, answer(40400, None)), (3, "no json"), (4, answer(20000, [], 40602)), (5, None)], "id long, body string")
    rows = flattened(df).collect()
    assert [json.loads(r["result"])["a"] for r in rows if r["id"] == 1] == [1, 2]
    assert {r["id"]: r["ok"] for r in rows} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_retries_and_tasks():
    calls = []

    def transport(answers):
        it = iter(answers)
        return lambda method, path, payload: (calls.append(path), next(it))[1]

    assert send(transport([(429, ""), (200, "x")]), "GET", "p", "", sleep=lambda s: None) == (200, "x") and len(calls) == 2
    calls.clear()
    assert send(transport([(503, "")] * 3), "GET", "p", "", sleep=lambda s: None)[0] == 503 and len(calls) == 3
    clock = iter(range(100))
    ok = await_task(transport([(200, answer(20000, None, 40602)), (200, answer(20000, [1]))]), "get/", answer(20000, None), 10, 1, lambda s: None, lambda: next(clock))
    assert ok[0] == 200
    late = await_task(transport([(200, answer(20000, None, 40602))] * 50), "get/", answer(20000, None), 5, 1, lambda s: None, lambda: next(clock))
    assert late[0] == 504 and json.loads(late[1])["tasks"][0]["id"] == "t"
    assert location_options(2616, "Polish") == {"location_code": 2616, "language_name": "Polish"} and location_options(None) == {}


def echo(method, path, payload):
    return 200, json.dumps({"status_code": 20000, "tasks": [{"id": "1", "status_code": 20000, "result": [json.loads(payload)]}]})


def test_rest_source(spark):
    spark.dataSource.register(RestSource)
    df = spark.read.format("adlens_rest").option("transport", "tests.test_pages:echo").option("path", "p").option("payloads", '[{"k": 1}, {"k": 2}]').load()
    assert sorted(json.loads(r["result"])["k"] for r in flattened(df).collect()) == [1, 2]


def test_names(spark):
    df = spark.createDataFrame([("https://www.example.com/a",), ("not a url",), ("https://x.com/shop/item",), ("https://x.com/",)], "u string")
    got = [tuple(r) for r in df.select(domain_slug(F.col("u")), url_slug(F.col("u"))).collect()]
    assert got[0][0] == "example.com" and got[1][0] == "unknown-domain" and got[2][1] == "shop-item" and got[3][1] == "x-com"
    r = spark.range(1).select(output_format(F.lit("md")), inline(F.lit("x" * 10), F.lit(True), 4), inline(F.lit("x" * 10), F.lit(False), 4)).first()
    assert list(r) == ["markdown", "xxxx", "x" * 10]


def test_endpoints():
    fields = {"keywords": ["a", "b"], "target": "x.example", "keyword": "a", "bid": 2.5}
    for name, (path, wanted) in ENDPOINTS.items():
        got, payload = request_for(name, location="Poland", language=1045, **{f: fields[f] for f in wanted if f != "match"})
        task = json.loads(payload)[0]
        assert got == path and path.startswith("/v3/") and {f: task[f] for f in wanted} == {f: fields.get(f, "broad") for f in wanted}
        assert task["language_code"] == 1045 and ("location_name" in task) == (name != "search_intent")
    for bad in (("nothing", {}), ("serp", {}), ("serp", {"keyword": "a", "bid": 1}), ("search_volume", {"keywords": "abc"})):
        with pytest.raises(ValueError):
            request_for(bad[0], **bad[1])


def test_cached_calls_send_nothing(spark, tmp_path):
    log, fine, failed = str(tmp_path / "calls"), answer(20000, [{"q": 1}]), answer(40000, None)

    def transport(method, path, payload):
        with open(log, "a") as calls:
            calls.write(payload + "\n")
        return 200, failed if "bad" in payload else fine

    asked = requests_table(spark, "serp", [{"keyword": k} for k in ("one", "two", "two", "bad")])
    now = F.lit("2024-05-01").cast("timestamp")
    first, fresh = answered(asked, None, transport, now)
    assert sorted(r["cached"] for r in first.collect()) == [False] * 3 and fresh.count() == 2
    assert len(open(log).readlines()) == 3
    kept = spark.createDataFrame(fresh.collect(), fresh.schema)
    again, more = answered(asked, kept, transport, F.lit("2024-05-02").cast("timestamp"), 2 * 86400)
    assert sorted(r["cached"] for r in again.collect()) == [False, True, True] and more.count() == 0
    assert len(open(log).readlines()) == 4  # the bad answer only
    answered(asked, kept, transport, F.lit("2024-05-09").cast("timestamp"), 2 * 86400)
    assert len(open(log).readlines()) == 7
    assert answered(asked.limit(0), kept, transport, now)[0].count() == 0


def test_ready_tasks():
    ready = json.dumps({"status_code": 20000, "tasks": [{"result": [{"id": "t1"}, {"id": "t2"}, {}]}, {"result": None}]})
    assert tasks_ready(lambda m, p, x: (200, ready) if p == "/v3/serp/tasks_ready" else (404, ""), "/v3/serp/") == ["t1", "t2"]


def test_embedding_requests():
    settings = EmbeddingSettings.of({"model": "m", "base_url": "http://h/"}, None, {"model": None, "dim": 8, "other": 1}, {"api_key": "k"})
    assert embedding_request(["a"], settings) == ("http://h/embeddings", {"model": "m", "input": ["a"], "dimensions": 8}, {"Authorization": "Bearer k"})
    plain = EmbeddingSettings("m", "http://h", "plain")
    assert embedding_request(["a"], plain) == ("http://h/api/embed", {"model": "m", "input": ["a"]}, {})
    assert embedding_model(plain, lambda *a: {"embeddings": [[1.0]]})(["a"]) == [[1.0]]
    assert embedding_model(settings, lambda *a: {"data": [{"embedding": [2.0]}]})(["a"]) == [[2.0]]
    with pytest.raises(ValueError):
        embedding_request(["a"], EmbeddingSettings("m", "http://h"))


def test_received_answers(spark):
    rows = [(1, 200, "żółć".encode("cp1250"), "text/html; charset=windows-1250", None), (2, 404, "nie ma".encode(), None, None), (3, 200, b"\xff", "text/html; charset=unheard-of", None), (4, 200, b"%PDF", "application/pdf", None), (5, None, None, None, "timed out"), (6, 200, b"", "", None)]
    df = spark.createDataFrame(rows, "id int, status int, body binary, content_type string, error string")
    got = {r["id"]: (r["html"], r["ok"]) for r in received(df).collect()}
    assert got == {1: ("żółć", True), 2: ("nie ma", False), 3: ("�", True), 4: ("%PDF", True), 5: (None, False), 6: ("", True)}
    assert {r["id"]: r["html"] for r in received(df, html_only=True).collect()}[4] is None


def test_availability(spark):
    blocks = ['{"@type": "Product", "name": "n", "image": "i", "offers": {"price": 1, "priceCurrency": "EUR", "availability": "%s"}}' % a for a in ("https://schema.org/InStock", "Someday")]
    html = [f'<script type="application/ld+json">{b}</script>' for b in blocks]
    out = {r["page_id"]: r["product"] for r in parsed(spark.createDataFrame(list(enumerate(html)), "page_id int, html string"), ("product",)).collect()}
    assert out[0]["unknown_availability"] is None and out[1]["unknown_availability"] == "Someday" and out[0]["missing"] == out[1]["missing"] == []


def test_phrases_by_their_words(spark):
    pages = [(0, "<title>Blue tent</title><h1>Tents</h1><p>A blue tent, blue\n tent and bluetent.</p>"), (1, "<p>no</p>"), (2, None)]
    content = parsed(spark.createDataFrame(pages, "page_id int, html string"), ("content",))
    phrases = spark.createDataFrame([("blue tent",), ("TENTS",), ("tent and bluetent",), (None,), ("!!",), ("red",), ("no",)], "keyword string")
    got = {(r["page_id"], r["keyword"]): (r["count"], r["in_title"], r["in_headings"]) for r in phrase_matches(content, phrases).collect()}
    assert got == {(0, "blue tent"): (2, True, False), (0, "TENTS"): (1, False, True), (0, "tent and bluetent"): (1, False, False), (1, "no"): (1, False, False)}
    whole = {(r["page_id"], r["keyword"]): r["count"] for r in coverage(content, ["blue tent", "red", "no"]).collect()}
    assert all(whole[k] == got.get(k, (0,))[0] for k in whole) and len(whole) == 6
    assert {r["keyword"]: r["pages"] for r in missing_pages(content, phrases).collect()} == {"blue tent": 1, "TENTS": 1, "tent and bluetent": 1, "!!": 2, "red": 2, "no": 1}
    assert phrase_matches(content, phrases.limit(0)).count() == 0 and phrase_matches(content.limit(0), phrases).count() == 0
