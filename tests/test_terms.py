"""Text functions, n-grams, period metrics on small tables."""

import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adlens.functions.text import CONTENT_LETTERS, fold_content, fold_terms, keyword_tokens, ngrams, norm_keyword, phrase_count, slug, term_tokens, word_count
from adlens.operators.metrics import before_after
from adlens.operators.ngram import NgramOptions, engagement, negatives, ngram_table, totals
from adlens.streaming.search_terms import drained, read_files, windowed_sums

TERMS = [("red garden hose", 40.0, 16.0, 320.0, 0.0, 0.0), ("garden hose reel", 90.0, 30.0, 600.0, 3.0, 450.0), ("free garden gnome", 12.0, 8.0, 160.0, 0.0, 0.0), ("hose reel sale", 25.0, 10.0, 250.0, 1.0, 80.0)]
FACTS = "term string, cost double, clicks double, impressions double, conversions double, conv_value double"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def table(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_normalisers(spark):
    r = one(spark, term_tokens(F.lit("Größe  Mini-Zelt ØRSTED")), norm_keyword(F.lit("Crème  Brûlée æ")), slug(F.lit("Café – Żory 12")), slug(F.lit("???")), keyword_tokens(F.lit("Zelte; 2-Personen!! grün_x")))
    assert list(r) == [["grosse", "mini", "zelt", "orsted"], "creme brulee æ", "cafe-zory-12", "item", ["zelte", "2", "personen", "grun", "x"]]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=40))
def test_fold_equals_its_definition(spark, text):
    plain = text.translate({ord(k): v for k, v in CONTENT_LETTERS.items()})
    expected = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c)).lower()
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(fold_content(F.col("t"))).first()[0] == expected


def test_fold_of_null_and_long(spark):
    assert one(spark, fold_terms(F.lit(None).cast("string")))[0] == ""
    assert len(one(spark, fold_terms(F.lit("Ä" * 100_000)))[0]) == 100_000


def test_ngrams_and_counts(spark):
    r = one(spark, ngrams(F.array(F.lit("p"), F.lit("q")), (2, 1)), word_count(F.lit("k9 für _z 42 ok")), phrase_count(F.lit("buy now"), F.lit("buy now, then buy\tnow or buy nowhere")), phrase_count(F.lit(" "), F.lit("x")))
    assert [(g["ngram"], g["n"]) for g in r[0]] == [("p q", 2), ("p", 1), ("q", 1)]
    assert list(r)[1:] == [4, 2, 0]


def test_ngram_table(spark):
    facts = spark.createDataFrame(TERMS, FACTS)
    keywords = spark.createDataFrame([("garden hose",), ("hose clamp",), ("Hose",), (None,)], "text string")
    rows = table(ngram_table(facts, NgramOptions(target_cpa=20.0), keywords), "ngram")
    hose, pair = rows["hose"], rows["hose reel"]
    assert hose["cost"] == 155 and hose["conversions"] == 4 and hose["blocked_search_terms"] == 3 and hose["nscore"] == 75
    assert pair["cost"] == 115 and pair["nscore"] == 35 and pair["blocked_search_terms"] == 2 and rows["red"]["nscore"] == 40
    assert [rows[g]["blocked_keywords"] for g in ("hose", "garden hose", "gnome")] == [3, 1, 0]
    assert abs(hose["vs_avg_cpa"] - (1 - (155 / 4) / (167 / 4))) < 1e-9
    wasted = ngram_table(facts, NgramOptions(target_cpa=20.0))
    grams = [r["ngram"] for r in negatives(wasted).collect()]
    assert grams[0] == "red" and {"free", "gnome", "red garden"} <= set(grams) and not {"hose", "reel"} & set(grams)
    assert {r["ngram"] for r in ngram_table(facts, NgramOptions(min_cost=100.0)).collect()} == {"hose", "garden", "garden hose", "reel", "hose reel"}


def test_stopwords(spark):
    facts = spark.createDataFrame([("tent for the beach", 1.0, 1.0, 1.0, 0.0, 0.0)], FACTS)
    assert set(table(ngram_table(facts), "ngram")) == {"tent", "beach", "tent for", "the beach", "tent for the", "for the beach"}
    assert {"for", "for the"} <= set(table(ngram_table(facts, NgramOptions(drop_stopwords=False)), "ngram"))
    assert "tent" not in table(ngram_table(facts, NgramOptions(stopwords=("TÉNT",))), "ngram")


def test_dirty_facts(spark):
    rows = [(None, 1.0, 1.0, 1.0, 0.0, 0.0), ("  ", 5.0, 1.0, 1.0, 0.0, 0.0), ("a b a b", -2.0, None, None, None, None), ("a b a b", 3.0, 1.0, 0.0, 0.0, 0.0), ("żółw " * 2000, 1.0, 1.0, 1.0, 0.0, 0.0)]
    facts = spark.createDataFrame(rows, FACTS).withColumn("n", F.lit(7)).withColumn("ngram", F.lit("x"))
    out = table(ngram_table(facts, NgramOptions(drop_stopwords=False)), "ngram", "n")
    assert out["a b", 2]["cost"] == 1.0 and out["a b", 2]["ctr"] is None and out["zolw", 1]["cost"] == 1.0
    t = totals(facts).first()
    assert (t["terms"], t["cost"]) == (5, 2.0)
    empty = spark.createDataFrame([], FACTS)
    assert ngram_table(empty).count() == 0 and totals(empty).first()["terms"] == 0


def test_engagement(spark):
    facts = spark.createDataFrame(TERMS, FACTS)
    side = spark.createDataFrame([("free garden gnome", 30.0, 6.0, 0.7), ("red garden hose", 10.0, 4.0, None)], "term string, sessions double, engaged_sessions double, bounce_rate double")
    out = table(engagement(facts, side), "ngram")
    assert (out["gnome"]["sessions"], out["gnome"]["engagement_rate"], round(out["gnome"]["bounce_rate"], 6)) == (30, 0.2, 0.7)
    assert (out["garden"]["sessions"], out["garden"]["engagement_rate"], round(out["garden"]["bounce_rate"], 6)) == (40, 0.25, 0.7)
    whole = table(ngram_table(facts, sessions=side), "ngram")
    assert whole["gnome"]["engaged_sessions"] == 6 and whole["sale"]["sessions"] is None and whole["sale"]["cost"] == 25
    assert "vs_avg_ctr" not in ngram_table(facts, against_account=False).columns


def test_periods(spark):
    rows = [("x", "old", 200.0, 800.0, 100.0), ("x", "new", 300.0, 1000.0, 125.0), ("y", "old", 200.0, 800.0, 100.0), ("y", "new", 220.0, 880.0, 110.0), ("z", "old", 5.0, 9.0, None), ("z", "new", 6.0, 9.0, 2.0)]
    out = table(before_after(spark.createDataFrame(rows, "segment string, period string, cost double, revenue double, clicks double"), "old", "new"), "segment")
    assert round(out["x"]["elasticity"], 9) == 1.25 and out["x"]["ok"] and round(out["x"]["target_roas"], 9) == 1.8
    assert not out["y"]["ok"] and "clicks_before" in out["z"]["error"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "c" + str(i % 2), 1.0, 2.0, f"2024-0{1 + i % 5}-01 00:00:00") for i in range(40)]
    df = spark.createDataFrame(rows, "st_id long, campaign string, cost double, clicks double, seen string").withColumn("seen_at", F.col("seen").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    df.repartition(2).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    out = drained(windowed_sums(read_files(spark, f"{tmp_path}/t.parquet", 2), watermark="500 days", key="st_id"))
    assert out.agg(F.sum("rows"), F.sum("clicks")).first()[:] == (40, 80.0)
