"""N-gram aggregation over search terms.

Defined cases: rows whose term is null or blank take no part in totals' sums but count in ``terms``; null metrics are 0;
negative metrics (corrections) are summed as they are; a row adds to each distinct n-gram of its term once; equal rows add
each; ratios with a zero denominator are null. Columns besides the known ones are dropped first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.functions.text import STOPWORDS, fold_terms, is_function_gram, ngrams, term_tokens

#: Accepted spellings of each field, first present and non-null wins.
ALIASES = {
    "term": ("term", "search_term", "text"),
    "cost": ("cost",),
    "clicks": ("clicks",),
    "impressions": ("impressions", "impr"),
    "conversions": ("conversions", "conv"),
    "conv_value": ("conv_value", "value", "conversions_value"),
}
METRICS = tuple(ALIASES)[1:]


@dataclass(frozen=True)
class NgramOptions:
    sizes: tuple[int, ...] = (1, 2, 3)
    target_cpa: float | None = None
    target_roas: float | None = None
    min_cost: float = 0.0
    min_terms: int = 1
    drop_stopwords: bool = True
    stopwords: tuple[str, ...] | None = None


def normalize_schema(rows: DataFrame) -> DataFrame:
    """term and the five metrics as doubles, from any accepted spelling."""

    def pick(names: tuple[str, ...], default: Column) -> Column:
        there = [F.col(f"`{n}`") for n in names if n in rows.columns]
        return F.coalesce(*there, default) if there else default

    metrics = [pick(ALIASES[m], F.lit(0.0)).cast("double").alias(m) for m in METRICS]
    return rows.select(pick(ALIASES["term"], F.lit("")).cast("string").alias("term"), *metrics)


def _not_blank(rows: DataFrame) -> DataFrame:
    return rows.filter(F.trim("term") != "")


def totals(rows: DataFrame) -> DataFrame:
    """One row: summed metrics, ``terms`` (all rows) and the account's ratios."""
    rows = normalize_schema(rows)
    held = F.trim("term") != ""
    sums = rows.agg(*[F.coalesce(F.sum(F.when(held, F.col(m))), F.lit(0.0)).alias(m) for m in METRICS], F.count("*").alias("terms"))
    return sums.select("*", *_ratios())


def _ratios() -> list[Column]:
    return [
        F.try_divide("clicks", "impressions").alias("ctr"),
        F.try_divide("conversions", "clicks").alias("conv_rate"),
        F.try_divide("cost", "conversions").alias("cpa"),
        F.try_divide("conv_value", "cost").alias("roas"),
    ]


def exploded(rows: DataFrame, options: NgramOptions = NgramOptions()) -> DataFrame:
    """One row per (input row, distinct n-gram): term, metrics, ngram, n.

    Equal terms are folded once: metrics are pre-aggregated per raw term, so a term with a third of all rows is one row here.
    """
    per_term = _not_blank(normalize_schema(rows)).groupBy("term").agg(*[F.sum(m).alias(m) for m in METRICS], F.count("*").alias("rows"))
    grams = per_term.select("*", F.explode(F.array_distinct(ngrams(term_tokens(F.col("term")), options.sizes))).alias("g")).select("term", *METRICS, "rows", "g.ngram", "g.n")
    if not options.drop_stopwords:
        return grams
    if options.stopwords is None:
        return grams.filter(~is_function_gram(F.col("ngram"), STOPWORDS))
    spark = rows.sparkSession
    own = [r[0] for r in spark.createDataFrame([(w,) for w in options.stopwords] or [("",)], "w string").select(fold_terms(F.col("w"))).collect()]
    return grams.filter(~is_function_gram(F.col("ngram"), own))


def ngram_table(rows: DataFrame, options: NgramOptions = NgramOptions(), keywords: DataFrame | None = None, sessions: DataFrame | None = None, against_account: bool = True) -> DataFrame:
    """Metrics, ratios, wasted spend (``nscore``) and deltas against the account for every n-gram.

    ``blocked_search_terms`` counts distinct raw terms. With ``keywords`` (text) ``blocked_keywords`` counts keywords holding the n-gram;
    with ``sessions`` the columns of ``engagement`` are added, null where no term of the n-gram has any. Without
    ``against_account`` the facts are read once and there are no ``vs_avg_`` columns.
    """
    sums = exploded(rows, options).groupBy("ngram", "n").agg(*[F.sum(m).alias(m) for m in METRICS], F.count("*").alias("blocked_search_terms"))
    sums = sums.filter((F.col("cost") >= options.min_cost) & (F.col("blocked_search_terms") >= options.min_terms))
    if keywords is not None:
        sums = sums.join(keyword_grams(keywords, options.sizes), ["ngram", "n"], "left").withColumn("blocked_keywords", F.coalesce("blocked_keywords", F.lit(0).cast("long")))
    if options.target_cpa is not None:
        waste = F.col("cost") - F.col("conversions") * options.target_cpa
    elif options.target_roas is not None:
        waste = F.col("cost") - (F.col("conv_value") / options.target_roas if options.target_roas else F.lit(0.0))
    else:
        waste = F.when(F.col("conversions") == 0, F.col("cost")).otherwise(F.col("cost") - F.col("conv_value"))
    table = sums.select("*", *_ratios(), waste.alias("nscore"))
    if sessions is not None:
        table = table.join(engagement(rows, sessions, options), ["ngram", "n"], "left")
    if not against_account:
        return table
    account = totals(rows).select(*[F.col(c).alias(f"avg_{c}") for c in ("ctr", "conv_rate", "cpa", "roas")])

    def against(c: str) -> Column:
        delta = F.when(F.col(f"avg_{c}") != 0, F.col(c) / F.col(f"avg_{c}") - 1)
        return (-delta if c == "cpa" else delta).alias(f"vs_avg_{c}")  # a lower cost per conversion is better

    # The account is one row by construction of a global aggregate, so its broadcast is bounded.
    return table.crossJoin(F.broadcast(account)).select(*table.columns, *[against(c) for c in ("ctr", "conv_rate", "cpa", "roas")])


def keyword_grams(keywords: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(ngram, n, blocked_keywords): keyword rows that hold each n-gram; stopwords count here."""
    grams = keywords.select(F.explode(F.array_distinct(ngrams(term_tokens(F.col("text")), sizes))).alias("g"))
    return grams.groupBy("g.ngram", "g.n").agg(F.count("*").alias("blocked_keywords"))


def ranked(table: DataFrame, limit: int | None = None) -> DataFrame:
    """By nscore, ties by ngram and n."""
    out = table.orderBy(F.desc("nscore"), "ngram", "n")
    return out.limit(limit) if limit else out


def negatives(table: DataFrame, require_zero_conversions: bool = True, limit: int | None = None) -> DataFrame:
    """N-grams with waste (and, by default, no conversions) among the first ``limit`` by nscore; tested on values rounded to cents."""
    kept = ranked(table, limit).filter(F.round("nscore", 2) > 0)
    if require_zero_conversions:
        kept = kept.filter(F.round("conversions", 2) == 0)
    return kept


def engagement(rows: DataFrame, sessions: DataFrame, options: NgramOptions = NgramOptions()) -> DataFrame:
    """Session metrics per n-gram; ``sessions`` (term, sessions, engaged_sessions, bounce_rate) joins on the raw term.

    A term's sessions count once per fact row with that term. The bounce rate is weighted by the sessions of rows that have one.
    """
    side = sessions.groupBy("term").agg(*[F.first(c, ignorenulls=True).alias(f"s_{c}") for c in ("sessions", "engaged_sessions", "bounce_rate")])
    joined = exploded(rows, options).join(side, "term")
    s = F.coalesce("s_sessions", F.lit(0.0)) * F.col("rows")
    agg = joined.groupBy("ngram", "n").agg(
        F.sum(s).alias("sessions"),
        F.sum(F.coalesce("s_engaged_sessions", F.lit(0.0)) * F.col("rows")).alias("engaged_sessions"),
        F.sum(F.when(F.col("s_bounce_rate").isNotNull(), F.col("s_bounce_rate") * s)).alias("bounces"),
        F.sum(F.when(F.col("s_bounce_rate").isNotNull(), s)).alias("rated"),
    )
    return agg.select("ngram", "n", "sessions", "engaged_sessions", F.try_divide("engaged_sessions", "sessions").alias("engagement_rate"), F.try_divide("bounces", "rated").alias("bounce_rate"))
