"""Ratios and elasticities between two periods of a segment.

Defined cases: a ratio with a zero or missing denominator is null and ``error`` names the reason; several rows of one
segment and period are summed; segments with one period only get an error and no figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cost_ratios(cost: Column, revenue: Column) -> list[Column]:
    """ers (cost / revenue), roas (revenue / cost), roi (roas - 1); null where revenue or cost isn't positive."""
    ers = F.when(revenue > 0, cost / revenue)
    roas = F.when(cost > 0, revenue / cost)
    return [ers.alias("ers"), roas.alias("roas"), (roas - 1).alias("roi")]


def percent_change(before: Column, after: Column) -> Column:
    """after / before - 1, null for a zero baseline."""
    return F.when(before != 0, after / before - 1)


def elasticity(clicks_before: Column, clicks_after: Column, cpc_before: Column, cpc_after: Column) -> Column:
    """Relative change of clicks over relative change of cost per click; null where either change is undefined or the latter is 0."""
    price = percent_change(cpc_before, cpc_after)
    return F.when(price != 0, percent_change(clicks_before, clicks_after) / price)


def marginal_ratios(ers: Column, e: Column) -> list[Column]:
    """Marginal ers and the ratios at which the marginal return is 1, by elasticity; null for e = 0."""
    rise = F.when(e != 0, 1 + 1 / e)
    return [(ers * rise).alias("marginal_ers"), rise.alias("target_roas"), F.when(e != 0, 1 / e).alias("target_roi"), F.when(rise != 0, 1 / rise).alias("target_ers")]


def before_after(periods: DataFrame, before: str, after: str) -> DataFrame:
    """One row per segment with both periods' cost, revenue, clicks side by side, elasticity and marginal ratios.

    ``periods``: segment, period, cost, revenue, clicks. One shuffle on the segment, sums combined before it.
    """
    def side(period: str, c: str) -> Column:
        return F.sum(F.when(F.col("period") == period, F.col(c))).alias(f"{c}_{'before' if period == before else 'after'}")

    both = periods.filter(F.col("period").isin(before, after)).groupBy("segment").agg(*[side(p, c) for p in (before, after) for c in ("cost", "revenue", "clicks")])
    for end in ("before", "after"):
        both = both.withColumn(f"cpc_{end}", F.when(F.col(f"clicks_{end}") != 0, F.col(f"cost_{end}") / F.col(f"clicks_{end}")))
    e = elasticity(F.col("clicks_before"), F.col("clicks_after"), F.col("cpc_before"), F.col("cpc_after"))
    both = both.withColumn("elasticity", e)
    ers = F.when(F.col("revenue_after") > 0, F.col("cost_after") / F.col("revenue_after"))
    missing = F.concat_ws(", ", *[F.when(F.col(f"{c}_{s}").isNull(), F.lit(f"{c}_{s}")) for s in ("before", "after") for c in ("cost", "revenue", "clicks")])
    error = F.when(missing != "", F.concat(F.lit("missing "), missing)).when(F.col("elasticity").isNull(), "no change of the cost per click or a zero baseline").when(ers.isNull(), "no revenue")
    return both.select("*", ers.alias("ers"), *marginal_ratios(ers, F.col("elasticity")), error.isNull().alias("ok"), error.alias("error"))
