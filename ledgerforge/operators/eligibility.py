"""Schemes that businesses qualify for, with reasons: E1-E3, J8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept

#: Rules that are broadcast, about 20 MB.
MOST_RULES = 50_000


def eligibility(businesses: DataFrame, schemes: DataFrame) -> DataFrame:
    """Every business against every scheme: `eligible` and the list of checks.

    Every pair is a row of the result, so the pairing is a nested loop; the rule table is
    broadcast when its count allows it. Ages bound only where they are set.
    """
    c = F.col
    check = lambda label, ok: F.struct(label.alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"))
    wild = lambda rule, own: (c(f"s.{rule}") == "Any") | (c(f"s.{rule}") == c(f"b.{own}"))
    low, high = c("s.min_age"), c("s.max_age")
    checks = F.array_compact(F.array(
        check(F.lit("Turnover within range"), c("b.turnover").between(c("s.min_turnover"), c("s.max_turnover"))),
        check(F.lit("State matches"), wild("applicable_states", "state")),
        check(F.lit("Sector matches"), wild("sector", "sector")),
        check(F.lit("Business category matches"), wild("business_category", "business_category")),
        F.when(low.isNotNull(), check(F.concat(F.lit("Owner age >= "), low.cast("int").cast("string")), c("b.owner_age") >= low)),
        F.when(high.isNotNull(), check(F.concat(F.lit("Owner age <= "), high.cast("int").cast("string")), c("b.owner_age") <= high)),
    ))
    rules = F.broadcast(schemes) if schemes.count() <= MOST_RULES else schemes
    pairs = businesses.alias("b").crossJoin(rules.alias("s"))
    kept = [c for c in ("scheme_id", "scheme_name", "benefit_summary", "source_url", "last_verified_date") if c in schemes.columns]
    rows = pairs.select("b.business_id", *[f"s.{k}" for k in kept], checks.alias("checks"))
    return rows.withColumn("eligible", F.forall("checks", lambda x: x["passed"]))


def _scale(turnover: Column) -> Column:
    """The power of two a turnover lies in; 0 below 1. It never falls as turnovers rise."""
    return F.when(turnover >= 1, F.floor(F.log2(turnover)).cast("int") + 1).otherwise(0)


def _merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The turnovers that the closed ranges of a key cover together, as ranges that share none."""
    c = F.col
    ordered = Window.partitionBy(*keys).orderBy("min_turnover", "max_turnover")
    reached = F.max("max_turnover").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(c("min_turnover") <= c("reached"), 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    parts = ranges.withColumn("reached", reached).withColumn("part", part)
    return parts.groupBy(*keys, "part").agg(F.min("min_turnover").alias("min_turnover"), F.max("max_turnover").alias("max_turnover")).drop("part")


def eligible_names(businesses: DataFrame, schemes: DataFrame) -> DataFrame:
    """Names of the schemes that fit, once each, without looking at those that do not.

    Businesses of one state, sector, category and scale of turnover ask alike: under their own
    values and under `Any` for each (eight keys at most). What all schemes of a name without ages
    cover for them is merged to ranges that share no turnover, so a business meets a name there
    once, however many schemes bear it. A scheme with ages matters only where these leave a gap in
    its range for those who ask under its own values; the rest of them meet businesses one by one.
    Only where a business has several profiles is the whole result looked through for repeats.
    """
    c = F.col
    own = ["state", "sector", "business_category", "scale"]
    either = lambda value: F.explode(F.array_distinct(F.array(c(value), F.lit("Any")))).alias(value)
    # A missing value asks under `Any` alone, as `Any` itself does.
    people = businesses.filter("turnover IS NOT NULL").select(
        "business_id", "turnover", "owner_age", *[F.coalesce(c(k), F.lit("Any")).alias(k) for k in own[:-1]], _scale(c("turnover")).alias("scale")
    )
    # A name that is missing counts as one.
    rules = schemes.filter("min_turnover <= max_turnover").select(
        F.struct("scheme_name").alias("name"), c("applicable_states").alias("state"), "sector", "business_category", "min_turnover", "max_turnover", "min_age", "max_age",
        F.explode(F.sequence(_scale(c("min_turnover")), _scale(c("max_turnover")))).alias("scale"),
    ).dropna(subset=own[:-1])
    ageless = c("min_age").isNull() & c("max_age").isNull()
    groups = people.select(*own).distinct()

    def asking(of: DataFrame) -> DataFrame:
        """The groups `of` (with their values as `asks`) under each key."""
        asks = of.select(F.struct(*own).alias("asks"), *own)
        for k in own[:-1]:
            asks = asks.select("asks", *[either(k) if x == k else x for x in own])
        return asks

    aged = rules.filter(~ageless)
    asks = asking(groups.union(aged.select(*own)).distinct())
    ranges = _merged(rules.filter(ageless), ["name", *own])
    covered = kept(_merged(asks.join(ranges, own).select("asks", "name", "min_turnover", "max_turnover"), ["asks", "name"]).select("asks.*", "name", "min_turnover", "max_turnover"))
    wide = covered.withColumnsRenamed({"min_turnover": "from", "max_turnover": "to"})

    def beside(rows: DataFrame, low: str, high: str) -> DataFrame:
        """`rows` whose turnovers no merged range of their name covers."""
        on = (c(low) >= c("from")) & (c(high) <= c("to"))
        for k in (*own, "name"):
            on = on & (rows[k] == wide[k])
        return rows.join(wide, on, "left_anti")

    by_range = people.join(covered, own).filter(c("turnover").between(c("min_turnover"), c("max_turnover")))
    gaps = kept(beside(aged, "min_turnover", "max_turnover"))
    gaps = gaps.join(asking(groups), own).select("asks.*", "name", "min_turnover", "max_turnover", "min_age", "max_age")
    fits = c("turnover").between(c("min_turnover"), c("max_turnover")) & (c("min_age").isNull() | (c("owner_age") >= c("min_age"))) & (c("max_age").isNull() | (c("owner_age") <= c("max_age")))
    by_age = beside(people.join(gaps, own).filter(fits), "turnover", "turnover")
    by_range, by_age = (found.select("business_id", "name.scheme_name") for found in (by_range, by_age))
    once = people.groupBy("business_id").count().filter("count > 1").isEmpty()
    return by_range.union(by_age.distinct()) if once else by_range.union(by_age).distinct()


def profile_from_kpis(figures: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles with the yearly turnover that the accounts show."""
    return profiles.drop("turnover").join(figures.select("business_id", F.col("annual_turnover").alias("turnover")), "business_id")
