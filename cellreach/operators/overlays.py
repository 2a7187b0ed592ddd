"""Overlay tables by cell: climate and political lean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellreach.functions import units

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
SUMMER, WINTER = ["jun", "jul", "aug"], ["dec", "jan", "feb"]


def pivot_months(rows: DataFrame, key: str, value: str, how: str, prefix: str) -> DataFrame:
    """A column prefix_<mon> for each month of (key, month 1..12, value)."""
    wide = rows.groupBy(key).pivot("month", list(range(1, 13))).agg(getattr(F, how)(value))
    return wide.select(key, *[F.col(f"`{k}`").alias(f"{prefix}_{m}") for k, m in enumerate(MONTHS, 1)])


def climate_rollup(wide: DataFrame, key: str) -> DataFrame:
    """Annual and seasonal figures of t_<mon> (°F) and p_<mon> (inches); missing months are left out."""
    pick = lambda p, months: units.row_stats(F.array(*[F.col(f"{p}_{m}") for m in months]))
    temp, rain = pick("t", MONTHS), pick("p", MONTHS)
    return wide.select(
        key,
        temp["mean"].alias("temp_ann"),
        pick("t", SUMMER)["mean"].alias("temp_summer"),
        pick("t", WINTER)["mean"].alias("temp_winter"),
        temp["max"].alias("temp_hot"),
        temp["min"].alias("temp_cold"),
        rain["sum"].alias("ppt_ann"),
        F.col("p_jul").alias("ppt_jul"),
        F.col("p_dec").alias("ppt_dec"),
    )


def with_label(rollup: DataFrame) -> DataFrame:
    columns = [F.col(c) for c in ("temp_summer", "temp_winter", "ppt_ann", "ppt_jul", "ppt_dec")]
    return rollup.withColumn("climate_label", units.climate_label(*columns))


def election_overlay(results: DataFrame, counties: DataFrame, year: int = 2024) -> DataFrame:
    """counties (fips, ...) with rep_share and political_lean of a presidential election, those without votes left out.

    results: (year, county_fips, office, party, candidatevotes); rows of other years, offices and parties are left out.
    """
    from cellreach.functions.text import clean_fips
    from cellreach.operators.tables import share_pivot

    own = results.where((F.col("year") == year) & (F.col("office") == "US PRESIDENT") & F.col("party").isin("DEMOCRAT", "REPUBLICAN"))
    votes = own.select(clean_fips(F.col("county_fips")).alias("fips"), "party", F.col("candidatevotes").cast("long").alias("votes"))
    shares = lean(share_pivot(votes, "fips", {"DEMOCRAT": "dem_votes", "REPUBLICAN": "rep_votes"}, "total_votes"), "dem_votes", "rep_votes")
    return counties.join(shares, "fips")


def lean(shares: DataFrame, left: str, right: str) -> DataFrame:
    """With rep_share = right / (left + right) where there are votes, and its bucket."""
    both = F.col(left) + F.col(right)
    voted = shares.where(both > 0).withColumn("rep_share", F.col(right) / both)
    return voted.withColumn("political_lean", units.lean_bucket(F.col("rep_share")))
