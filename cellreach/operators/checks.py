"""Contracts as queries: every check returns the violating rows; empty means passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellreach.functions.units import UNREACHABLE
from cellreach.plans.cuts import spread

#: Rows of times in a task.
TASK_ROWS = 500_000


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def overlay_errors(df: DataFrame, expected: list[str], key: str = "cell", res: str = "res") -> list[str]:
    """What is wrong with an overlay table: missing columns, other types than long and int, null keys, repeated (key, res). Empty if nothing is."""
    missing = missing_columns(df, expected)
    if missing:
        return [f"missing columns: {', '.join(missing)}"]
    kinds = dict(df.dtypes)
    found = [f"{c} is {kinds[c]}, not {want}" for c, want in ((key, "bigint"), (res, "int")) if kinds[c] != want]
    if null_keys(df, [key]).head(1):
        found.append(f"null {key}")
    if duplicate_keys(df, [key, res]).head(1):
        found.append(f"repeated ({key}, {res})")
    return found


def enforce_overlay_types(df: DataFrame, key: str = "cell", res: str = "res") -> DataFrame:
    """df with its key as a long and its resolution as an int, where it has them."""
    return df.withColumns({c: F.col(c).cast(kind) for c, kind in ((key, "long"), (res, "int")) if c in df.columns})


def poi_errors(df: DataFrame, required: list[str]) -> list[str]:
    """What is wrong with a table of places: missing columns, a provenance that is no list."""
    found = [f"missing columns: {', '.join(m)}" for m in [missing_columns(df, required)] if m]
    kind = dict(df.dtypes).get("provenance", "array")
    return found + ([] if kind.startswith("array") else [f"provenance is {kind}, not a list"])


def climate_gaps(columns: list[str], months: list[str]) -> list[str]:
    """The monthly and derived columns that a climate table lacks."""
    monthly = [p.format(m) for m in months for p in ("temp_mean_{}_f_q", "ppt_{}_mm_q", "ppt_{}_in_q")]
    derived = ["temp_mean_ann_f_q", "temp_mean_summer_f_q", "temp_mean_winter_f_q", "ppt_ann_mm_q", "ppt_ann_in_q", "climate_label"]
    return [c for c in monthly + derived if c not in columns]


def tile_errors(layers: dict[str, list[str]], zooms: tuple[int, int], contract: dict) -> list[str]:
    """What an export of layers (name -> properties) breaks of a contract (layer_name, min_zoom, max_zoom, required_properties)."""
    name = contract["layer_name"]
    found = [f"{k} is {z}, not {contract[k]}" for k, z in zip(("min_zoom", "max_zoom"), zooms, strict=True) if z != contract[k]]
    if name not in layers:
        return [f"no layer {name}", *found]
    lacking = sorted(set(contract["required_properties"]) - set(layers[name]))
    found += [f"missing properties: {', '.join(lacking)}"] if lacking else []
    return found + ([] if {"a0_id", "a0_s"} <= set(layers[name]) else ["no a0_id, a0_s"])


def falling_times(times: DataFrame) -> DataFrame:
    """(cell, rank) rows of (cell, rank, t) whose time is less than that of the rank before."""
    before = F.lag("t").over(Window.partitionBy("cell").orderBy("rank"))
    return times.withColumn("_before", before).where("t < _before").drop("_before")


def unpaired_slots(columns: list[str]) -> list[str]:
    """Slots of a wide travel-time table that have an id without seconds, or the reverse."""
    slots = {kind: {c[1:-len(kind)] for c in columns if c.startswith("a") and c.endswith(kind) and c[1:-len(kind)].isdigit()} for kind in ("_id", "_s")}
    return sorted(slots["_id"] ^ slots["_s"], key=int)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(" or ".join(f"`{k}` is null" for k in keys))


def orphans(df: DataFrame, key: str, valid: DataFrame, valid_key: str) -> DataFrame:
    """Rows whose key is not among the valid ones."""
    known = valid.select(F.col(valid_key).alias("_known"))
    return df.join(known, df[key] == known["_known"], "left_anti")


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(~F.col(column).between(low, high))


def sentinel_share(df: DataFrame, column: str) -> DataFrame:
    """(n, n_sentinel, share) of the unreachable sentinel."""
    hit = F.count_if(F.col(column) == UNREACHABLE)
    return df.agg(F.count(F.lit(1)).alias("n"), hit.alias("n_sentinel"), (hit / F.count(F.lit(1))).alias("share"))


def percentiles(df: DataFrame, key: str, column: str) -> DataFrame:
    """Exact P50 and P95 by key, linear between neighbours, sentinels left out."""
    real = df.where(F.col(column) < UNREACHABLE)
    both = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95)))
    return real.groupBy(key).agg(both.alias("p")).select(key, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def faster_parents(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(parent, anchor) rows of parents (parent, anchor, t) that beat every child (parent, anchor, t)."""
    least = children.groupBy("parent", "anchor").agg(F.min("t").alias("child_t"))
    return parents.join(least, ["parent", "anchor"]).where("t < child_t")


def dealt_by_parent(times: DataFrame) -> DataFrame:
    """times (parent, anchor, ...) dealt to tasks of about TASK_ROWS rows; what is grouped or joined by parent and anchor then stays there."""
    return spread(times, TASK_ROWS, "parent", "anchor")


def golden(expected: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """expected (keys, expected, tolerance) against computed (keys, actual): delta and whether it is within tolerance; no figure fails."""
    both = expected.join(computed, keys, "left").withColumn("delta", F.col("actual") - F.col("expected"))
    return both.withColumn("ok", F.coalesce(F.abs("delta") <= F.col("tolerance"), F.lit(False)))


def size_anomalies(ledger: DataFrame, share: float = 0.25, days: int = 7) -> DataFrame:
    """ledger (path, old_size, new_size, age_days) rows that changed by more than share or are older than days."""
    change = F.abs(F.col("new_size") - F.col("old_size")) / F.nullif(F.col("old_size"), F.lit(0))
    marked = ledger.withColumn("resized", F.coalesce(change > share, F.lit(False))).withColumn("stale", F.col("age_days") > days)
    return marked.where("resized or stale")


def climate_violations(df: DataFrame, temps: list[str], rains: list[str]) -> DataFrame:
    """One row (column, low, high, bad) a column: temperatures outside -70..130 °F, negative rain."""
    sums = df.agg(*[f(c).alias(f"{n}_{c}") for c in temps + rains for n, f in (("lo", F.min), ("hi", F.max))])
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"lo_{c}").cast("double").alias("low"),
            F.col(f"hi_{c}").cast("double").alias("high"),
            ((F.col(f"lo_{c}") < (-70 if c in temps else 0)) | ((F.col(f"hi_{c}") > 130) & F.lit(c in temps))).alias("bad"),
        )
        for c in temps + rains
    ]
    return sums.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def climate_warnings(df: DataFrame, summer: str, winter: str, rain_mm: list[str], month_most: float = 1000.0) -> DataFrame:
    """(rule, n): how many rows look wrong, though they break no limit: a month of more rain than month_most mm, a summer colder than the winter, one of the two missing."""
    rules = {
        "summer colder than winter": F.col(summer) < F.col(winter),
        "one season missing": F.col(summer).isNull() != F.col(winter).isNull(),
        **{f"much rain in {c}": F.col(c) > month_most for c in rain_mm},
    }
    counts = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n")) for name in rules])
    return counts.select(F.explode(rows).alias("x")).select("x.*").where("n > 0")
