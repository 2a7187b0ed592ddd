"""The livability query: cells within the chosen times of everything that is asked for, under overlay filters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellreach.functions.units import dequantize, minutes
from cellreach.operators.times import compose

DEFAULT_MINUTES = 30
FULL_RANGE = (0, 4)


@dataclass(frozen=True)
class State:
    """What is asked for: entities with their minutes (None: DEFAULT_MINUTES), overlay filters (none by default), and by which mode each entity is reached."""

    wanted: dict[str, int | None] = field(default_factory=dict)
    climates: tuple[str, ...] = ()
    avoid_power_lines: bool = False
    lean_range: tuple[int, int] = FULL_RANGE
    modes: dict[str, str] = field(default_factory=dict)
    default_mode: str = "drive"

    def of_mode(self, mode: str) -> State:
        """What is asked for by one mode, under the same overlays."""
        own = {k: v for k, v in self.wanted.items() if self.modes.get(k, self.default_mode) == mode}
        return replace(self, wanted=own, modes={}, default_mode=mode)

    def overlay_predicate(self) -> Column | None:
        """One predicate for all overlay filters, or None if nothing is filtered."""
        parts = []
        if self.climates:
            parts.append(F.col("climate_label").isin(list(self.climates)))
        if self.avoid_power_lines:
            parts.append(~F.coalesce("near_power_corridor", F.lit(False)))
        if tuple(self.lean_range) != FULL_RANGE:
            parts.append(F.coalesce(F.col("political_lean"), F.lit(-1)).between(*self.lean_range))
        return reduce(lambda a, b: a & b, parts) if parts else None

    def normalised(self) -> State:
        """Trauma centres and general hospitals exclude each other: the specific one stays."""
        specific = [w for w in self.wanted if w.startswith("trauma_level_")]
        if not specific:
            return self
        kept = {k: v for k, v in self.wanted.items() if k != "hospital"}
        return replace(self, wanted=kept)


def livable(cells: DataFrame, ranked: DataFrame, legs: DataFrame, state: State) -> DataFrame:
    """The cells (cell, overlays) that are within reach of every wanted entity and pass the overlay filters.

    An entity without any leg imposes nothing; with nothing wanted every cell passes.
    """
    spark = cells.sparkSession
    keep = state.overlay_predicate()
    chosen = cells if keep is None else cells.where(keep)
    if not state.wanted:
        return chosen.select("cell")
    asked = spark.createDataFrame([(k, (DEFAULT_MINUTES if v is None else v) * 60) for k, v in state.wanted.items()], "entity string, limit int")
    legs = legs.join(F.broadcast(asked), "entity", "left_semi")
    if keep is not None:  # cells that the overlays rule out are not composed
        ranked = ranked.join(chosen.select("cell").distinct(), "cell", "left_semi")
    known = asked.join(legs.select("entity").distinct(), "entity", "left_semi")
    need = known.agg(F.count(F.lit(1)).alias("need"))
    passed = (
        compose(ranked, legs)
        .join(F.broadcast(known), "entity")
        .where(F.col("total") <= F.col("limit"))
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    reached = chosen.select("cell").distinct().join(passed, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return reached.where(F.col("n") == need.scalar()).select("cell")


def explain_cells(ranked: DataFrame, legs: DataFrame, wanted: list[str]) -> DataFrame:
    """(cell, entity, minutes) for the wanted entities."""
    return compose(ranked, legs.where(F.col("entity").isin(wanted))).select("cell", "entity", minutes(F.col("total")).alias("minutes"))


def livable_percent(cells: DataFrame, visible: DataFrame) -> DataFrame:
    """(visible, baseline, percent) over the core cells; percent is rounded and within 0..100."""
    marked = cells.where("is_core").select("cell").join(visible.select("cell", F.lit(True).alias("v")), "cell", "left")
    counts = marked.agg(F.count_if(F.col("v")).alias("visible"), F.count(F.lit(1)).alias("baseline"))
    share = F.round(100.0 * F.col("visible") / F.greatest(F.col("baseline"), F.lit(1)))
    return counts.withColumn("percent", F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)).cast("int"))


def livable_layers(cells: DataFrame, ranked: DataFrame, legs: DataFrame, state: State, modes: tuple[str, ...] = ("drive", "walk")) -> DataFrame:
    """(mode, cell): the livable cells by each mode, of ranked (mode, cell, anchor, t) and legs (mode, anchor, entity, seconds).

    A mode is a layer of its own: its entities bind that layer alone, the overlays bind every layer. A mode without an entity that anything can reach has no rows
    unless overlays are set; with no layer at all the default mode shows every cell.
    """
    state = state.normalised()
    keep = state.overlay_predicate()
    out = []
    for mode in modes:
        own = state.of_mode(mode)
        mine = legs.where(F.col("mode") == mode).drop("mode")
        if keep is None and not (own.wanted and mine.where(F.col("entity").isin(list(own.wanted))).head(1)):
            continue
        layer = livable(cells, ranked.where(F.col("mode") == mode).drop("mode"), mine, own)
        out.append(layer.select(F.lit(mode).alias("mode"), "cell"))
    return reduce(DataFrame.unionByName, out) if out else cells.select(F.lit(state.default_mode).alias("mode"), "cell")


def hover(cells: DataFrame, ranked: DataFrame, legs: DataFrame, wanted: list[str], months: list[str], scale: float = 0.1) -> DataFrame:
    """(cell, label, summer, winter, precip, temps, rains, minutes) of cells with quantised climate columns.

    Monthly lists are null unless all months have a value; minutes maps each wanted entity that can be reached to whole minutes.
    """
    value = lambda c: dequantize(F.col(c), scale) if c in cells.columns else F.lit(None).cast("double")

    def monthly(pattern: str) -> Column:
        values = F.array(*[value(pattern.format(m)) for m in months])
        return F.when(~F.exists(values, lambda v: v.isNull()), values)

    named = {"summer": "temp_mean_summer_f_q", "winter": "temp_mean_winter_f_q", "precip": "ppt_ann_in_q"}
    label = F.col("climate_label") if "climate_label" in cells.columns else F.lit(None).cast("string")
    climate = cells.select(
        "cell", label.alias("label"), *[value(c).alias(n) for n, c in named.items()], monthly("temp_mean_{}_f_q").alias("temps"), monthly("ppt_{}_in_q").alias("rains")
    )
    each = explain_cells(ranked, legs, wanted).groupBy("cell").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "minutes")))).alias("minutes"))
    return climate.join(each, "cell", "left")
