import uuid

from pyspark.sql import functions as F

from cellreach.functions import geo, ids, text, units


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_speed_texts(spark):
    given = ["50", "50 km/h", "35 mph", "30;45", "20; 30 mph", "signals", None, "0"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(given)], "k int, v string")
    got = [r["s"] for r in rows.orderBy("k").select(text.maxspeed_kmh(F.col("v")).alias("s")).collect()]
    assert got == [50, 50, 35 * 1.60934, 30, 20 * 1.60934, None, None, None]


def test_voltage_texts(spark):
    given = ["230000", "345 kV", "115;230", "69", None, "110000,13800"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(given)], "k int, v string")
    got = [r["s"] for r in rows.orderBy("k").select(text.voltages(F.col("v")).alias("s")).collect()]
    assert got == [[230000], [345000], [115000, 230000], [69000], [], [110000, 13800]]


def test_later_highway_class_wins(spark):
    assert one(spark, text.highway_kmh(F.lit("primary_residential")), text.highway_kmh(F.lit(None).cast("string"))) == (25.0, 40.0)


def test_shares(spark):
    shares = [0.0, 0.199, 0.2, 0.4, 0.6, 0.8, 1.0]
    assert one(spark, *[units.lean_bucket(F.lit(x)) for x in shares]) == (0, 0, 1, 2, 3, 4, 4)


def test_seconds_clamp(spark):
    got = one(spark, units.drive_seconds(F.lit(1e12), F.lit(50.0)), units.drive_seconds(F.lit(None).cast("double"), F.lit(0.0)), units.walk_seconds(F.lit(100.0)))
    assert got == (65534, 72, 72)


def test_uuid5(spark):
    names = ["", "a", "drive|17", "é"]
    assert one(spark, *[ids.uuid5(F.lit(n)) for n in names]) == tuple(str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names)


def test_h3_parent(spark):
    children = [f"882a32688{d}fffff" for d in "13579bd"]
    got = one(spark, *[geo.h3_string(geo.h3_parent(geo.h3_long(F.lit(c)), 7)) for c in children])
    assert set(got) == {"872a32688ffffff"}


def test_square_parent(spark):
    lon, lat = F.lit(-71.06), F.lit(42.36)
    assert one(spark, geo.parent_cell(geo.cell_of(lon, lat, 10), 3) == geo.cell_of(lon, lat, 7)) == (True,)


def test_fips_and_texts(spark):
    got = one(spark, text.clean_fips(F.lit("1001.0")), text.coalesce_text(F.lit(" "), F.lit(" x ")), text.rate_per(F.lit("1,234.5 per 100k")), text.rate_per(F.lit("7")))
    assert got == ("01001", "x", 1234.5, None)


def test_climate_quantities_out_of_range(spark):
    assert one(spark, units.quantize(F.lit(1e9)), units.quantize(F.lit(-5.0), signed=False), units.quantize(F.lit(7.25))) == (None, 0, 73)
