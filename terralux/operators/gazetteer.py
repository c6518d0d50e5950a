"""Place lookup over a gazetteer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Ranks of place types, bonuses by key, cap of the extent bonus.
PLACE_RANK = {
    "city": 6,
    "municipality": 5,
    "town": 4,
    "borough": 4,
    "village": 3,
    "suburb": 2,
    "hamlet": 2,
    "locality": 1,
}
MINOR_KEYS = ("highway", "building", "address")
EXTENT_CAP = 25.0
MAX_RESULTS = 10


def prominence(osm_key: Column, osm_value: Column, kind: Column, extent: Column) -> Column:
    """Place type, administrative or minor key, and the capped area of the extent."""
    ranks = F.create_map(*(F.lit(v) for pair in PLACE_RANK.items() for v in pair))
    value = F.coalesce(F.nullif(osm_value, F.lit("")), kind, F.lit(""))
    by_key = (
        F.when(osm_key == "place", F.coalesce(F.try_element_at(ranks, value), F.lit(0)) * 10.0)
        .when(osm_key == "boundary", F.lit(8.0))
        .when(osm_key.isin(*MINOR_KEYS), F.lit(-5.0))
        .otherwise(F.lit(0.0))
    )
    area = F.abs(extent[2] - extent[0]) * F.abs(extent[1] - extent[3])
    return by_key + F.when(F.size(extent) == 4, F.least(area, F.lit(EXTENT_CAP))).otherwise(F.lit(0.0))


def label(name: Column, city: Column, county: Column, state: Column, country: Column) -> Column:
    """Name, locality and country; parts equal to the name are left out."""

    def given(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    place = F.coalesce(given(city), given(county), given(state))
    parts = F.array(place, given(country))
    tail = F.filter(parts, lambda p: p.isNotNull() & (p != name))
    return F.array_join(F.concat(F.array(name), tail), ", ")


def valid_place(lon: Column, lat: Column, name: Column) -> Column:
    """P50."""
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & name.isNotNull() & (name != "")


def search(candidates: DataFrame, limit: int = 5) -> DataFrame:
    """Best places per query, most prominent first, original order on ties, 1..10 kept.

    ``candidates`` has query_id, seq, lon, lat, name, osm_key, osm_value, type, city,
    county, state, country and extent.
    """
    kept = max(1, min(limit, MAX_RESULTS))
    scored = candidates.filter(valid_place(F.col("lon"), F.col("lat"), F.col("name"))).select(
        "query_id",
        "seq",
        "lon",
        "lat",
        "name",
        label(*(F.col(c) for c in ("name", "city", "county", "state", "country"))).alias("label"),
        F.coalesce("type", "osm_value", F.lit("place")).alias("place_type"),
        prominence(F.col("osm_key"), F.col("osm_value"), F.col("type"), F.col("extent")).alias("score"),
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return scored.withColumn("place_rank", F.row_number().over(order)).filter(F.col("place_rank") <= kept)
