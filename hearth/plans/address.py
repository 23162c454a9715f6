"""The resident → room → unit → building chain.

The chain is resolved at the *dimension* level (one row per room or per
resident) before any fact table joins it, so a large fact table (bills,
orders, visits) shuffles once, on ``resident_id``.  Units and buildings are
small by nature and are broadcast by AQE on their measured size; rooms and
residents are joined by hash or sort-merge as their sizes decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import full_address


def unit_places(t: dict[str, DataFrame]) -> DataFrame:
    """up_unit_id → place_building_id, building_name, unit_number (units ⋈ buildings)."""
    u = t["units"].select(F.col("unit_id").alias("up_unit_id"), F.col("building_id").alias("up_building_id"),
                          "unit_number")
    b = t["buildings"].select(F.col("building_id").alias("place_building_id"), "building_name")
    return u.join(b, u.up_building_id == b.place_building_id, "inner").drop("up_building_id")


def attach_unit_place(t: dict[str, DataFrame], df: DataFrame, unit_col: str = "unit_id") -> DataFrame:
    """``df`` plus place_building_id, building_name, unit_number (inner: units without a building drop)."""
    up = unit_places(t)
    return df.join(up, df[unit_col] == up.up_unit_id, "inner").drop("up_unit_id")


def attach_room_place(t: dict[str, DataFrame], df: DataFrame, room_col: str = "room_id") -> DataFrame:
    """``df`` plus the room's room_number, area, room_type, unit and building columns and full_address."""
    r = t["rooms"].select(F.col("room_id").alias("rp_room_id"), F.col("unit_id").alias("rp_unit_id"),
                          "room_number", "area", "room_type")
    placed = attach_unit_place(t, r, "rp_unit_id")
    return (df.join(placed, df[room_col] == placed.rp_room_id, "inner")
              .drop("rp_room_id")
              .withColumnRenamed("rp_unit_id", "place_unit_id")
              .withColumn("full_address", full_address("building_name", "unit_number", "room_number")))


def resident_places(t: dict[str, DataFrame]) -> DataFrame:
    """p_resident_id → resident_name, resident_phone, full_address (one row per placed resident)."""
    res = t["residents"].select(F.col("resident_id").alias("p_resident_id"), F.col("room_id").alias("p_room_id"),
                                F.col("name").alias("resident_name"), F.col("phone").alias("resident_phone"))
    return attach_room_place(t, res, "p_room_id").select("p_resident_id", "resident_name", "resident_phone",
                                                          "full_address")
