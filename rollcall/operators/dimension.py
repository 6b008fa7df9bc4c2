"""Joining channel names onto results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.columns import channel_label
from rollcall.tables import Presence

def channel_names(channels: DataFrame) -> DataFrame:
    return channels.select("channel_id", F.col("channel_name").alias("_raw_name"))


def channel_side(pr: Presence) -> DataFrame:
    """Name side of the join; the planner and AQE choose the join by measured bytes."""
    return channel_names(pr.channels)


def with_channel_names(df: DataFrame, pr: Presence, label: bool = True) -> DataFrame:
    """Left join names by ``channel_id``; missing or empty names become ``Channel <id>``."""
    names = channel_side(pr)
    joined = df.join(names, "channel_id", "left")
    name = channel_label("channel_id", "_raw_name") if label else F.col("_raw_name")
    return joined.withColumn("channel_name", name).drop("_raw_name")
