"""Presence analytics on Spark.

Sampled presence data (periodic snapshots of who is online, in which channel and
in which state) turned into online time, load curves, channel popularity,
sessions, growth, engagement scores and daily rollups.  Every operator is a
plain function over DataFrames; nothing is computed on the driver.
"""

from rollcall.tables import Presence, TimeRange

__all__ = ["Presence", "TimeRange"]
