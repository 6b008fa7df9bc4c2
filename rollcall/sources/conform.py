"""Older table layouts conformed to the current one.

The first layout lacked the state columns (away, voice, groups, connection
time); files written with it are read next to current files and get the
defaults the migration gave them: flags false, texts and times NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall import schemas

# Columns added by the second layout and their defaults.
V2_DEFAULTS = {
    "is_away": False,
    "away_message": None,
    "is_talking": False,
    "input_muted": False,
    "output_muted": False,
    "is_recording": False,
    "server_groups": None,
    "connected_time": None,
}


def conform_clients(*frames: DataFrame) -> DataFrame:
    """Union client frames of any layout by name and fill the missing columns."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    cols = []
    for field in schemas.CLIENTS.fields:
        if field.name in merged.columns:
            c = F.col(field.name)
            if field.name in V2_DEFAULTS:
                c = F.coalesce(c.cast(field.dataType), F.lit(V2_DEFAULTS[field.name]).cast(field.dataType))
            cols.append(c.cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(V2_DEFAULTS.get(field.name)).cast(field.dataType).alias(field.name))
    return merged.select(*cols)
