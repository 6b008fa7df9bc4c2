"""Tables kept in the relational layout of a poller's SQL store.

That layout stores a poll as ``snapshots(id, timestamp, total_clients, ...)``
and its clients as ``client_snapshots(snapshot_id, ..., flags as 0/1)``, plus
``channels``.  :func:`presence_from_sql_tables` turns exported (or
JDBC-read) tables into :class:`Presence`: the poll time is denormalized onto
the client rows by an inner join (client rows whose poll is gone are dropped,
as every question over that store does), flags become booleans, and rows of
the first layout get the defaults of the later columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.functions.time import utc_date
from rollcall.sources.conform import V2_DEFAULTS
from rollcall.tables import DEFAULT_POLL_INTERVAL_S, Presence

_FLAGS = ("is_away", "is_talking", "input_muted", "output_muted", "is_recording")


def presence_from_sql_tables(snapshots: DataFrame, client_snapshots: DataFrame, channels: DataFrame,
                             poll_interval_s: int = DEFAULT_POLL_INTERVAL_S) -> Presence:
    sn = snapshots.select(F.col("id").cast("long").alias("snapshot_id"),
                          F.col("timestamp").cast("long").alias("ts"),
                          F.col("total_clients").cast("long").alias("total_clients"))
    sn = sn.withColumn("event_date", utc_date("ts"))
    cs = client_snapshots.join(sn.select("snapshot_id", "ts").withColumnRenamed("snapshot_id", "_sid"),
                               F.col("snapshot_id").cast("long") == F.col("_sid"), "inner")
    cols = []
    for field in schemas.CLIENTS.fields:
        name = field.name
        if name == "event_date":
            cols.append(utc_date("ts").alias(name))
        elif name == "ts":
            cols.append(F.col("ts").cast("long").alias(name))
        elif name in _FLAGS:
            raw = F.col(name).cast("long") == 1 if name in client_snapshots.columns else F.lit(None)
            cols.append(F.coalesce(raw, F.lit(False)).alias(name))
        elif name in client_snapshots.columns:
            cols.append(F.col(name).cast(field.dataType).alias(name))
        else:
            cols.append(F.lit(V2_DEFAULTS.get(name)).cast(field.dataType).alias(name))
    ch = channels.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.CHANNELS.fields])
    return Presence(sn, cs.select(*cols), ch, poll_interval_s)


def read_sql_store(spark: SparkSession, url: str, properties: dict[str, str] | None = None,
                   poll_interval_s: int = DEFAULT_POLL_INTERVAL_S,
                   partitions: int = 64) -> Presence:
    """Read the three tables over JDBC (the driver jar must be on the classpath).

    Polls and clients are read in ``partitions`` parallel ranges of their ``id``.
    """
    props = dict(properties or {})

    def ranges(table: str) -> DataFrame:
        row = spark.read.jdbc(url, f"(SELECT min(id) AS lo, max(id) AS hi FROM {table}) b", properties=props).first()
        lo, hi = int(row["lo"] or 0), int(row["hi"] or 0)
        return spark.read.jdbc(url, table, column="id", lowerBound=lo, upperBound=hi + 1, numPartitions=partitions,
                               properties=props)

    clients, snaps = ranges("client_snapshots"), ranges("snapshots")
    chans = spark.read.jdbc(url, "channels", properties=props)
    return presence_from_sql_tables(snaps, clients, chans, poll_interval_s)
