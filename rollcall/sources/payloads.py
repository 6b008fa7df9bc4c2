"""Raw poll payloads (JSON client and channel lists) into presence tables.

A payload is one JSON document per poll with the poll time ``poll_ts``:
``{status: {code, message}, body: [record, ...]}``.  A non-zero status code
rejects the document; a document without ``status`` is accepted as is, and
a bare list of records is taken as the body.
Every scalar is read as text and cast on use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.functions.columns import flag_value
from rollcall.functions.time import utc_date

# Row ids: poll time in the high bits, position in the poll's client list below.
POSITION_BITS = 31
LATEST_POLL_TS = (1 << 32) - 1     # later times (milliseconds, say) are rejected

# Stored defaults for fields missing from a poll record.
DEFAULT_UID = "unknown"
DEFAULT_NICKNAME = "Unknown"
DEFAULT_CHANNEL_NAME = "Unknown Channel"


def poll_time(text: Column) -> Column:
    """Poll time text to whole seconds (fractions are floored, garbage is NULL, never an error)."""
    t = F.trim(text)
    return F.coalesce(t.try_cast("long"), F.floor(t.try_cast("double")).cast("long"))


def read_payload_text(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"poll_ts": ..., "payload": {...}}`` as ``poll_ts, payload`` text."""
    raw = spark.read.text(path)
    return raw.select(poll_time(F.get_json_object("value", "$.poll_ts")).alias("poll_ts"),
                      F.get_json_object("value", "$.payload").alias("payload"))


def _enveloped(payload: Column) -> Column:
    """A bare JSON list (a response without the status envelope) becomes ``{"body": [...]}``."""
    return F.when(F.ltrim(payload).startswith("["), F.concat(F.lit('{"body": '), payload, F.lit("}"))) \
        .otherwise(payload)


def _parse(payloads: DataFrame, record) -> DataFrame:
    payloads = payloads.withColumn("payload", _enveloped(F.col("payload")))
    parsed = payloads.select("*", F.from_json("payload", schemas.payload_schema(record)).alias("doc"))
    code = F.col("doc.status.code")
    # text that is not a JSON object is rejected like an error status
    is_object = F.json_object_keys("payload").isNotNull()
    return parsed.withColumn("_accepted", F.coalesce(
        is_object & F.col("poll_ts").between(0, LATEST_POLL_TS)
        & (F.col("doc.status").isNull() | (F.trim(code).try_cast("long") == 0)), F.lit(False)))


def rejected_polls(payloads: DataFrame) -> DataFrame:
    """Documents whose status is an error, whose text is not JSON or whose poll time is no time."""
    parsed = _parse(payloads, schemas.CLIENT_RECORD)
    return parsed.filter(~F.col("_accepted")).select(
        "poll_ts", F.col("doc.status.code").alias("code"), F.col("doc.status.message").alias("message"))


def _text_long(c: Column) -> Column:
    """Integer text (or a JSON number such as ``12`` / ``12.0``) to LONG; garbage to NULL."""
    t = F.trim(c)
    return F.coalesce(t.try_cast("long"), t.try_cast("double").cast("long"))


def only_accepted(payloads: DataFrame) -> DataFrame:
    """The accepted documents, text unchanged."""
    parsed = _parse(payloads.withColumn("_text", F.col("payload")), schemas.CLIENT_RECORD).filter("_accepted")
    return parsed.select(*[c for c in payloads.columns if c != "payload"], F.col("_text").alias("payload"))


def accepted_documents(payloads: DataFrame) -> DataFrame:
    """Accepted documents, exact copies collapsed; a rejected document displaces nothing."""
    return only_accepted(payloads).dropDuplicates(["poll_ts", "payload"])


def _is_listed_client(include_query_clients: bool) -> Column:
    """A record is there and is not a service client."""
    listed = F.col("c").isNotNull()
    if not include_query_clients:
        listed = listed & (F.coalesce(F.trim(F.col("c.client_type")), F.lit("0")) == "0")
    return listed


def united_client_rows(docs: DataFrame, include_query_clients: bool = False) -> DataFrame:
    """The client lists of each poll's distinct accepted documents as one list: ``poll_ts, pos, c, kept``.

    Documents of a poll follow each other in text order (of their beginnings, then by digest), so positions (and row
    ids) are unique in the poll and the same on every run.  The prefix sums of their sizes are the documents' first
    positions; neither a window nor a task needs all documents of a poll.  A connection
    (``clid``) that several documents of the poll list under one identity is
    kept once, at its first position; records without ``clid`` are all kept.
    Empty polls give one row without a record.
    """
    # documents are ordered by their text: by its beginning and a digest, so that no window holds whole documents
    parsed = _parse(docs.withColumn("_digest", F.sha2("payload", 256)).withColumn("_begin", F.substring("payload", 1, 256)),
                    schemas.CLIENT_RECORD).filter("_accepted")
    size = F.size(F.coalesce(F.col("doc.body"), F.array())).cast("long")
    earlier = Window.partitionBy("poll_ts").orderBy("_begin", "_digest").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parsed.select("poll_ts", "_begin", "_digest", size.alias("_size"))
               .withColumn("offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).select("poll_ts", "_digest", "offset"))
    placed = parsed.select("poll_ts", "_digest", F.col("doc.body").alias("body")).join(offsets, ["poll_ts", "_digest"])
    rows = (placed.select("poll_ts", "offset", F.posexplode_outer("body").alias("at", "c"))
            .select("poll_ts", (F.col("offset") + F.col("at")).alias("pos"), "c",
                    F.coalesce(_is_listed_client(include_query_clients), F.lit(False)).alias("listed")))
    clid = F.col("c.clid")
    same = Window.partitionBy("poll_ts", "c.client_unique_identifier", clid, "listed",
                              F.when(clid.isNull(), F.col("pos"))).orderBy("pos")
    return rows.withColumn("kept", F.col("listed") & (F.row_number().over(same) == 1)).drop("listed")


def client_list_rows(payloads: DataFrame, include_query_clients: bool = False) -> DataFrame:
    """Accepted documents exploded to one row per client (NULL client for an empty poll).

    For streams, which deduplicate polls within a watermark before.
    """
    parsed = _parse(payloads, schemas.CLIENT_RECORD).filter("_accepted")
    extra = [c for c in payloads.columns if c not in ("poll_ts", "payload")]
    rows = parsed.select("poll_ts", *extra, F.posexplode_outer("doc.body").alias("pos", "c"))
    return rows.filter(F.col("c").isNull() | _is_listed_client(include_query_clients))


def poll_counts(payloads: DataFrame, include_query_clients: bool = False) -> DataFrame:
    """``poll_ts, total_clients`` per accepted document, without exploding it."""
    parsed = _parse(payloads, schemas.CLIENT_RECORD).filter("_accepted")
    body = F.coalesce(F.col("doc.body"), F.array())
    if not include_query_clients:
        body = F.filter(body, lambda c: F.coalesce(F.trim(c["client_type"]), F.lit("0")) == "0")
    extra = [c for c in payloads.columns if c not in ("poll_ts", "payload")]
    return parsed.select("poll_ts", *extra, F.size(body).cast("long").alias("total_clients"))


def clients_from_rows(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Client rows with the stored defaults (uid ``unknown``, nickname ``Unknown`` ...)."""
    c = F.col
    return (rows.filter(c("c").isNotNull()).select(
        ((c("poll_ts") * (1 << POSITION_BITS)) + c("pos")).cast("long").alias("id"),
        c("poll_ts").alias("snapshot_id"),
        c("poll_ts").alias("ts"),
        F.coalesce(c("c.client_unique_identifier"), F.lit(DEFAULT_UID)).alias("client_uid"),
        _text_long(c("c.client_database_id")).alias("client_database_id"),
        F.coalesce(c("c.client_nickname"), F.lit(DEFAULT_NICKNAME)).alias("nickname"),
        F.coalesce(_text_long(c("c.cid")), F.lit(0)).cast("long").alias("channel_id"),
        _text_long(c("c.client_idle_time")).alias("idle_ms"),
        flag_value(c("c.client_away")).alias("is_away"),
        F.coalesce(c("c.client_away_message"), F.lit("")).alias("away_message"),
        flag_value(c("c.client_is_talker")).alias("is_talking"),
        flag_value(c("c.client_input_muted")).alias("input_muted"),
        flag_value(c("c.client_output_muted")).alias("output_muted"),
        flag_value(c("c.client_is_recording")).alias("is_recording"),
        F.coalesce(c("c.client_servergroups"), F.lit("")).alias("server_groups"),
        _text_long(c("c.connection_connected_time")).alias("connected_time"),
        utc_date("poll_ts").alias("event_date"), *keep))


def channel_updates(payloads: DataFrame) -> DataFrame:
    """Channel-list payloads to dimension rows (``last_updated`` = poll time)."""
    parsed = _parse(payloads, schemas.CHANNEL_RECORD).filter("_accepted")
    rows = parsed.select("poll_ts", F.posexplode("doc.body").alias("pos", "c"))
    c = F.col
    return rows.filter(_text_long(c("c.cid")).isNotNull()).select(
        _text_long(c("c.cid")).alias("channel_id"),
        F.coalesce(c("c.channel_name"), F.lit(DEFAULT_CHANNEL_NAME)).alias("channel_name"),
        F.coalesce(_text_long(c("c.pid")), F.lit(0)).cast("long").alias("parent_channel_id"),
        F.coalesce(_text_long(c("c.channel_order")), F.lit(0)).cast("long").alias("channel_order"),
        F.coalesce(_text_long(c("c.total_clients")), F.lit(0)).cast("long").alias("total_clients"),
        c("poll_ts").alias("last_updated"),
        ((c("poll_ts") * (1 << POSITION_BITS)) + c("pos")).cast("long").alias("_seq"))


def ingest_client_payloads(payloads: DataFrame, include_query_clients: bool = False,
                           dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(snapshots, clients)`` from client-list payloads.

    All accepted documents of a poll count, see :func:`united_client_rows`;
    ``total_clients`` is the number of client rows kept.  With ``dedupe`` False
    the caller has one accepted document per poll already, and the poll rows
    are computed without exploding it.
    """
    if dedupe:
        rows = united_client_rows(accepted_documents(payloads), include_query_clients)
        counts = rows.groupBy("poll_ts").agg(F.sum(F.col("kept").cast("long")).alias("total_clients"))
        clients = clients_from_rows(rows.filter("kept"))
    else:
        counts = poll_counts(payloads, include_query_clients)
        clients = clients_from_rows(client_list_rows(payloads, include_query_clients))
    snapshots = counts.select(F.col("poll_ts").alias("snapshot_id"), F.col("poll_ts").alias("ts"),
                              "total_clients", utc_date("poll_ts").alias("event_date"))
    return snapshots, clients
