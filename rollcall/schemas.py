"""Table and payload schemas."""

from pyspark.sql import types as T

SNAPSHOTS = T.StructType([
    T.StructField("snapshot_id", T.LongType(), False),
    T.StructField("ts", T.LongType(), False),
    T.StructField("total_clients", T.LongType(), False),
    T.StructField("event_date", T.DateType(), False),
])

CLIENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("snapshot_id", T.LongType(), False),
    T.StructField("ts", T.LongType(), False),
    T.StructField("client_uid", T.StringType(), False),
    T.StructField("client_database_id", T.LongType(), True),
    T.StructField("nickname", T.StringType(), False),
    T.StructField("channel_id", T.LongType(), False),
    T.StructField("idle_ms", T.LongType(), True),
    T.StructField("is_away", T.BooleanType(), False),
    T.StructField("away_message", T.StringType(), True),
    T.StructField("is_talking", T.BooleanType(), False),
    T.StructField("input_muted", T.BooleanType(), False),
    T.StructField("output_muted", T.BooleanType(), False),
    T.StructField("is_recording", T.BooleanType(), False),
    T.StructField("server_groups", T.StringType(), True),
    T.StructField("connected_time", T.LongType(), True),
    T.StructField("event_date", T.DateType(), False),
])

CHANNELS = T.StructType([
    T.StructField("channel_id", T.LongType(), False),
    T.StructField("channel_name", T.StringType(), False),
    T.StructField("parent_channel_id", T.LongType(), True),
    T.StructField("channel_order", T.LongType(), True),
    T.StructField("total_clients", T.LongType(), True),
    T.StructField("last_updated", T.LongType(), False),
])

USER_DAILY = T.StructType([
    T.StructField("client_uid", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("nickname", T.StringType(), True),
    T.StructField("total_samples", T.LongType(), False),
    T.StructField("online_seconds", T.LongType(), False),
    T.StructField("avg_idle_ms", T.DoubleType(), True),
    T.StructField("most_visited_channel_id", T.LongType(), True),
    T.StructField("is_away_count", T.LongType(), False),
    T.StructField("is_talking_count", T.LongType(), False),
    T.StructField("input_muted_count", T.LongType(), False),
    T.StructField("output_muted_count", T.LongType(), False),
    T.StructField("is_recording_count", T.LongType(), False),
])

# Raw poll payloads: every scalar is read as text and cast on use, because the
# voice server sends numbers both as JSON numbers and as strings.
_S = T.StringType()

CLIENT_RECORD = T.StructType([T.StructField(name, _S, True) for name in (
    "clid", "cid", "client_database_id", "client_nickname",
    "client_unique_identifier", "client_idle_time", "client_type",
    "client_away", "client_away_message", "client_is_talker",
    "client_input_muted", "client_output_muted", "client_is_recording",
    "client_servergroups", "connection_connected_time",
)])

CHANNEL_RECORD = T.StructType([T.StructField(name, _S, True) for name in (
    "cid", "pid", "channel_name", "channel_order", "total_clients",
    "channel_maxclients", "channel_codec", "channel_flag_permanent",
)])

STATUS = T.StructType([
    T.StructField("code", _S, True),
    T.StructField("message", _S, True),
])


def payload_schema(record: T.StructType) -> T.StructType:
    """Envelope ``{status: {code, message}, body: [record, ...]}``."""
    return T.StructType([
        T.StructField("status", STATUS, True),
        T.StructField("body", T.ArrayType(record, True), True),
    ])
