"""Explicit schemas of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

PLACE = T.StructType([
    T.StructField("place_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("needs_review", T.BooleanType(), True),
])

PROFILE = T.StructType([
    T.StructField("type", T.StringType(), False),
    T.StructField("max_speed_kmh", T.DoubleType(), False),
    T.StructField("max_distance_km", T.DoubleType(), False),
    T.StructField("lifetime_min", T.DoubleType(), False),
])

RAW_MESSAGE = T.StructType([
    T.StructField("message_id", T.StringType(), False),
    T.StructField("source_type", T.StringType(), True),
    T.StructField("sender", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("received_at", T.TimestampType(), True),
    T.StructField("event_time", T.TimestampType(), True),
    T.StructField("priority", T.IntegerType(), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("reply_to", T.StringType(), True),
])

#: One chat archive document. ``text`` is a string or an array of strings / objects, hence VARIANT;
#: ``date_unixtime`` may be quoted in exports, hence string.
ARCHIVE = T.StructType([
    T.StructField("name", T.StringType(), True),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType(), True),
        T.StructField("date", T.StringType(), True),
        T.StructField("date_unixtime", T.StringType(), True),
        T.StructField("from", T.StringType(), True),
        T.StructField("reply_to_message_id", T.LongType(), True),
        T.StructField("text", T.VariantType(), True),
    ])), True),
])

#: Input of incident assignment: one located (or all-clear) message.
SIGHTING = T.StructType([
    T.StructField("scope", T.LongType(), False),
    T.StructField("message_id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("category", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("destroyed", T.BooleanType(), True),
    T.StructField("confidence", T.DoubleType(), True),
    T.StructField("places", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ])), True),
])

FORECAST = T.StructType([
    T.StructField("incident_id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("predictor", T.StringType()),
    T.StructField("places", T.ArrayType(T.StringType())),
    T.StructField("window_start", T.TimestampType()),
    T.StructField("window_end", T.TimestampType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("min_lat", T.DoubleType()),
    T.StructField("max_lat", T.DoubleType()),
    T.StructField("min_lon", T.DoubleType()),
    T.StructField("max_lon", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
])
