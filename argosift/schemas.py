"""Declared schemas of the tables and payloads."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

EVENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
SUBMISSION = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("source", T.StringType()), T.StructField("event_type", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("host_id", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("raw_data", _TEXT_MAP),
    T.StructField("normalized_data", _TEXT_MAP), T.StructField("tags", T.ArrayType(T.StringType())),
])
ANSWER = T.StructType([
    T.StructField("classification", T.StringType()), T.StructField("threat_level", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("explanation", T.StringType()), T.StructField("reasoning", T.StringType()),
])
