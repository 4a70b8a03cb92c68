"""Table shapes."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

PARTS = T.StructType([
    T.StructField("p_partkey", T.LongType()),
    T.StructField("p_name", T.StringType()),
    T.StructField("p_brand", T.StringType()),
    T.StructField("p_type", T.StringType()),
    T.StructField("p_size", T.IntegerType()),
    T.StructField("p_retailprice", T.DoubleType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

# What the JSON-LD walk looks at; everything else in the script is skipped unread.
JSONLD = (
    "`@graph` array<struct<`@type`: string, offers: array<struct<"
    "priceSpecification: array<struct<price: string>>>>>>"
)


def hits(value: str, area: bool = False) -> T.ArrayType:
    """Hits of one field on one page, sorted by selector rank and document order."""
    fields = [T.StructField("rank", T.IntegerType()), T.StructField("ord", T.IntegerType())]
    if area:
        fields.append(T.StructField("in_area", T.BooleanType()))
    fields.append(T.StructField(value, T.StringType()))
    return T.ArrayType(T.StructType(fields))
