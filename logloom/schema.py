"""The entry schema: what every source yields and every operator reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("message_raw", T.StringType()),
        T.StructField("pid", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("line", T.LongType()),
    ]
)

ENTRY_COLUMNS = ENTRY.fieldNames()



_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
_MICROSECOND = "INTERVAL '0 00:00:00.000001' DAY TO SECOND"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp.

    Built from its fields, so it never shifts with the session time zone.
    """
    second = F.date_part(F.lit("SECOND"), ts)
    return (
        F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000
        + F.hour(ts).cast("long") * 3_600_000_000
        + F.minute(ts).cast("long") * 60_000_000
        + (second * 1_000_000).cast("long")
    )


def from_micros(us: Column) -> Column:
    """Inverse of :func:`micros`."""
    return F.expr(_EPOCH) + F.expr(_MICROSECOND) * us


def as_entries(df: DataFrame) -> DataFrame:
    """Entry columns in order and type; extra columns follow."""
    extra = [c for c in df.columns if c not in ENTRY_COLUMNS]
    fixed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTRY.fields]
    return df.select(*fixed, *extra)
