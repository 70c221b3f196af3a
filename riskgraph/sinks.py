"""Sinks: JSON Lines for nested outputs, CSV with header for the flat queue.

Writes are distributed (one file per partition) into a folder; nothing is
gathered on the driver.  The ``put_`` functions return the number of rows, observed
while they are written (no second read); ``write_`` ones return the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def counted(df: DataFrame, write) -> int:
    """Rows that ``write`` (a function of the observed frame) writes."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return int(seen.get.get("rows") or 0)


def put_json(df: DataFrame, path: str, null_fields: bool = True) -> int:
    """K1-K3: JSON Lines, non-ASCII text kept as is; without ``null_fields`` keys of NULL values are left out."""
    return counted(df, lambda d: d.write.mode("overwrite").option("ignoreNullFields", str(not null_fields).lower()).json(path))


def put_contexts(df: DataFrame, path: str) -> int:
    """K2: evidence fields of other rules are NULL and are left out."""
    return put_json(df, path, null_fields=False)


def put_drafts(drafts: DataFrame, path: str) -> int:
    """K3: draft records; further keys of a model's answer (``extra_json``) stand beside the others, at top level."""
    if "extra_json" not in drafts.columns:
        return put_json(drafts.drop("id"), path)
    own = F.to_json(F.struct(*[F.col(c) for c in drafts.columns if c not in ("id", "extra", "extra_json")]), {"ignoreNullFields": "false"})
    more = F.when(F.length("extra_json") > 2, F.concat(F.lit(","), F.substring("extra_json", 2, 1 << 30))).otherwise(F.lit("}"))
    line = drafts.select(F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.coalesce(more, F.lit("}"))).alias("value"))
    return counted(line, lambda d: d.write.mode("overwrite").text(path))


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Arrays / maps / structs become JSON text so that every column is CSV-safe."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def put_csv(df: DataFrame, path: str) -> int:
    """K4: CSV with header."""
    return counted(flatten_for_csv(df), lambda d: d.write.mode("overwrite").option("header", "true").csv(path))


def write_json(df: DataFrame, path: str, null_fields: bool = True) -> str:
    put_json(df, path, null_fields)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    put_csv(df, path)
    return path
