"""Record schemas and frozen code tables."""

from __future__ import annotations

from pyspark.sql import types as T

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("started_at", T.LongType(), False),
        T.StructField("finished_at", T.LongType()),
        T.StructField("input_path", T.StringType(), False),
        T.StructField("mode", T.StringType(), False),
        T.StructField("quant", T.StringType(), False),
        T.StructField("model_version_tag", T.StringType(), False),
        T.StructField("exit_code", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
    ]
)
SCHEMA_VERSION = 1
#: Version of the store's layout; a newer one is refused.
STORE_VERSION = 1

SPAN = T.StructType([T.StructField("full", T.StringType()), T.StructField("label", T.StringType()), T.StructField("boxes", T.ArrayType(T.ArrayType(T.LongType())))])

#: Exit codes and what they stand for.
EXIT_CODES = {0: "ok", 1: "general", 2: "usage", 3: "model", 4: "input", 5: "timeout", 6: "cancelled", 7: "format_mismatch"}
