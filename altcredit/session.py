"""Session settings the jobs profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME = {
    # HotSpot does not compile methods above 8000 bytes of bytecode. The wide ratio projections
    # exceed that when fused into one method; this limit makes Spark split them instead
    # (measured: four times the rows per second when scoring).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Applies the settings that have not been set on the session."""
    for name, value in RUNTIME.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark
