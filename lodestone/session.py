"""Session settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on; the rest is the cluster's to choose.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def get_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """Gets or makes a session with :data:`SEMANTIC_CONF` and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**SEMANTIC_CONF, "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
