"""Session settings the operators rely on."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: coalesces small partitions, splits skewed join partitions, turns a
    # sort-merge join into a broadcast join once the small side has been measured.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins whose measured partitions are at most this large hash one side instead of sorting both.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tallyloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; `settings` uses underscores for dots and wins over them.

    Shuffle partitions are left to the cluster: AQE coalesces from its initial number.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    chosen = SETTINGS | {name.replace("_", "."): value for name, value in settings.items()}
    for name, value in chosen.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
