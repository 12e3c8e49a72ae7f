"""Session settings that follow the size of the data."""

from __future__ import annotations

MB = 1024 * 1024
# Compressed shuffle bytes a task should get; several times that once in memory.
TASK_BYTES = 256 * MB


# Share of the input that is shuffled once sums were combined in each task.
SHUFFLED_SHARE = 0.05


def settings_for(
    input_bytes: int, cores: int, shuffled_bytes: int | None = None
) -> dict[str, str]:
    """Spark SQL settings for reading ``input_bytes`` on ``cores`` task slots.

    Shuffles get enough partitions for ``shuffled_bytes`` (a share of the input when
    not given), not for the input: map tasks times partitions is what driver and
    shuffle service must keep track of.  Adaptive execution merges what turns out
    small and splits skewed joins and rebalanced writes.  All of these can be set on
    a running session.
    """
    if shuffled_bytes is None:
        shuffled_bytes = int(input_bytes * SHUFFLED_SHARE)
    partitions = max(2 * cores, -(-shuffled_bytes // TASK_BYTES))
    # Small inputs are cut finer, so that every core has a split to read.
    split = min(TASK_BYTES, max(4 * MB, input_bytes // (2 * cores)))
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(TASK_BYTES),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(min(TASK_BYTES, split)),
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(partitions),
        # INT96, the default, has no statistics that a scan could skip by.
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    }
