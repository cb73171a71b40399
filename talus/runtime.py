"""Session settings and the few helpers that depend on the running cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A lookup side is broadcast only when a bounded count proves it has at most this many rows.
BROADCAST_ROW_LIMIT = 200_000
# Tasks per split (or per core, if those are more) that rows are dealt over before costly work.
SPREAD_TASKS = 4


def build_session(app_name: str = "talus", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Checkpoints that nothing refers to any more are deleted.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """All timestamps in the library are naive UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder; a cluster without the setting is
    an error, because a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="talus-checkpoint-")
        context.setCheckpointDir(configured)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a written intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def folders(spark: SparkSession, root: str, pattern: str, finished: bool = False) -> list[str]:
    """Names of the folders below `root` that match; with `finished` only those whose writing job ended."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}" + ("/_SUCCESS" if finished else ""))
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [(f.getPath().getParent() if finished else f.getPath()).getName() for f in found]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work folder that is no longer read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and ends the plan an iteration has grown."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """The rows written once as Parquet under the shared folder and read from there: as lasting as a checkpoint, which holds whole rows one
    by one, but smaller, and only the columns that are asked for are read again."""
    names = [c.lower() for c in df.columns]
    kinds = df.schema.simpleString()
    if len(set(names)) < len(names) or "void" in kinds or "interval" in kinds:  # Parquet has no such tables
        return cut_lineage(df)
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan evenly over all tasks before costly per-row work. The number of splits says little: the rows of
    a Parquet row group or of an unsplittable file all come from one split, and the others are empty."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(SPREAD_TASKS * max(df.rdd.getNumPartitions(), wanted))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast when a bounded count shows the side is small; otherwise leave the choice
    (shuffle join, with adaptive skew splitting) to the optimizer."""
    rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def positions(df: DataFrame, order: list, group: list[str] | None = None,
              name: str = "position", keep=cut_lineage) -> DataFrame:
    """1-based rank of every row in a total order, without a one-task window.

    Rows are range-partitioned and sorted by (group, order); the rank is the row's offset inside
    its partition plus the sizes of the partitions before it. The only unpartitioned window runs
    over one row per partition. `order` must be unique inside a group. `keep` stores the ranked rows: `stored` for wide ones.
    """
    group = group or []
    keys = [F.col(g) for g in group] + list(order)
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    # The slot depends on the physical layout, so it is stored before it is used twice.
    ranged = keep(ranged)
    part = F.shiftright(F.col("_slot"), 33)
    local = F.col("_slot") - F.shiftleft(part, 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    offsets = sizes.select(
        "_part",
        F.expr("coalesce(sum(_rows) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")
        .alias("_offset"),
    )
    placed = (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per shuffle partition
        .withColumn(name, F.col("_offset") + local + 1)
        .drop("_part", "_offset", "_slot")
    )
    if not group:
        return placed
    starts = placed.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.min(name).alias("_start"))
    matches = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    condition = matches[0]
    for extra in matches[1:]:
        condition = condition & extra
    return (
        placed.join(broadcast_if_small(starts), condition)
        .withColumn(name, F.col(name) - F.col("_start") + 1)
        .drop("_start", *[f"_g_{g}" for g in group])
    )


def attach_to_groups(rows: DataFrame, per_group: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join per-group values back to the rows of the groups, NULL keys matching NULL keys.

    `per_group` holds one row per key. The null-safe comparison hashes other expressions than the
    aggregation that made `per_group`, so both join inputs get exchanges of their own and adaptive
    execution can split a hot key's rows over many tasks. (A plain equality would reuse the
    aggregate's exchange, which switches skew splitting off.)
    """
    renamed = per_group.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in per_group.columns if c not in keys]
    )
    condition = None
    for k in keys:
        term = rows[k].eqNullSafe(renamed[f"_k_{k}"])
        condition = term if condition is None else condition & term
    return rows.join(renamed, condition, how).drop(*[f"_k_{k}" for k in keys])


def running_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Cumulative sums over a total order without a one-task window.

    `sums` maps a new column to the column it accumulates (the row itself included). Rows are
    range-partitioned; every partition is summed on its own and shifted by the partitions before it.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = totals.select(
        "_part",
        *[
            F.expr(f"coalesce(sum(_t_{n}) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias(f"_o_{n}")
            for n in sums
        ],
    )
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"_l_{n}": F.sum(c).over(local) for n, c in sums.items()}).join(F.broadcast(before), "_part")
    return out.withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in sums}).drop(
        "_part", *[f"_l_{n}" for n in sums], *[f"_o_{n}" for n in sums]
    )
