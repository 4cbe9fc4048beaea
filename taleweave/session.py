"""Session construction and the shared folder used for checkpoints and hand-over tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "taleweave", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session spark-submit made."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by the cluster in ``spark.checkpoint.dir``.

    Where the setting is absent, a folder below the session's warehouse, which is as widely reachable as its tables.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    active = context.getCheckpointDir()
    if configured:
        if active is None:
            context.setCheckpointDir(configured)
        return configured
    if active:
        return active
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{uuid.uuid4().hex}"
    context.setCheckpointDir(folder)
    _delete_at_end(spark, folder)
    return folder


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system drop ``path`` when the session's JVM ends."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(location)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _delete_at_end(spark, path)
    return path


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread by key over the session's number of shuffle partitions.

    For rows whose work is far more than their bytes: adaptive execution merges partitions by bytes, but leaves a number
    that was asked for.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# Most entries of a table that are sent to every task; a bound, whatever the table's size.
COMMON = 1 << 16


def with_entries(rows: DataFrame, table: DataFrame, on: list[str], weight: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with a word table at rest, whose entries have a ``weight`` that is larger for more frequent words.

    The heaviest entries, fewer than ``COMMON``, meet the rows where these lie. Only rows of other words meet theirs in a
    shuffle, and few words make up most of a text. Weights change where a row meets its entry, not the result.
    """
    weighed = table.withColumn("_weight", weight)
    top = weighed.select("_weight").orderBy(F.desc("_weight")).limit(COMMON)
    size, cut = top.agg(F.count(F.lit(1)), F.min("_weight")).first()
    entry = F.struct(*[c for c in table.columns if c not in on]).alias("_entry")
    common = F.coalesce(F.col("_weight") > F.lit(cut), F.lit(False))
    if size < COMMON:
        return rows.join(F.broadcast(table), on, how)
    near = rows.join(F.broadcast(weighed.filter(common).select(*on, entry)), on, "left")
    found = near.filter("_entry is not null").select(*rows.columns, "_entry.*")
    rest = near.filter("_entry is null").select(*rows.columns).join(weighed.filter(~common).drop("_weight"), on, how)
    return found.unionByName(rest)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hand_over(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read to the shared folder and go on from the files.

    Unlike a checkpoint the files have known sizes, so later joins are planned on real numbers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def hand_over_by(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """As :func:`hand_over`, with the rows of a key in one of as many buckets as the session has shuffle partitions.

    For a table that is joined by these keys again and again: it is read where it lies, and only the other side moves.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`hand_over` that no later job reads.

    What was made of them must be at rest itself, so that a lost executor's work is not done again from them.
    """
    for table in tables:
        spark = table.sparkSession
        folder = shared_dir(spark).rstrip("/").rsplit("/", 1)[-1]
        for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if f"/{folder}/" in path:
                location = spark._jvm.org.apache.hadoop.fs.Path(path)
                location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
