"""Sinks for foreachBatch that a replayed micro-batch cannot change twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.sources.feeds import encode_records


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete folders `<prefix><number>` under a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    done = [n for n in names if n.startswith(prefix) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix(prefix)) for n in done)


def append_idempotent(batch: DataFrame, batch_id: int, path: str) -> None:
    """Append a micro-batch as a folder of its own, which a replay of the batch replaces."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def publish_records(rows: DataFrame, options: dict[str, str], key: str) -> None:
    """Send a micro-batch to Kafka (options name the servers and the topic); a replay sends it again under the same keys."""
    encode_records(rows, key).write.format("kafka").options(**options).save()


def read_appended(spark: SparkSession, path: str, upto: int | None = None, last: int | None | bool = False) -> DataFrame | None:
    """All complete micro-batches under a path, or those up to a number; None if there are none.

    With `last` only the newest one: of those up to that number, or of all if it is None.
    """
    upto = upto if last is False else last
    found = [b for b in _folders(spark, path, "batch_id=") if upto is None or b <= upto]
    found = found if last is False else found[-1:]
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch_id={b}" for b in found)) if found else None


def drop_appended(spark: SparkSession, path: str, below: int) -> None:
    """Delete the micro-batches below a number."""
    for b in _folders(spark, path, "batch_id="):
        if b < below:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={b}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)


#: Buckets of a projection's log and view. A micro-batch reads and writes those of its keys only.
BUCKETS = 64


def with_bucket(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Add `bucket`, which follows from the keys alone."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def by_keys(rows: DataFrame, others: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join on the keys, in which null equals null."""
    right = others.select(*(F.col(k).alias(f"_{k}") for k in keys))
    return rows.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)


def _write_parts(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that the rows are in, and no others; each bucket is written by one task."""
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_bucketed(batch: DataFrame, batch_id: int, path: str) -> None:
    """Append a micro-batch with column `bucket` as bucket=<k>/batch_id=<n>; a replay of the batch replaces it."""
    _write_parts(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), path, ["bucket", "batch_id"])


def read_buckets(spark: SparkSession, path: str, buckets: list[int], upto: int) -> DataFrame:
    """The rows of some buckets of a log, up to a micro-batch; other buckets aren't even listed."""
    rows = spark.read.option("basePath", path).parquet(*(f"{path}/bucket={k}" for k in buckets))
    return rows.where(F.col("batch_id") <= upto).drop("batch_id")


def _versions(spark: SparkSession, path: str, upto: int | None = None) -> dict[int, list[int]]:
    """Versions of each bucket of a view, ascending."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*/version=*")
    found: dict[int, list[int]] = {}
    for f in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        bucket, version = (int(part.split("=")[1]) for part in f.getPath().toString().rsplit("/", 2)[1:])
        if upto is None or version < upto:
            found.setdefault(bucket, []).append(version)
    return {k: sorted(v) for k, v in found.items()}


def _read_versions(spark: SparkSession, path: str, newest: dict[int, int]) -> DataFrame:
    folders = [f"{path}/bucket={k}/version={v}" for k, v in sorted(newest.items())]
    return spark.read.option("basePath", path).parquet(*folders).drop("bucket", "version")


def upsert_view(rows: DataFrame, batch_id: int, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write version `batch_id` of the buckets of a view that the rows are in: the version before, with the rows' keys replaced.

    A replay starts from the same earlier versions and writes the same folders, so it changes nothing. Of each bucket that
    was written, the version before this one stays for readers and replays, and older ones are deleted. At most `buckets`
    numbers come to the driver.
    """
    spark = rows.sparkSession
    fresh = with_bucket(rows, keys, buckets).persist()
    try:
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
        before = {k: v for k, v in _versions(spark, path, batch_id).items() if k in touched}
        whole = fresh
        if before:
            old = _read_versions(spark, path, {k: v[-1] for k, v in before.items()})
            whole = with_bucket(by_keys(old, fresh, keys, "left_anti"), keys, buckets).unionByName(fresh)
        if touched:
            _write_parts(whole.withColumn("version", F.lit(batch_id).cast("long")), path, ["bucket", "version"])
    finally:
        fresh.unpersist()
    for k, versions in before.items():
        for v in versions[:-1]:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={k}/version={v}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)


def read_view(spark: SparkSession, path: str) -> DataFrame:
    """A view: the newest version of each bucket."""
    return _read_versions(spark, path, {k: v[-1] for k, v in _versions(spark, path).items()})
