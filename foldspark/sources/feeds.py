"""Change feeds and logs as batch or streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_changes(spark: SparkSession, source: str | dict[str, str], schema: StructType | str | None = None, per_batch: int = 1, fmt: str = "parquet") -> DataFrame:
    """A stream of records from the oldest one on.

    `source` is a folder of Parquet or JSON files (per_batch files a micro-batch), or a dict of Kafka options, read from
    the earliest offset unless it says otherwise and decoded by the schema if there is one. An outage is a delay: the
    checkpoint says where to go on.
    """
    if isinstance(source, dict):
        records = spark.readStream.format("kafka").options(**{"startingOffsets": "earliest"} | source).load()
        return records if schema is None else decode_records(records, schema)
    reader = spark.readStream.format(fmt).option("maxFilesPerTrigger", per_batch)
    return reader.schema(schema if schema is not None else spark.read.format(fmt).load(source).schema).load(source)


def decode_records(records: DataFrame, schema: StructType | str) -> DataFrame:
    """The JSON values of (key, value, topic, partition, offset, timestamp) broker records as columns, and `_bad`.

    _bad is the text of a value that doesn't fit the schema, else null; such a row's columns are null.
    """
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    text = F.col("value").cast("string")
    parsed = F.from_json(text, f"{ddl}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return records.select(parsed.alias("_e")).select("_e.*")


def encode_records(rows: DataFrame, key: str) -> DataFrame:
    """(key, value) broker records: the row as JSON, keyed so that one key's records keep their order."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def late_subscription(spark: SparkSession, options: dict[str, str], schema: StructType | str | None = None) -> DataFrame:
    """A Kafka stream that sees only what comes after it starts."""
    return read_changes(spark, {"startingOffsets": "latest"} | options, schema)
