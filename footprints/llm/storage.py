"""Tables in the folder that driver and executors share, and joins whose broadcast depends on a checked size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from footprints.session import shared_folder, ship_package

# Rows of a few integers; 16 MB at most as a broadcast relation's keys.
BROADCAST_ROWS = 500_000


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them back, which cuts the lineage for good."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only if the rows, which must be a few numbers each, are counted and few; otherwise Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


# Texts come to Python in batches of so many rows and bytes at most, one row at least; operators cut them further by bytes.
BATCH_ROWS = 2_000
BATCH_BYTES = 2 << 20
# Python workers outlive their tasks. Left alone, their allocators keep much of the most that a task ever took; so arrays of a megabyte or
# more go back to the system as soon as they are freed. What the session sets itself stays.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepared(spark: SparkSession) -> SparkSession:
    """Makes the package importable in the Python workers, and their batches and memory small enough for a core's share."""
    ship_package(spark)
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_text(docs: DataFrame, text) -> DataFrame:
    """The same columns with another text; n_chars follows where the table has it."""
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def row_key():
    """One number for a document's id and text; rows that agree in both are the same document."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))
