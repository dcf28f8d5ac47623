"""Parquet trees: hive-partitioned reads, rebuilds, partition replacement, compaction."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
VECTOR_COLUMN = r"^V[0-9]+$"
SHARD_NUMBER = r"-(\d+)\.parquet(?:/[^/]*)?$"
ROWS_PER_FILE = 250_000  # about 1 GB of 768-wide vectors
BYTES_PER_FILE = 1_000_000_000
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a value
# -------------------------------------------------------------------------------------------


def read_tree(spark: SparkSession, path: str, columns: list[str] | None = None, flat: bool = False) -> DataFrame:
    """A Parquet tree; partition values come from the path as text, other files are skipped.

    ``flat`` reads every file below the path and ignores the partition folders.
    """
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    if flat:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: a scan with fewer splits than cores is dealt out over all cores.

    Large inputs have more splits than that and are left alone. ``df`` is a plain scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_file_name(df: DataFrame, name: str = "file_name") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_name"))


def with_row_order(df: DataFrame) -> DataFrame:
    """Columns that fix the stored order of rows: ``file_path, row_index``."""
    return df.withColumns({"file_path": F.col("_metadata.file_path"), "row_index": F.col("_metadata.row_index")})


def shard_number(file_path: Column) -> Column:
    """The number at the end of a shard's name, NULL when it has none; a shard is a file, or a folder of part files."""
    return F.nullif(F.regexp_extract(file_path, SHARD_NUMBER, 1), F.lit("")).try_cast("int")


def vector_columns(columns: list[str]) -> list[str]:
    """``V1..Vn`` in numeric order."""
    wide = [c for c in columns if c[:1] == "V" and c[1:].isdigit()]
    return sorted(wide, key=lambda c: int(c[1:]))


def pack_vectors(df: DataFrame) -> DataFrame:
    """Wide vector columns as one ``embedding`` array."""
    wide = vector_columns(df.columns)
    rest = [c for c in df.columns if c not in wide]
    return df.select(*rest, F.array(*[F.col(c).cast("double") for c in wide]).alias("embedding"))


def unpack_vectors(df: DataFrame, width: int) -> DataFrame:
    """``embedding`` as columns ``V1..Vwidth``; a vector of another length raises, a missing one gives NULLs."""
    rest = [c for c in df.columns if c != "embedding"]
    message = F.concat(F.lit(f"a vector has not {width} components but "), F.size("embedding").cast("string"))
    sized = F.when(F.size("embedding") != width, F.raise_error(message)).otherwise(F.col("embedding"))
    return df.withColumn("embedding", sized).select(*rest, *[F.get("embedding", i).alias(f"V{i + 1}") for i in range(width)])


def partition_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct partition values, sorted."""
    return df.select(*columns).distinct().orderBy(*columns)


def rebuild(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Replace the whole tree. An empty table leaves one file that carries the schema."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    spark = df.sparkSession
    try:
        spark.read.parquet(path)
    except AnalysisException as error:  # no partition, so no file
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        spark.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> str:
    """Replace only the partitions present in ``df``.

    For trees Spark wrote: other writers may escape folder names differently, and both copies would
    then be read.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    return path


def drop_partitions(values: DataFrame, path: str, partition_by: list[str]) -> int:
    """Remove the folders of some partition values, given as one row each; returns how many were there.

    Spark knows the folders: a partition's files name theirs. Values without rows are not touched.
    """
    spark = values.sparkSession
    tree = read_tree(spark, path)
    if not set(partition_by) <= set(tree.columns):
        return 0
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE)).alias(c) for c in partition_by]
    names = values.select(*shown)
    of_file = tree.select(*shown, F.col("_metadata.file_path").alias("f"))
    folder = F.regexp_replace("f", "/[^/]*$", "")
    folders = [r.f for r in of_file.join(names, partition_by, "left_semi").select(folder.alias("f")).distinct().collect()]
    hadoop = spark._jvm.org.apache.hadoop.fs
    for f in folders:
        at = hadoop.Path(spark._jvm.java.net.URI(f))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark.catalog.refreshByPath(path)
    return len(folders)


def packed_shards(spark: SparkSession, source: str, bytes_per_task: int) -> DataFrame:
    """All shards under a path with their ``batch``, dealt to tasks by file size: a task reads about so many bytes."""
    packing = spark.newSession()  # how a scan deals files to tasks is a setting of the session
    for key, value in (("maxPartitionBytes", bytes_per_task), ("openCostInBytes", 1), ("minPartitionNum", 1)):
        packing.conf.set(f"spark.sql.files.{key}", str(value))
    shards = packing.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(source)
    return shards.withColumn("batch", shard_number(F.col("_metadata.file_path")))


def compact(
    spark: SparkSession, source: str, target: str, rows_per_file: int = ROWS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE
) -> int:
    """Rewrite shards as few large files with a ``batch`` column from their names; counts and content are verified.

    No row is shuffled: a task streams the shards dealt to it into one file, or more beyond ``rows_per_file`` rows.
    The committer publishes all files together, so a lost task leaves nothing.
    """
    rows = packed_shards(spark, source, bytes_per_file)
    expected = content_mark(rows)
    if expected[0] == 0:
        raise ValueError(f"no rows under {source}")
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").parquet(target)
    written = content_mark(spark.read.parquet(target))
    if written[0] != expected[0]:
        raise ValueError(f"{target}: {written[0]} rows, expected {expected[0]}")
    if written != expected:
        raise ValueError(f"{target}: as many rows as the shards, but not the same")
    return written[0]


def content_mark(df: DataFrame) -> tuple:
    """Rows and two order-free sums of row hashes: tables of the same rows have the same mark."""
    # null flags tell a missing value from another column's
    values = [F.col(f"`{c}`") for c in sorted(df.columns)]
    nulls = [v.isNull() for v in values]
    hashes = [F.xxhash64(F.lit(seed), *values, *nulls).cast("decimal(38,0)") for seed in (1, 2)]
    return tuple(df.agg(F.count("*"), *map(F.sum, hashes)).first())
