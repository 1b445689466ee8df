"""Files: CSV at the edge of the engine, JSON documents, inventories of file trees, published tables."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Beginnings of column names that hold the truth and are never published.
FORBIDDEN_PREFIXES = ("truth_", "sealed_")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header under an explicit schema; empty fields and NaN are NULL, malformed rows fail the query."""
    df = spark.read.schema(schema).csv(path, header=True, nanValue="NaN", mode="FAILFAST", enforceSchema=False)
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}) if schema.fields else df


def unsigned_to_signed(column: str | Column) -> Column:
    """A 64-bit token read as DECIMAL(20,0) as the BIGINT with the same bits."""
    c = F.col(column) if isinstance(column, str) else column
    wrap = F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(c >= F.lit("9223372036854775808").cast("decimal(20,0)"), (c - wrap).cast("bigint")).otherwise(c.cast("bigint"))


def signed_to_unsigned(column: str | Column) -> Column:
    c = (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")
    return F.when(c < 0, (c + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(c)


def refuse_columns(df: DataFrame, prefixes: tuple[str, ...] = FORBIDDEN_PREFIXES) -> DataFrame:
    """``df``, unless a column may not be published."""
    if bad := [c for c in df.columns if c.startswith(prefixes)]:
        raise ValueError(f"columns not for publication: {bad}")
    return df


def expect_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, unless its columns are not these in this order."""
    if df.columns != list(columns):
        raise ValueError(f"expected columns {list(columns)}, found {df.columns}")
    return df


def write_csv(df: DataFrame, path: str, decimals: int = 6, single_file: bool = False) -> None:
    """CSV with a header and a fixed number of decimals; NULL is an empty field. One file only for small published tables."""
    df = refuse_columns(df)
    shown = [F.format_string(f"%.{decimals}f", f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields]
    shown = [F.when(F.col(f.name).isNotNull(), s).alias(f.name) for f, s in zip(df.schema.fields, shown, strict=True)]
    (df.select(shown).coalesce(1) if single_file else df.select(shown)).write.mode("overwrite").csv(path, header=True)


def published(df: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """Write a table and read it back, so that what follows is computed from the published values."""
    write_csv(df, path)
    return read_csv(df.sparkSession, path, schema)


def read_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON document as one row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON object per row, keys in order of name."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name, bytes, sha256`` of every file below a folder, by its path from there, empty and hidden ones too.

    The driver lists names and sizes only (Spark's own listing drops empty files); each file is hashed as a stream of blocks within a task, whatever its size.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(root)
    start, found, listed = len(root.toString().rstrip("/")) + 1, [], system.listFiles(root, True)
    while listed.hasNext():
        status = listed.next()
        at = status.getPath()
        if fnmatchcase(at.getName(), pattern):
            found.append((at.toString(), at.toString()[start:], status.getLen()))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from pyarrow import fs

        for batch in batches:
            digests = []
            for at in batch["path"]:
                local = at.startswith("file:")
                system, inner = (fs.LocalFileSystem(), "/" + at.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(at)
                digest = hashlib.sha256()
                with system.open_input_stream(inner, compression=None) as stream:
                    while block := stream.read(1 << 22):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield batch[["name", "bytes"]].assign(sha256=digests)

    files = spark.createDataFrame(found, "path string, name string, bytes bigint").repartition(max(1, len(found)))
    return files.mapInPandas(hashed, "name string, bytes bigint, sha256 string")


def tree_digest(files: DataFrame) -> DataFrame:
    """One digest of a tree from its names and digests in order of name (a tree of published files, some dozens)."""
    each = F.concat_ws(":", "name", "sha256")
    return files.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(each))), 256).alias("digest"))


def split_blocks(df: DataFrame, marker: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a file that lack ``marker`` and those that have it."""
    return df.where(F.col(marker).isNull()), df.where(F.col(marker).isNotNull())


def pseudonym(column: str, salt: str) -> Column:
    """A consistent opaque id."""
    return F.sha2(F.concat_ws(":", F.lit(salt), F.col(column).cast("string")), 256)
