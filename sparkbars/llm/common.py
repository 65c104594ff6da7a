"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, shared_dir

#: Words of the mixing and near-duplicate contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: White space of that pattern, for translate().
SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of WORD matches (null: 0), without building the list of words."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), SPACE, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that later jobs and lost
    executors read it there instead of computing it again."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a folder of the shared store, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """``needed`` and one struct ``_rest`` of all other columns, whose names then
    clash with none that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed] or [F.lit(1).alias("none")]
    return docs.select(*needed, F.struct(*rest).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    """The ``columns`` of the frame that was packed, in their order."""
    return df.select(*[F.col(c if c in needed else f"_rest.`{c}`").alias(c) for c in columns])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
