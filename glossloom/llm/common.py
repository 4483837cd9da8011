"""What several operators share: stored tables, checked broadcasts, table access."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import glossloom
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.session import work_path

#: Rows up to which a table with narrow rows (a key and a few numbers) may be broadcast.
SMALL_ROWS = 50_000

#: A word: a run of characters other than blanks and the five ASCII line and tab characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they start: a zip of it, kept in the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(glossloom.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    path = work_path(spark, "code") + ".zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path)


def broadcast(spark: SparkSession, value):
    """value for the Python functions of all workers, together with this package."""
    ship(spark)
    return spark.sparkContext.broadcast(value)


def stored(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it has few rows; Spark's own choice otherwise.

    Meant for stored tables with narrow rows, so that the count reads footers only.
    """
    return F.broadcast(df) if df.count() <= rows else df


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(col: str, modulo: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulo) == F.lit(remainder)
