"""Pages at any depth: tables clustered by their order, with a place for each file.

A clustered table lies in files of disjoint ranges of its order, at most ROWS
rows each; `places` tells each file's rows and how many come before it, for each
group (a collection, or all). A page reads the files that hold its rows, however
many it skips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a file at most: what a page sorts at a time.
ROWS = 100_000
#: Rows that a task sorts on the way to files, about.
SORTED = 500_000
_PLACES = "file string, grp string, before long, rows long"


def _order(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]


def write_clustered(df: DataFrame, path: str, order: list[tuple[str, bool]], group: str | None = None, files: int | None = None) -> None:
    """df as a clustered table in a new folder: path/rows and path/places. order: columns, and whether they rise; it must be total for pages to be stable. Without a number of files, as many tasks as rows ask for, 8 at least."""
    spark = df.sparkSession
    files = files or max(8, -(-df.count() // SORTED))
    by = ([F.col(group).asc_nulls_first()] if group else []) + _order(order)
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.option("maxRecordsPerFile", ROWS).parquet(f"{path}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows")
    name = F.col(group).cast("string") if group else F.lit("")
    first = F.struct(*(_rising(F.col(c), up, rows.schema[c].dataType.typeName()).alias(c) for c, up in order)).alias("first")
    placed = rows.select(F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("at"), name.alias("grp"), first)
    # the first row of a file's group is its lowest; numbers are aggregated without a sort of all rows
    sizes = placed.groupBy("file", "grp").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("rows"))
    found = placed.select("file", "at", "first").join(F.broadcast(sizes), ["file", "at"])
    before = Window.partitionBy("grp").orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    found.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("file", "grp", "before", "rows").coalesce(1).write.parquet(f"{path}/places")


def _rising(x: Column, up: bool, kind: str) -> Column:
    """A value that rises in the order of the column. Columns that fall are numbers or times."""
    if up:
        return x
    return -F.unix_micros(x.cast("timestamp")) if kind.startswith("timestamp") else -x


def page_files(spark: SparkSession, path: str, limit: int, skip: int, group: str | None = None) -> tuple[list[str], int]:
    """The files that hold the page's rows, and how many rows of the group come before them."""
    places = spark.read.schema(_PLACES).parquet(f"{path}/places").where(F.col("grp") == (group or ""))
    rows = places.where((F.col("before") < skip + limit) & (F.col("before") + F.col("rows") > skip)).orderBy("before").collect()
    return [r["file"] for r in rows], rows[0]["before"] if rows else 0


def deep_page(spark: SparkSession, path: str, shape, order: list[tuple[str, bool]], limit: int, skip: int, group: tuple[str, str] | None = None) -> DataFrame:
    """Rows in order, `limit` after `skip`; group: a column and its value, of which the page is."""
    files, before = page_files(spark, path, limit, skip, group[1] if group else None)
    if not files:
        return spark.createDataFrame([], shape)
    rows = spark.read.schema(shape).parquet(*files)
    rows = rows.where(F.col(group[0]) == group[1]) if group else rows
    return rows.orderBy(*_order(order)).offset(skip - before).limit(limit)
