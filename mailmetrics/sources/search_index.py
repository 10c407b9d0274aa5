"""Trigram index over the files of a stored table: a search reads the files that can hold a match.

The reports' search fields match any part of a value, so no sort order or
Parquet statistic prunes them.  ``build_index`` notes which groups of three
lower-case characters each file's values hold; a file without one of the groups
of the search term holds no match.  A value that matches has all of its rows in
the files kept, so reports per address (R13, R15, without numbers) over the
kept files are complete for the addresses searched.

    build_index(spark, table, ["email"], index)
    src = searched(src, "mailing_trace", table, index, "email", term)
    search_view(contact_engagement(src, numbered=False), "contact_engagement", "email", term)

It helps as far as a file's values differ from those of other files: many small
files, or files clustered by the field (the address layout).  The index has a
row for every file and group (at most the table's distinct groups times its
files).  Files written after the index are always read; files that are gone are
not.  Terms shorter than three characters read all.  Null values match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Sources

GRAM = 3


def _path(uri: str) -> str:
    """One form of a file's URI: Spark writes those of local files with one slash or with three."""
    scheme, _, rest = uri.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}"


def _grams(value: Column) -> Column:
    n = F.length(value) - GRAM + 1
    places = F.when(n > 0, F.sequence(F.lit(1), n))
    return F.array_distinct(F.transform(places, lambda i: F.substring(value, i, F.lit(GRAM))))


def build_index(spark: SparkSession, table: str, fields: list[str], index: str, mode: str = "overwrite") -> None:
    """Write the index of ``fields`` of the Parquet folder ``table`` to the folder ``index``.

    Values are made distinct per file and exploded in the scan's task, so what
    is shuffled is a file's distinct groups per task.  A file of nulls or short
    values has a row with an empty group: it is known, and holds nothing.
    """
    file = F.col("_metadata.file_path").alias("file")
    parts = []
    for f in fields:
        value = F.lower(F.col(f).cast("string"))
        gram = F.explode(F.concat(F.array(F.lit("")), F.coalesce(_grams(value), F.array().cast("array<string>"))))
        parts.append(spark.read.parquet(table).select(F.lit(f).alias("field"), gram.alias("gram"), file).distinct())
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows.repartitionByRange("field", "gram").sortWithinPartitions("field", "gram").write.mode(mode).parquet(index)


def candidate_files(spark: SparkSession, table: str, index: str, field: str, term: str) -> list[str]:
    """The files of ``table`` that can hold a value of ``field`` with ``term`` in it (upper and lower case alike).

    The list is a part of the file list that Spark's driver holds for the scan.
    """
    there = spark.read.parquet(table).inputFiles()
    text = term.lower()
    wanted = sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})
    if not wanted:
        return there
    rows = spark.read.parquet(index).where(F.col("field") == field)
    if rows.isEmpty():
        raise KeyError(f"{index} has no field {field}")
    # a file's empty group tells that it is indexed; read by the pushed filter on gram
    per = rows.where(F.col("gram").isin("", *wanted)).groupBy("file").agg(F.count_if(F.col("gram") != "").alias("n"))
    without = {_path(r.file) for r in per.where(F.col("n") < len(wanted)).collect()}
    return [f for f in there if _path(f) not in without]


def searched(src: Sources, name: str, table: str, index: str, field: str, term: str) -> Sources:
    """``src`` with its table ``name`` read from the candidate files only."""
    spark = getattr(src, name).sparkSession
    whole = spark.read.parquet(table)
    files = candidate_files(spark, table, index, field, term)
    if not files:
        return src.replace(**{name: whole.limit(0)})
    return src.replace(**{name: spark.read.schema(whole.schema).option("basePath", table).parquet(*files)})
