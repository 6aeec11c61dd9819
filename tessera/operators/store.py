"""Stored tables that rows can be deleted from: folders by the hash of a key, of which a delete rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a stored table.
BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Each bucket has a row of nulls beside its own, so that a bucket which loses all its rows is still written anew."""
    return rows.withColumn("__mark", F.lit(False)).unionByName(marks.select("bucket", F.lit(True).alias("__mark")), allowMissingColumns=True)


def _put(rows: DataFrame, path: str) -> None:
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_store(rows: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> None:
    """Writes the rows in folders by `key`, which is a document's or a conversation's id: what belongs together lies in one folder."""
    marks = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    _put(_marked(rows.withColumn("bucket", _bucket(key, buckets)), marks), path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("NOT __mark").drop("__mark", "bucket")


def delete_from_store(spark: SparkSession, path: str, gone: DataFrame, key: str, buckets: int = BUCKETS) -> int:
    """Deletes the rows whose key is in gone, and gives the number of folders that were written anew; files of other folders stay as they are.

    Which folders hold such rows is found from the key column alone. The new files of a folder are moved in when all are written, so a delete that fails
    may be run again. Keys that the table doesn't hold, and nulls, delete nothing."""
    gone = gone.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    asked = sorted(r[0] for r in gone.select(_bucket(key, buckets).alias("b")).distinct().collect())  # as many as there are folders
    rows = spark.read.parquet(path).where(F.col("bucket").isin(asked))
    touched = sorted(r[0] for r in rows.where("NOT __mark").select("bucket", key).join(gone, key, "left_semi").select("bucket").distinct().collect())
    if touched:
        _put(rows.where(F.col("bucket").isin(touched)).join(gone, key, "left_anti"), path)
    return len(touched)


def delete_cascade(spark: SparkSession, gone: DataFrame, key: str, parents: str, *children: str) -> None:
    """Deletes from the children's tables first, so that a delete which fails in between leaves no child without its parent."""
    for path in (*children, parents):
        delete_from_store(spark, path, gone, key)
