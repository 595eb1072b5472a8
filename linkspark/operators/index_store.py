"""A TF-IDF index as tables: postings by country and view, the IDF table, and a manifest by which it is used again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators.blocking import Index, country_sizes, idf_table, index_rows, term_counts, weighted

#: Changes whenever features do.
FEATURE_VERSION = 3
#: Stated, as folder names such as country=1 would be read as numbers.
SCHEMAS = {
    "postings": "entity_id string, row int, term long, df long, weight double, country string, view string",
    "idf": "term long, df long, n long, idf double, country string, view string",
    "sizes": "country string, n long",
    "ids": "entity_id string",
}


def manifest(views: list[str], variants: bool, rows: DataFrame) -> dict:
    """What an index was built from: its options, and the number and a checksum of its records."""
    n, digest = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return {"feature_version": FEATURE_VERSION, "views": sorted(views), "variants": variants, "records": n, "checksum": str(digest)}


def stored_manifest(spark: SparkSession, path: str) -> dict | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def build_index(records: DataFrame, path: str, views: list[str], variants: bool = True) -> bool:
    """Write the index of ``records`` to ``path`` unless the one there has the same manifest. Whether it was built."""
    spark, wanted = records.sparkSession, manifest(views, variants, records)
    if stored_manifest(spark, path) == wanted:
        return False
    rows = index_rows(records, variants)
    counts = term_counts(rows, views)
    idf_table(counts, rows).write.mode("overwrite").partitionBy("country", "view").parquet(f"{path}/idf")
    idf = spark.read.parquet(f"{path}/idf")
    weighted(counts, idf).write.mode("overwrite").partitionBy("country", "view").parquet(f"{path}/postings")
    records.select("entity_id").distinct().write.mode("overwrite").parquet(f"{path}/ids")
    country_sizes(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    spark.createDataFrame([(json.dumps(wanted),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")  # last: a broken build has none
    return True


def load_index(spark: SparkSession, path: str) -> Index:
    """The stored index, as ``neighbours``, ``exact_cosines`` and ``pair_features`` take it; a filter on country or view reads
    those folders alone."""
    return Index(*(spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()))


def stored_index(records: DataFrame, path: str, views: list[str], variants: bool = True) -> Index:
    """The index of ``records`` at ``path``, built there only if it is not there yet."""
    build_index(records, path, views, variants)
    return load_index(records.sparkSession, path)
