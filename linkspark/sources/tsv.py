"""Readers and writers of record and link files, and the checks of what is handed in."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.functions.hashing import is_validation

# The columns of the files.
RECORD = ["entity_id", "business_name", "business_address", "country"]
TRUTH, CANDIDATES, MATCHES = (["source1_entity_id", c] for c in ("matched_entity_ids", "candidate_entity_ids", "matched_entity_ids"))
_TSV = {"sep": "\t", "quote": "", "escape": "", "header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8"}


def _schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _checked_lines(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines as fields; a wrong header or number of fields fails the query that meets it."""
    lines = spark.read.text(path).withColumn("f", F.split("value", "\t", -1))
    header = "\t".join(names)
    first = spark.read.text(path).limit(1).collect()
    if not first or first[0][0].rstrip("\r") != header:
        raise ValueError(f"{path}: the header must be {names}")
    ok = F.when(F.size("f") == len(names), F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"{path}: a line without {len(names)} fields: "), F.substring("value", 1, 80))).cast("array<string>"))
    return lines.where(F.col("value") != header).select(ok.alias("f")).select(*[F.col("f")[i].alias(n) for i, n in enumerate(names)])


def read_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A record file. Strictly, header and every line are checked; leniently, missing fields are empty."""
    if strict:
        return _checked_lines(spark, path, RECORD)
    return spark.read.schema(_schema(RECORD)).options(**_TSV, enforceSchema="true", mode="PERMISSIVE").csv(path).select(*[F.coalesce(c, F.lit("")).alias(c) for c in RECORD])


def read_links(spark: SparkSession, path: str, column: str = "matched_entity_ids") -> tuple[DataFrame, DataFrame]:
    """Entities with a row (source1_id), and their links (source1_id, target_id). A repeated row fails."""
    rows = _checked_lines(spark, path, ["source1_entity_id", column])
    once = rows.groupBy("source1_entity_id").agg(F.count("*").alias("n"), F.first(column).alias("ids"))
    sure = F.when(F.col("n") == 1, F.col("source1_entity_id")).otherwise(F.raise_error(F.concat(F.lit(f"{path}: duplicate row for "), F.col("source1_entity_id"))))
    rows = once.select(sure.alias("source1_id"), "ids")
    return rows.select("source1_id"), exploded(rows)


def exploded(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """(source1_id, comma-joined ids) as pairs."""
    return rows.select("source1_id", F.explode(F.array_distinct(F.filter(F.split(ids, ","), lambda x: x != ""))).alias("target_id"))


def wanted(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is among ``ids``."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def write_tsv(df: DataFrame, path: str) -> None:
    """One folder of tab-separated parts with a header each; fields must hold neither tab nor line break."""
    df.write.mode("overwrite").options(sep="\t", quote="", escape="", header="true", emptyValue="", nullValue="", quoteAll="false", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def split_truth(rows: DataFrame, path: str) -> None:
    """Truth rows as two link files, validation and the rest, by the hash of the entity."""
    marked = rows.withColumn("part", F.when(is_validation(F.col("source1_entity_id")), "validation").otherwise("train"))
    for part in ("train", "validation"):
        write_tsv(marked.where(F.col("part") == part).drop("part"), f"{path}/{part}")


def write_record_store(records: DataFrame, table: str, buckets: int = 64) -> None:
    """Records as a table bucketed by id, so that joins by id need no shuffle of it. Repeated ids fail."""
    repeated = records.groupBy("entity_id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"repeated id: {repeated[0][0]}")
    records.write.mode("overwrite").bucketBy(buckets, "entity_id").sortBy("entity_id").saveAsTable(table)


def inventory(spark: SparkSession, path: str, glob: str = "*.tsv") -> DataFrame:
    """file, megabytes, rows (without the header), header of each text file."""
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.round(F.col("length") / 1e6, 3).alias("megabytes"))
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("at"))
    counts = lines.groupBy("file").agg((F.count("*") - 1).alias("rows"), F.min_by("value", "at").alias("header"))
    return sizes.join(counts, "file", "left")


def validate(entities: DataFrame, targets: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """rule, violations of what is handed in: candidates and matches are (source1_entity_id, ids) rows."""
    rows = {"candidates": candidates.toDF("source1_id", "ids"), "matches": matches.toDF("source1_id", "ids")}
    pairs = {k: v.select("source1_id", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("target_id")) for k, v in rows.items()}
    every = entities.select(F.col("entity_id").alias("source1_id"))
    known = targets.select(F.col("entity_id").alias("target_id"))
    checks = {}
    for k, v in rows.items():
        checks[f"{k}: one row for each entity"] = every.join(v.groupBy("source1_id").count(), "source1_id", "full").where("count IS NULL OR count <> 1").unionByName(v.join(every, "source1_id", "left_anti").select("source1_id", F.lit(1).alias("count")), allowMissingColumns=True)
        checks[f"{k}: targets of Source 2 or 3 that exist"] = pairs[k].join(known, "target_id", "left_anti").unionByName(pairs[k].where(~F.substring("target_id", 1, 3).isin("S2-", "S3-")))
        checks[f"{k}: no target twice"] = pairs[k].groupBy("source1_id", "target_id").count().where("count > 1")
    checks["matches are candidates"] = pairs["matches"].join(pairs["candidates"], ["source1_id", "target_id"], "left_anti")
    counted = [df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in checks.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def write_report(report: dict, path: str) -> None:
    """A report as JSON and as a Markdown list, on the driver."""
    Path(path).with_suffix(".json").write_text(json.dumps(report, indent=2, default=str))
    Path(path).with_suffix(".md").write_text("".join(f"- **{k}**: {json.dumps(v, default=str)}\n" for k, v in report.items()))


def package(files: list[str], path: str) -> None:
    """A zip of files that must all be there."""
    if missing := [f for f in files if not Path(f).is_file()]:
        raise FileNotFoundError(", ".join(missing))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, Path(f).name)
