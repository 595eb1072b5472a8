"""What the operators of this subpackage share: tables, durable cuts of lineage, folds, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a document's words are made of: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bound the Arrow batches by rows and by bytes, as some texts are very long. This holds for the session from here on, as
    plans are run later than they are made; it changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only for a local master without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linkspark-"))
    return context.getCheckpointDir()


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that no later stage depends on what an executor holds."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete the table of ``written`` once nothing reads it any more."""
    path = getattr(df, "_written_to", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Let the driver find that the shuffles behind written tables are used no more: Spark then deletes their files, which
    else would wait for the next full collection of its heap."""
    spark._jvm.java.lang.System.gc()


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def hash_limit(n: int, bound: int) -> int:
    """The signed 64-bit number that about ``bound`` of ``n`` uniform 64-bit hashes do not exceed."""
    return -(1 << 63) + min((1 << 64) - 1, (bound << 64) // max(n, 1))


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """The ``bound`` rows of ``df`` with the least 64-bit hashes of ``key``, all of them if there are no more.

    Which rows these are depends on the rows alone, not on how they are dealt: ties go by all columns. A limit on the hash
    leaves about twice as many to be ordered, however many there are; where a key that repeats leaves fewer, the sample is
    smaller.
    """
    n = df.count()
    if n <= bound:
        return df
    h = fresh(df, "sample_hash")
    near = df.withColumn(h, F.xxhash64(key, F.lit("sample"))).where(F.col(h) <= hash_limit(n, 2 * bound + 100))
    return near.orderBy(h, *[c for c in df.columns if c != h]).limit(bound).drop(h)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``df`` has a column of that name in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def appended(docs: DataFrame, name: str, kind: T.DataType, compute: Callable[[list], pa.Array], column: str = "text") -> DataFrame:
    """``docs`` with a column computed from the list of values of ``column``, one Arrow batch at a time."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, compute(batch.column(at).to_pylist())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


#: A key with over one in HOT of the rows, and more than LEAST of them, is hot: there are fewer than HOT such keys, and the
#: rows of each are dealt over SALTS tasks.
HOT, LEAST, SALTS = 2000, 1000, 64


def salted_join(rows: DataFrame, other: DataFrame, key: str, counts: DataFrame, how: str = "inner", salt: Column | None = None) -> DataFrame:
    """``rows`` joined with ``other``, which has a row per ``key`` at most, without all rows of a hot key in one task.

    ``counts`` (``key``, n): how many rows each key has. ``salt``: any number that differs among the rows of a key; by
    default a hash of the row.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(total // HOT, LEAST)).select(key, F.lit(True).alias("hot"))
    if hot.isEmpty():
        return rows.join(other, key, how)
    hot, part = F.broadcast(hot), F.pmod(F.xxhash64(*rows.columns) if salt is None else salt, F.lit(SALTS)).cast("int")
    many = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = other.join(hot, key, "left").withColumn("salt", F.explode(many)).drop("hot")
    dealt = rows.withColumn("salt", part).join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), F.col("salt")).otherwise(F.lit(0))).drop("hot")
    return dealt.join(copied, [key, "salt"], how).drop("salt")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bound: int) -> DataFrame:
    """text, label of at most ``bound`` documents that are not held out, drawn by a hash of the id.

    A doc_id counts once: with its largest label, and its least text where rows repeat it.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    ids = bounded_sample(known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), F.col("doc_id"), bound)
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")
