"""What the operators of this subpackage share: reading tables, cutting lineage, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words: runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves on one machine; on a cluster that would be a
    folder of its own on each executor, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="narrata-shared-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate results that nothing reads any more, on whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """The column of just this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows, found without counting the rest."""
    return df.limit(most_rows + 1).count() <= most_rows


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its row count is proven small, else as it is (a shuffle join then)."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None, most_bytes: int | None = None
) -> DataFrame:
    """At most ``most`` distinct labelled texts ``(doc_id, text, label)``, of ``most_bytes`` together: those whose hashes are least.

    Hashes of texts decide, so neither ids nor copies of a text do. Only ids and hashes are joined and
    compared; texts are then picked by a broadcast of the ``most`` chosen ids. Rows with a null id,
    text or label are left out; of equal texts the least id and the greatest label count.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), F.octet_length(text_col).cast("long").alias("size"))
    rows = rows.where("text is not null")
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max(label_col).cast("double").alias("label"))
    if where is not None:
        rows = rows.where(where)
    met = rows.select("doc_id", "text_hash", "size").join(known, F.col("doc_id") == F.col("l_id"))
    chosen = met.groupBy("text_hash").agg(F.min("doc_id").alias("c_id"), F.max("label").alias("label"), F.max("size").alias("c_size")).orderBy("text_hash").limit(most)
    if most_bytes is not None:  # a window over ``most`` rows at most
        before = F.sum("c_size").over(Window.orderBy("text_hash").rowsBetween(Window.unboundedPreceding, 0))
        chosen = chosen.withColumn("c_total", before).where(F.col("c_total") <= most_bytes).drop("c_total")
    chosen = chosen.drop("c_size")
    picked = rows.join(F.broadcast(chosen.withColumnRenamed("text_hash", "c_hash")), (F.col("doc_id") == F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")))
    return picked.select("doc_id", "text", "label").dropDuplicates(["doc_id"])
