"""Contact store on partitioned Parquet: upsert, replace, delete, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import latest


def upserted(current: DataFrame, batch: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Insert-or-replace by key: the batch wins, its last row by `order` if it repeats a key."""
    both = (current.withColumn("_gen", F.lit(0))
            .unionByName(batch.withColumn("_gen", F.lit(1)), allowMissingColumns=True))
    return latest(both, [key], ["_gen", order]).drop("_gen")


def without_survey(table: DataFrame, survey: str | Sequence[str]) -> DataFrame:
    names = [survey] if isinstance(survey, str) else list(survey)
    return table.where(~F.coalesce(F.col("survey").isin(*names), F.lit(False)))


def survey_catalogue(runs: DataFrame) -> DataFrame:
    """Latest registry row per survey, newest first."""
    return latest(runs, ["survey"], ["processed_at", "run"]).orderBy(F.desc("processed_at"), "survey")


def latest_status(log: DataFrame) -> DataFrame:
    """Latest log row per contact: by time, then log order."""
    return latest(log, ["contact_id"], ["reviewed_at", "seq"])


def with_log_state(contacts: DataFrame, log: DataFrame, column: str = "review", default: str = "pending") -> DataFrame:
    """Contacts carrying the state of an append-only log."""
    state = latest_status(log).select(F.col("contact_id").alias("id"), F.col("status").alias("_state"),
                                      F.col("actor").alias(f"{column}_actor"), F.col("reviewed_at").alias(f"{column}_at"))
    base = contacts.drop(column)
    return (base.join(state, "id", "left").withColumn(column, F.coalesce("_state", F.lit(default))).drop("_state"))


def reviewed_with_source(contacts: DataFrame, surveys: DataFrame, log: DataFrame) -> DataFrame:
    """Confirmed and rejected contacts with their registry row and review time."""
    judged = with_log_state(contacts, log).where(F.col("review").isin("confirmed", "rejected"))
    return judged.join(surveys.select("survey", "source_path"), "survey", "left")


def replace_surveys(path: str, contacts: DataFrame) -> None:
    """Idempotent reprocessing: only the partitions of the surveys in `contacts` are rewritten."""
    (contacts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("survey").parquet(path))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """The survey-partitioned table with `survey` as text: a survey named 007 is not the number 7."""
    found = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "survey" else f.dataType) for f in found])
    return spark.read.schema(schema).parquet(path)


def upsert_contacts(path: str, batch: DataFrame) -> None:
    """Upsert into a survey-partitioned table, rewriting only the partitions the batch touches.

    Touched are the surveys of the batch and those that hold one of its ids now:
    an id that moves leaves its old survey.  The new version is written beside
    the table first, so a lost executor never leaves a half-written partition as
    the only copy.
    """
    from ..session import cut_lineage
    spark = batch.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    if not exists:
        replace_surveys(path, latest(batch, ["id"], ["seq"]))
        return
    table = read_contacts(spark, path)
    held = table.join(batch.select("id").distinct(), "id", "left_semi").select("survey")
    surveys = cut_lineage(batch.select(F.col("survey").cast("string").alias("survey")).union(held).distinct())
    current = table.join(surveys, "survey", "left_semi")
    merged = cut_lineage(upserted(current, batch).select(*current.columns))
    replace_surveys(path, merged)
    for row in surveys.join(merged.select("survey").distinct(), "survey", "left_anti").toLocalIterator():
        delete_survey(path, row["survey"])          # its last contact has moved


def delete_survey(path: str, survey: str) -> None:
    """Drop one survey's partition folder from the table, under the name that the writer gave it; a failed delete raises."""
    spark = SparkSession.getActiveSession()
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(survey)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/survey={escaped}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not fs.delete(target, True):
        raise OSError(f"could not delete {target}")
