"""Result writers."""

from __future__ import annotations

from pyspark.ml.clustering import KMeansModel
from pyspark.mllib.clustering import KMeansModel as CenterModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def one_text_file(result: DataFrame, folder: str, separator: str = ",") -> None:
    """A small final result as one file, replacing old output. Sorting and counting stay
    parallel; only the finished rows move to the single writer."""
    result.repartition(1).write.mode("overwrite").option("sep", separator).csv(folder)


def tab_separated(result: DataFrame, folder: str) -> None:
    result.write.mode("overwrite").option("sep", "\t").csv(folder)


def json_lines(result: DataFrame) -> DataFrame:
    """One JSON text per row, keys in sorted order."""
    return result.select(F.to_json(F.struct(*sorted(result.columns))).alias("line"))


def sorted_json(result: DataFrame, folder: str) -> None:
    json_lines(result).write.mode("overwrite").text(folder)


def save_records(records: DataFrame, folder: str) -> None:
    records.write.mode("overwrite").parquet(folder)


def load_records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def save_model(model: KMeansModel, folder: str) -> None:
    model.write().overwrite().save(folder)


def load_model(folder: str) -> KMeansModel:
    return KMeansModel.load(folder)


def save_centers(centers: DataFrame, folder: str) -> None:
    """Centers ``cluster, center`` as a model file that Spark's own k-means reads."""
    rows = sorted(centers.select("cluster", "center").collect())  # as many as a model has
    CenterModel([r["center"] for r in rows]).save(centers.sparkSession.sparkContext, folder)


def load_centers(spark: SparkSession, folder: str) -> DataFrame:
    model = CenterModel.load(spark.sparkContext, folder)
    rows = [(i, [float(x) for x in center]) for i, center in enumerate(model.clusterCenters)]
    return spark.createDataFrame(rows, "cluster INT, center ARRAY<DOUBLE>")


def timing_record(spark: SparkSession, job: str, read_s: float, process_s: float) -> DataFrame:
    """One timing row of a job run."""
    row = spark.range(1).select(F.lit(job).alias("job"), F.lit(read_s).alias("read_s"), F.lit(process_s).alias("process_s"))
    return row.withColumn("total_s", F.col("read_s") + F.col("process_s"))


def append_timing(record: DataFrame, folder: str) -> None:
    """Adds timing rows to those of earlier runs."""
    record.write.mode("append").parquet(folder)


def timings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("job STRING, read_s DOUBLE, process_s DOUBLE, total_s DOUBLE").parquet(folder)
