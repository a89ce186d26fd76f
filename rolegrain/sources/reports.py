"""Recorded form inspections and queue-run reports as rows; the run-report sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INSPECTION, QUEUE_REPORT


def form_fields(inspections: DataFrame) -> DataFrame:
    """One row per recorded field, numbered in order."""
    pages = [c for c in inspections.columns if c != "fields"]
    exploded = inspections.select(*pages, F.posexplode("fields").alias("field_no", "field"))
    return exploded.select(*pages, "field_no", "field.*")


def parse_inspections(documents: DataFrame, text: str = "value") -> DataFrame:
    doc = F.from_json(F.col(text), f"struct<{_ddl(INSPECTION)}>")
    return documents.select(*[c for c in documents.columns if c != text], doc.alias("_doc")).select(
        *[c for c in documents.columns if c != text], "_doc.*"
    )


def read_inspections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSPECTION).json(path, multiLine=True).withColumn("page_id", F.input_file_name())


def queue_results(reports: DataFrame) -> DataFrame:
    """One row per queue result of a run report."""
    exploded = reports.select("run_id", F.posexplode("results").alias("result_no", "result"))
    return exploded.select("run_id", "result_no", "result.*")


def parse_queue_reports(documents: DataFrame, text: str = "value") -> DataFrame:
    doc = F.from_json(F.col(text), f"struct<{_ddl(QUEUE_REPORT)}>")
    return documents.select(doc.alias("_doc")).select("_doc.*")


def read_queue_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUEUE_REPORT).json(path, multiLine=True)


def _ddl(columns: str) -> str:
    """Top-level column list as struct fields: "a int, b string" to "a: int, b: string"."""
    out, depth, field = [], 0, ""
    for char in columns + ",":
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            field = ""
        else:
            field += char
    return ", ".join(out)


def write_reports(reports: DataFrame, path: str, completed_at: Column, fmt: str = "parquet") -> None:
    """Append run reports below ``run_date=…``; one write job, no driver-side file."""
    dated = reports.withColumn("run_date", F.to_date(completed_at))
    dated.write.mode("append").partitionBy("run_date").format(fmt).save(path)


def write_state(state: DataFrame, path: str, version: str) -> str:
    """Write a new version of a state table next to the old ones and return its path.

    Readers switch by path; a lost job leaves the version before it intact.
    """
    target = f"{path}/version={version}"
    state.write.mode("errorifexists").parquet(target)
    return target
