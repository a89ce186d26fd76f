"""Board snapshots as landed JSON documents, and profile texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import BOARD_DOCUMENT
from .board_files import read_boards


def _office(office: Column) -> Column:
    """Location text or every value of a location object."""
    raw = office["location"]
    is_object = F.startswith(F.trim(raw), F.lit("{"))
    values = F.map_values(F.from_json(F.when(is_object, raw), "map<string,string>"))
    return F.struct(
        office["name"].alias("name"),
        F.when(is_object, values).otherwise(F.array_compact(F.array(raw))).alias("location_values"),
    )


def _metadata(item: Column) -> Column:
    """A scalar or list value as list."""
    raw = item["value"]
    is_list = F.startswith(F.trim(raw), F.lit("["))
    values = F.from_json(F.when(is_list, raw), "array<string>")
    return F.struct(
        item["name"].alias("name"), F.when(is_list, values).otherwise(F.array_compact(F.array(raw))).alias("value")
    )


def posting_columns(jobs: DataFrame) -> DataFrame:
    """Posting rows out of ``job`` structs beside their document's own fields (its company as ``_company``)."""
    return jobs.select(
        "board_token", F.coalesce("job.company_name", "_company").alias("company"),
        C.strip(F.col("job.id")).alias("posting_id"), "job.title", F.col("job.absolute_url").alias("url"),
        "job.content", "job.location", F.transform("job.offices", _office).alias("offices"),
        F.transform("job.metadata", _metadata).alias("metadata"), "run_id", "fetched_at",
    )


def postings_from_documents(documents: DataFrame, text: str = "value") -> DataFrame:
    """Posting rows out of snapshot documents held as rows; a document without jobs gives none.

    A document is one value here and so one task's work; ``board_files.read_boards`` reads files of any size.
    """
    doc = documents.select(F.from_json(F.col(text), BOARD_DOCUMENT).alias("doc"))
    return posting_columns(doc.select("doc.*").select(
        "board_token", F.col("company").alias("_company"), "run_id", "fetched_at", F.explode("jobs").alias("job")
    ))


def status_of(documents: DataFrame, failed: Column, jobs: Column) -> DataFrame:
    """Status per board from its documents: failed where one of them is, else by whether jobs came."""
    count = F.sum(F.greatest(F.coalesce(jobs, F.lit(0)), F.lit(0)))
    return documents.groupBy("board_token").agg(
        F.when(F.bool_or(failed), F.lit("FETCH_FAILED")).when(count > 0, F.lit("SUCCESS")).otherwise(F.lit("NO_JOBS")).alias("fetch_status")
    )


def fetch_status(documents: DataFrame, text: str = "value") -> DataFrame:
    """Status per board: FETCH_FAILED where a document says so, else by whether jobs came."""
    doc = documents.select(F.from_json(F.col(text), BOARD_DOCUMENT).alias("doc")).select("doc.*")
    return status_of(doc, F.coalesce(F.col("fetch_status") == "FETCH_FAILED", F.lit(False)), F.size("jobs"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Posting rows of landed snapshot files, one document each, of any size."""
    return read_boards(spark, path)[0]


def profile_corpus(profiles: DataFrame, text: str = "text") -> DataFrame:
    """Profile texts with ``characters`` and ``words``."""
    return profiles.withColumns({
        "characters": F.length(F.coalesce(text, F.lit(""))),
        "words": F.size(C.words(F.coalesce(text, F.lit("")))),
    })


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text profile files: name from the file name, ``filename``, ``text``."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("_path"))
    filename = F.regexp_extract("_path", "[^/]+$", 0)
    return profile_corpus(files.select(
        F.regexp_replace(filename, r"\.[^.]*$", "").alias("name"), filename.alias("filename"), C.strip(F.col("value")).alias("text")
    ))
