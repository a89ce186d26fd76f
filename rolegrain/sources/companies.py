"""Company list: one JSON array of {name, board_token, enabled}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import COMPANY


def parse_companies(documents: DataFrame, text: str = "value") -> DataFrame:
    """Entries of company documents in list order, with ``position``. An entry without ``enabled`` is enabled.

    Several documents are told apart by a ``document`` column, in whose order they count.
    """
    entries = F.from_json(F.col(text), f"array<{COMPANY}>")
    document = F.col("document") if "document" in documents.columns else F.lit(0)
    listed = documents.select(document.alias("document"), F.posexplode(entries).alias("position", "entry"))
    return listed.filter(F.col("entry").isNotNull()).select(
        "document", "position", C.strip(F.coalesce("entry.name", F.lit(""))).alias("name"),
        C.strip(F.coalesce("entry.board_token", F.lit(""))).alias("board_token"),
        F.coalesce("entry.enabled", F.lit(True)).alias("enabled"),
    )


def company_problems(entries: DataFrame) -> DataFrame:
    """Enabled entries that may not be loaded, with ``problem``."""
    problem = F.when(F.col("name") == "", F.lit("NAME_MISSING")).when(
        F.col("board_token") == "", F.lit("BOARD_TOKEN_MISSING")
    )
    return entries.filter("enabled").withColumn("problem", problem).filter(F.col("problem").isNotNull())


def enabled_companies(entries: DataFrame) -> DataFrame:
    """Enabled companies, the first per board token whatever its case.

    An entry without name or token fails the job when it is reached.
    """
    checked = entries.filter("enabled").withColumn(
        "board_token",
        F.when(F.col("name") == "", F.raise_error(F.lit("Every enabled company must have a name.")))
        .when(F.col("board_token") == "", F.raise_error(F.concat("name", F.lit(" does not have a board_token."))))
        .otherwise(F.col("board_token")),
    ).withColumn("_token", F.lower("board_token"))
    return C.first_by_rank(checked, ["_token"], [F.asc("document"), F.asc("position")]).select(
        "document", "position", "name", "board_token"
    )


def load_companies(spark: SparkSession, path: str) -> DataFrame:
    """Read a company file; it must name at least one enabled company."""
    companies = enabled_companies(parse_companies(spark.read.text(path, wholetext=True)))
    if companies.isEmpty():
        raise ValueError("no enabled companies were found")
    return companies
