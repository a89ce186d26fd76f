"""Text normalisation and projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.html import parse_html
from ..functions.spans import context as span_context
from ..rules import boards, scoring, skills
from ..rules.locations import UNKNOWN_LOCATION


def with_parsed_html(df: DataFrame, content: str = "content", into: str = "parsed") -> DataFrame:
    """Parse each page once; ``parsed.text`` and ``parsed.blocks`` feed everything behind."""
    return df.withColumn(into, parse_html(F.col(content)))


def strip_tags(text: Column) -> Column:
    """Light HTML strip used before eligibility rules: tags, two entities, white space, lower case."""
    bare = F.regexp_replace(text, "<[^>]+>", " ")
    bare = F.replace(F.replace(bare, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.lower(C.squash(F.coalesce(bare, F.lit(""))))


def normalize_title(title: Column) -> Column:
    """Lower case, slashes and underscores become blanks, white space collapsed."""
    lowered = C.strip(F.lower(F.coalesce(title, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(lowered, "[_/]", " "), C.SPACE, " ")


def split_sentences(line: Column) -> Column:
    """Sentences of a line; common abbreviations do not end one."""
    guarded = line
    for number, short in enumerate(skills.ABBREVIATIONS):
        guarded = F.replace(guarded, F.lit(short), F.lit(_guard(number)))
    parts = F.split(guarded, "(?U)" + skills.SENTENCE_BREAK)

    def restore(part: Column) -> Column:
        for number, short in enumerate(skills.ABBREVIATIONS):
            part = F.replace(part, F.lit(_guard(number)), F.lit(short))
        return C.squash(part)

    return F.filter(F.transform(parts, restore), lambda p: p != "")


def _guard(number: int) -> str:
    # No capital, digit or full stop may stand at either end, or the split would see it.
    return f"\u0003{chr(97 + number)}\u0003"


def logical_lines(parsed: Column) -> Column:
    """Ordered sentence-level lines of a parsed page; whole text where it has no blocks."""
    blocks = F.coalesce(
        parsed["blocks"], F.when(parsed["text"] != "", F.array(parsed["text"])).otherwise(C.empty_strings())
    )
    return F.flatten(F.transform(blocks, split_sentences))


def explode_lines(df: DataFrame, lines: Column, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """One row per line, numbered in order."""
    return df.select("*", F.posexplode(lines).alias(line_no, line))


def chunk_words(text: Column, size: int = scoring.CHUNK_WORDS, overlap: int = scoring.CHUNK_OVERLAP) -> Column:
    """Overlapping word chunks; a text of at most ``size`` words stays as it is."""
    stride = size - overlap

    def chunks(tokens: Column) -> Column:
        last = F.ceil((F.size(tokens) - F.lit(size)) / F.lit(float(stride))).cast("int")
        return F.when(F.size(tokens) <= size, F.array(text)).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.array_join(F.slice(tokens, i * F.lit(stride) + F.lit(1), size), " "),
        ))

    return F.when(F.coalesce(text, F.lit("")) == "", C.empty_strings()).otherwise(C.let(C.words(text), chunks))


def office_texts(offices: Column) -> Column:
    """Office names and every value of their locations, in order, without blanks."""
    per_office = F.transform(
        F.coalesce(offices, F.array()),
        lambda o: F.concat(F.array(F.nullif(o["name"], F.lit(""))), F.coalesce(o["location_values"], C.empty_strings())),
    )
    return F.filter(F.array_compact(F.flatten(per_office)), lambda v: v != "")


def metadata_pairs(metadata: Column) -> Column:
    """``array<struct<name, value>>``, one per value, trimmed and lower-cased, blank values dropped."""

    def norm(text: Column) -> Column:
        return F.lower(C.strip(F.coalesce(text, F.lit(""))))

    per_item = F.transform(
        F.coalesce(metadata, F.array()),
        lambda m: F.transform(
            F.coalesce(m["value"], C.empty_strings()),
            lambda v: F.struct(norm(m["name"]).alias("name"), norm(v).alias("value")),
        ),
    )
    return F.filter(F.flatten(per_item), lambda p: p["value"] != "")


def location_display(location: Column) -> Column:
    return F.coalesce(location["name"], F.lit(UNKNOWN_LOCATION))


def context_window(text: Column, start: Column, end: Column, radius: int) -> Column:
    """Text around a span, clipped and trimmed."""
    return span_context(text, start, end, radius)


def format_list(items: Column, limit: int) -> Column:
    """The first items, how many more there are, or "None"."""
    more = F.size(items) - F.lit(limit)
    shown = F.array_join(F.slice(items, 1, limit), ", ")
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit("None")).otherwise(
        F.concat(shown, F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.lit("")))
    )


def format_group(options: Column, min_matches: Column, matched: Column, text: Column) -> Column:
    """ "one of: …" or "at least k of: …", with the options that matched."""
    need = F.greatest(F.lit(1), F.coalesce(min_matches, F.lit(1)))
    lead = F.when(need <= 1, F.lit("one of: ")).otherwise(
        F.concat(F.lit("at least "), need.cast("string"), F.lit(" of: "))
    )
    hits = F.when(
        F.coalesce(F.size(matched), F.lit(0)) > 0, F.concat(F.lit(" | matched: "), F.array_join(matched, ", "))
    ).otherwise(F.lit(""))
    return F.when(
        F.coalesce(F.size(options), F.lit(0)) > 0, F.concat(lead, F.array_join(options, ", "), hits)
    ).otherwise(F.coalesce(F.nullif(text, F.lit("")), F.lit("Unknown grouped requirement")))


def pretty_name(name: Column) -> Column:
    """Underscores become blanks, words get capitals."""
    return C.title_case(F.replace(name, F.lit("_"), F.lit(" ")))


#: A whole date, then perhaps a time of day and a zone.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_utc(value: Column) -> Column:
    """ISO timestamp in UTC; no zone means UTC; parts of a date and anything else unreadable are null."""
    text = C.strip(value)
    seconds = F.regexp_replace(text, r"^(.{10}[T ]\d{2}:\d{2})(?!:)", "$1:00")
    return F.when(text.rlike(ISO_DATE), F.try_to_timestamp(seconds))


def board_token(value: Column) -> Column:
    """Board token out of a bare token or a board address; null where there is none."""
    raw = C.strip(value)
    is_url = raw.startswith("http://") | raw.startswith("https://")
    query = F.try_parse_url(raw, F.lit("QUERY"), F.lit("for"))
    parts = F.filter(
        F.split(F.coalesce(F.try_parse_url(raw, F.lit("PATH")), F.lit("")), "/"),
        lambda p: (p != "") & ~F.lower(p).isin(boards.PATH_WORDS),
    )
    hosted = F.contains(F.lower(F.try_parse_url(raw, F.lit("AUTHORITY"))), F.lit(boards.BOARD_DOMAIN))
    from_url = F.when(hosted, F.coalesce(F.nullif(query, F.lit("")), F.get(parts, F.lit(0))))
    return F.when(is_url, from_url).otherwise(F.nullif(F.regexp_replace(raw, "^/+|/+$", ""), F.lit("")))


def application_url(board: Column, posting_id: Column) -> Column:
    """Address of the application form; null where board or id is malformed."""
    token, number = C.strip(F.coalesce(board, F.lit(""))), C.strip(F.coalesce(posting_id, F.lit("")))
    return F.when(
        token.rlike("^[A-Za-z0-9_-]+$") & number.rlike(r"(?U)^\d+$"),
        F.concat(F.lit(boards.FORM_URL + "for="), token, F.lit("&token="), number),
    )


def is_board_url(url: Column) -> Column:
    """https and one of the board hosts."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    secure = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https"
    return F.coalesce(secure & host.isin(boards.BOARD_HOSTS), F.lit(False))


SCAN_SUMMARY_COUNTS = [
    "jobs_discovered", "target_role_jobs", "us_compatible_jobs", "jobs_eligible", "manual_priority_count",
    "agent_apply_count", "experience_rejected_count", "unknown_location_count",
]


def export_scan_summary(runs: DataFrame) -> DataFrame:
    """Allow-listed columns of a run row; missing counters become 0."""
    return runs.select(
        "board_token", "started_at", "completed_at",
        *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in SCAN_SUMMARY_COUNTS],
        F.coalesce(F.col("total_seconds").cast("double"), F.lit(0.0)).alias("total_seconds"),
    )


def export_candidate(queue: DataFrame) -> DataFrame:
    """Allow-listed columns of a queue candidate."""
    return queue.select(
        "board_token", F.coalesce(F.col("posting_id").cast("string"), F.lit("")).alias("posting_id"), "company",
        "title", "route", "application_status", "score", "confidence", "evaluation_completed_at",
    )


def export_queue_result(results: DataFrame) -> DataFrame:
    """Allow-listed columns of a queue result."""
    return results.select(
        "board_token", F.coalesce(F.col("posting_id").cast("string"), F.lit("")).alias("posting_id"), "company",
        "title", "queue_status", "outcome",
        F.coalesce("challenge_detected", F.lit(False)).alias("challenge_detected"),
        F.coalesce(F.col("ready_count").cast("bigint"), F.lit(0)).alias("ready_count"),
        F.coalesce(F.col("required_human_count").cast("bigint"), F.lit(0)).alias("required_human_count"),
        F.coalesce("browser_modified", F.lit(False)).alias("browser_modified"),
        F.lit(False).alias("submit_clicked_by_agent"),
        F.lit(False).alias("application_submitted"),
    )
