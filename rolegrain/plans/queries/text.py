"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import columns as C
from ...operators import text as X
from ...rules import boards as R
from . import bindings as b


@b.query("b1_clean_html")
def b1(spark, sf_dir):
    pages = X.with_parsed_html(b.table(spark, sf_dir, "pages"), "html")
    return pages.select("page_id", F.col("parsed.text").alias("text"))


@b.query("b2_strip_tags", f"""
SELECT page_id, lower({b.squash_sql("replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&')")}) AS text
FROM pages""")
def b2(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@b.query("b3_normalize_title", """
SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand || '_' || p_type), '[_/]', ' ', 'g'),
       '\\s+', ' ', 'g') AS title
FROM part""")
def b3(spark, sf_dir):
    name = F.concat(F.lit("  "), "p_name", F.lit(" / "), "p_brand", F.lit("_"), "p_type")
    return b.table(spark, sf_dir, "part").select("p_partkey", X.normalize_title(name).alias("title"))


@b.query("b4_logical_lines")
def b4(spark, sf_dir):
    pages = X.with_parsed_html(b.table(spark, sf_dir, "pages"), "html")
    return pages.select("page_id", F.posexplode(X.logical_lines(F.col("parsed"))).alias("line_no", "line"))


SENTENCES = """list_filter(list_transform(
    string_split(regexp_replace({0}, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
    lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')"""


@b.query("b5_sentences", f"""
WITH s AS (SELECT doc_id, {SENTENCES.format('text')} AS parts FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS sentence_no, parts[n + 1] AS sentence
FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS n FROM s)""")
def b5(spark, sf_dir):
    return b.documents(spark, sf_dir).select(
        "doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("sentence_no", "sentence")
    )


@b.query("b6_word_chunks", """
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM documents),
n AS (SELECT *, CASE WHEN len(words) <= 120 THEN 1 ELSE CAST(ceil((len(words) - 120) / 95.0) AS BIGINT) + 1 END AS chunks FROM w),
c AS (SELECT *, unnest(range(chunks)) AS i FROM n WHERE text <> '')
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no,
       CASE WHEN len(words) <= 120 THEN text ELSE array_to_string(words[i * 95 + 1 : i * 95 + 120], ' ') END AS chunk
FROM c""")
def b6(spark, sf_dir):
    return b.documents(spark, sf_dir).select(
        "doc_id", F.posexplode(X.chunk_words(F.col("text"))).alias("chunk_no", "chunk")
    )


@b.query("b7_office_texts", b.with_ctes(b.POSTINGS) + """
SELECT doc_id, array_to_string(list_filter([office, office_location], lambda x: x <> ''), '|') AS offices FROM p""")
def b7(spark, sf_dir):
    p = b.postings(spark, sf_dir)
    return p.select("doc_id", F.array_join(X.office_texts(F.col("offices")), "|").alias("offices"))


@b.query("b8_metadata_pairs", b.with_ctes(b.POSTINGS) + """
SELECT doc_id, lower(field) AS name, lower(v) AS value
FROM (SELECT doc_id, field, unnest([value_1, value_2]) AS v FROM p) WHERE v <> ''""")
def b8(spark, sf_dir):
    p = b.postings(spark, sf_dir)
    return p.select("doc_id", F.inline(X.metadata_pairs(F.col("metadata"))).alias("name", "value"))


@b.query("b9_location_display", """
SELECT doc_id, CASE WHEN lang = 'de' THEN 'Unknown location' ELSE lang END AS location FROM documents""")
def b9(spark, sf_dir):
    name = F.when(F.col("lang") != "de", F.struct(F.col("lang").alias("name")))
    return b.documents(spark, sf_dir).select("doc_id", X.location_display(name).alias("location"))


@b.query("b10_context_window", f"""
WITH t AS (SELECT doc_id, text, CAST(instr(text, 'an') - 1 AS INTEGER) AS s FROM documents WHERE contains(text, 'an'))
SELECT doc_id, {b.strip_sql("substr(text, greatest(s - 140, 0) + 1, s + 2 + 140 - greatest(s - 140, 0))")} AS context
FROM t""")
def b10(spark, sf_dir):
    t = b.documents(spark, sf_dir).withColumn("s", F.instr("text", "an") - 1).filter(F.col("s") >= 0)
    return t.select("doc_id", X.context_window(F.col("text"), F.col("s"), F.col("s") + 2, 140).alias("context"))


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


@b.query("b11_list_rendering", f"""
WITH w AS (SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN [] ELSE {_WORDS} END AS items FROM documents)
SELECT doc_id,
  CASE WHEN len(items) = 0 THEN 'None' ELSE array_to_string(items[1:8], ', ')
    || CASE WHEN len(items) > 8 THEN ' (+' || CAST(len(items) - 8 AS VARCHAR) || ' more)' ELSE '' END END AS listed,
  CASE WHEN len(items) = 0 THEN 'Unknown grouped requirement'
    ELSE CASE WHEN doc_id % 3 <= 1 THEN 'one of: ' ELSE 'at least 2 of: ' END || array_to_string(items, ', ')
      || ' | matched: ' || items[1] END AS grouped
FROM w""")
def b11(spark, sf_dir):
    items = F.when(F.col("doc_id") % 12 == 0, C.empty_strings()).otherwise(C.words(F.col("text")))
    t = b.documents(spark, sf_dir).withColumn("items", items)
    return t.select(
        "doc_id", X.format_list(F.col("items"), 8).alias("listed"),
        X.format_group(
            F.col("items"), (F.col("doc_id") % 3).cast("int"), F.slice("items", 1, 1), F.lit(None).cast("string")
        ).alias("grouped"),
    )


@b.query("b12_pretty_names", """
SELECT c_custkey, array_to_string(list_transform(string_split(lower(c_mktsegment || ' ' || 'ai engineer'), ' '),
       lambda w: upper(w[1]) || w[2:]), ' ') AS name
FROM customer""")
def b12(spark, sf_dir):
    raw = F.concat("c_mktsegment", F.lit("_ai_engineer"))
    return b.table(spark, sf_dir, "customer").select("c_custkey", X.pretty_name(raw).alias("name"))


_K = "regexp_extract(props, '\"k\": ([0-9]+)', 1)"


@b.query("b13_safe_values", f"""
SELECT event_id, nullif(trim(event_type), '') AS kind,
       greatest(0, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' WHEN event_id % 3 = 1 THEN '-' ELSE '' END || {_K} || CASE WHEN event_id % 5 = 0 THEN '0000000000' ELSE '' END AS BIGINT), 7)) AS whole,
       CASE WHEN value - 20 >= 0 THEN {b.round2_sql('value - 20', 3)} ELSE 0.0 END AS number,
       array_to_string(list_distinct_ordered, '|') AS listed
FROM (SELECT *, CASE WHEN event_type = 'click' THEN ['click', 'a', 'beyond'] ELSE [event_type, 'click', 'a', 'beyond'] END AS list_distinct_ordered FROM events)""")
def b13(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1)
    sign = F.when(F.col("event_id") % 3 == 0, F.lit("x")).when(F.col("event_id") % 3 == 1, F.lit("-")).otherwise(F.lit(""))
    values = F.array("event_type", F.lit(" click "), F.lit("  "), F.lit("a"), F.lit(None).cast("string"), F.lit("a "), F.lit("beyond"))
    return e.select(
        "event_id", C.safe_text(F.concat(F.lit(" "), "event_type", F.lit("\n"))).alias("kind"),
        C.nonneg_int(F.concat(sign, k, F.when(F.col("event_id") % 5 == 0, F.lit("0" * 10)).otherwise(F.lit(""))), 7).alias("whole"), C.nonneg_double(F.col("value") - 20).alias("number"),
        F.array_join(C.safe_list(values), "|").alias("listed"),
    )


@b.query("b14_parse_utc", """
SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT)
         - CASE WHEN event_id % 4 = 2 THEN 7200 ELSE 0 END AS seconds
FROM events WHERE event_id % 8 NOT IN (3, 4, 5, 6, 7) UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 8 IN (3, 4, 5, 6, 7)""")
def b14(spark, sf_dir):
    e, key = b.table(spark, sf_dir, "events"), F.col("event_id")
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(key % 4 == 0, F.concat(plain, F.lit("Z"))).when(key % 4 == 1, plain)
        .when(key % 4 == 2, F.concat(plain, F.lit("+02:00"))).otherwise(F.concat(F.lit("soon "), plain))
    )
    # Parts of a date and of a time are no timestamps.
    part = F.element_at(F.array(*map(F.lit, ["2026", "2026-09", "12:30", "T10"])), (key % 4).cast("int") + 1)
    text = F.when(key % 8 >= 4, part).otherwise(text)
    return e.select("event_id", F.unix_timestamp(X.parse_utc(text)).alias("seconds"))


@b.query("b15_export_projection", b.with_ctes(b.RUNS) + """
SELECT board_token, CAST(started_at AS DATE) AS started_on, CAST(completed_at AS DATE) AS completed_on, jobs_discovered,
       target_role_jobs, us_compatible_jobs, jobs_eligible, manual_priority_count, agent_apply_count,
       experience_rejected_count, coalesce(unknown_location_count, 0) AS unknown_location_count, total_seconds
FROM runs""")
def b15(spark, sf_dir):
    out = X.export_scan_summary(b.runs(spark, sf_dir))
    return out.withColumns({
        "started_on": F.to_date("started_at"), "completed_on": F.to_date("completed_at"),
    }).drop("started_at", "completed_at")


@b.query("b16_application_urls", f"""
SELECT doc_id,
  CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0
       THEN {b.q(R.FORM_URL)} || 'for=' || source || '&token=' || CAST(doc_id AS VARCHAR) END AS form_url,
  doc_id % 3 = 0 AS board_url
FROM documents""")
def b16(spark, sf_dir):
    d, key = b.documents(spark, sf_dir), F.col("doc_id")
    board = F.when(key % 5 == 0, F.concat("source", F.lit("/x"))).otherwise(F.concat(F.lit(" "), "source"))
    number = F.when(key % 7 == 0, F.lit("12a")).otherwise(key.cast("string"))
    url = (
        F.when(key % 3 == 0, F.lit("https://boards.greenhouse.io/x/jobs/1"))
        .when(key % 3 == 1, F.lit("http://boards.greenhouse.io/x/jobs/1"))
        .otherwise(F.lit("https://boards.greenhouse.io.example.com/x"))
    )
    return d.select(
        "doc_id", X.application_url(board, number).alias("form_url"),
        X.is_board_url(F.concat(url, F.lit("?"), "source")).alias("board_url"),
    )
