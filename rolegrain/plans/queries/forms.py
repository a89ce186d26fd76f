"""Recorded form fields: one form per customer, wordings by customer number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import forms as K
from ...rules import forms as R
from . import bindings as b

LABELS = [
    "First Name*", "Preferred First Name", "Last Name*", "Email*", "Phone", "Attach",
    "Are you legally authorized to work in the United States?*", "Do you currently require sponsorship to start employment?",
    "Will you require sponsorship in the future?", "Do you now or in the future require visa sponsorship?",
    "Are you authorized to work without sponsorship at this time?", "Will you need immigration support?",
    "How did you hear about this job?*", "Gender", "Country*", "Location (City)*", "State", "Zip Code", "LinkedIn Profile*",
    "What is your preferred office location?", "School", "Desired salary", "Why do you want to work here?", "Favorite problem?",
    "g-recaptcha-response", "Name", "Do you hold a security clearance?", "Are you willing to relocate?", "Website", "ITAR status",
]
TYPES = ["text", "text", "tel", "file", "radio", "hidden", "textarea"]
CONTEXTS = ["Resume/CV Attach", "Cover Letter Attach", "", "Do you require sponsorship in the future?"]
PER_FORM = 8


def fields(spark, sf_dir):
    """Classifier input: eight fields per customer."""
    c, key = b.dealt(b.table(spark, sf_dir, "customer"), "c_custkey"), F.col("c_custkey")
    f = c.select("c_custkey", "c_mktsegment", "c_acctbal", F.explode(F.sequence(F.lit(0), F.lit(PER_FORM - 1))).alias("field_no"))
    n = key * 5 + F.col("field_no") * 7
    return f.select(
        key.alias("page_id"), "field_no", F.col("field_no").alias("first_index"), b.pick(LABELS, n).alias("label"),
        F.when(b.pick(LABELS, n) == "Attach", F.lit("file")).otherwise(b.pick(TYPES, key + F.col("field_no"))).alias("type"),
        F.lit("").alias("name"), F.lit(None).cast("string").alias("placeholder"),
        b.pick(CONTEXTS, n).alias("context_text"), (n % 3 != 0).alias("required"),
        F.col("c_mktsegment").alias("profile_id"), (F.col("c_acctbal") > 0).alias("resume_present"),
    )


_N = "(c_custkey * 5 + field_no * 7)"
FIELDS = f"""fields AS (
  SELECT c_custkey AS page_id, field_no, label, CASE WHEN label = 'Attach' THEN 'file' ELSE {b.pick_sql(TYPES, 'c_custkey + field_no')} END AS type,
         {b.pick_sql(CONTEXTS, _N)} AS context_text, {_N} % 3 <> 0 AS required, c_mktsegment AS profile_id, c_acctbal > 0 AS resume_present
  FROM (SELECT *, {b.pick_sql(LABELS, _N)} AS label FROM customer, (SELECT CAST(unnest(range({PER_FORM})) AS INTEGER) AS field_no)))"""


def _word(text: str, word: str) -> str:
    return f"regexp_matches({text}, {b.q(chr(92) + 'b' + word + chr(92) + 'b')})"


def _classifier() -> str:
    """The ordered rules as one CASE giving "category|action|key"."""
    any_of = b.contains_sql
    rungs = [
        (f"type IN ({', '.join(map(b.q, R.SKIPPED_TYPES))}) OR {any_of('said', R.CLASSIFIER_TECHNICAL)}", "TECHNICAL_CONTROL|IGNORE|"),
        ("type = 'file' AND resume AND NOT cover", "RESUME|RESUME_FILE|SELECTED_RESUME_FILE"),
        ("type = 'file' AND cover AND NOT resume", "COVER_LETTER_UPLOAD|NEEDS_ASSISTANCE|"),
        ("type = 'file'", "UNKNOWN_FILE_UPLOAD|NEEDS_ASSISTANCE|"),
        ("auth AND sponsor AND without AND (future OR either)", "WORK_AUTH_WITHOUT_SPONSORSHIP_FUTURE|FIXED_ANSWER|WORK_AUTH_WITHOUT_SPONSORSHIP_FUTURE"),
        ("auth AND sponsor AND without AND now AND NOT future", "WORK_AUTH_WITHOUT_SPONSORSHIP_NOW|FIXED_ANSWER|WORK_AUTH_WITHOUT_SPONSORSHIP_NOW"),
        ("auth AND sponsor AND without", "WORK_AUTH_SPONSORSHIP_AMBIGUOUS|NEEDS_ASSISTANCE|"),
        ("sponsor AND either", "SPONSORSHIP_NOW_OR_FUTURE|FIXED_ANSWER|SPONSORSHIP_NOW_OR_FUTURE"),
        ("sponsor AND future AND NOT now", "SPONSORSHIP_FUTURE|FIXED_ANSWER|SPONSORSHIP_FUTURE"),
        ("sponsor AND now AND NOT future", "SPONSORSHIP_NOW|FIXED_ANSWER|SPONSORSHIP_NOW"),
        ("sponsor", "SPONSORSHIP_AMBIGUOUS|NEEDS_ASSISTANCE|"), ("auth", "WORK_AUTHORIZATION_US|FIXED_ANSWER|WORK_AUTHORIZED_US"),
    ]
    for category, phrases, words, _ in R.SENSITIVE_QUESTIONS:
        rungs.append((" OR ".join([any_of("said", phrases), *[_word("said", w) for w in words]]), f"{category}|NEEDS_ASSISTANCE|"))
    for category, key, phrases, words, without, labels, control, _ in R.PROFILE_FIELDS:
        parts = ([any_of("own", phrases)] if phrases else []) + [_word("own", w) for w in words]
        hit = "(" + (" OR ".join(parts) or "FALSE") + ")"
        if without:
            hit = f"({hit} AND NOT {any_of('own', without)})"
        if labels:
            exact = f"own IN ({', '.join(map(b.q, labels))})"
            hit += f" OR ({exact} AND type NOT IN ('radio', 'checkbox'))" if category == "FULL_NAME" else f" OR {exact}"
        if control:
            hit += f" OR type = '{control}'"
        rungs.append((hit, f"{category}|{'PROFILE_VALUE' if key else 'NEEDS_ASSISTANCE'}|{key or ''}"))
    for category, phrases, _ in R.HUMAN_QUESTIONS:
        rungs.append((any_of("said", phrases), f"{category}|NEEDS_ASSISTANCE|"))
    return b.case_sql([(c, b.q(v)) for c, v in rungs], b.q(R.UNKNOWN_FIELD[0] + "|NEEDS_ASSISTANCE|"))


_SAID = ", ".join(
    f"{b.contains_sql('said', words)} AS {name}"
    for name, words in (("auth", R.AUTHORIZATION), ("sponsor", R.SPONSORSHIP), ("future", R.FUTURE), ("now", R.CURRENT),
                        ("without", R.WITHOUT_SPONSORSHIP))
)
CLASSIFIED = f"""said AS (SELECT *, lower(label) AS own, lower(trim(label || ' ' || context_text)) AS everything,
    CASE WHEN lower(label) IN ({', '.join(map(b.q, R.GENERIC_LABELS))}) THEN lower(trim(label || ' ' || context_text)) ELSE lower(label) END AS said FROM fields),
signs AS (SELECT *, {_SAID}, {b.contains_sql('said', R.NOW_OR_FUTURE)} OR ({_word('said', 'now')} AND {_word('said', 'future')}) AS either,
    {b.contains_sql('everything', R.RESUME_WORDS)} AS resume, contains(everything, 'cover letter') AS cover FROM said),
classified AS (SELECT *, string_split({_classifier()}, '|') AS c FROM signs),
decided AS (SELECT page_id, field_no, label, required, profile_id, resume_present, c[1] AS category, c[2] AS action, nullif(c[3], '') AS answer_key FROM classified)"""


@b.query("k2_field_decisions", b.with_ctes(FIELDS, CLASSIFIED) + """
SELECT page_id, field_no, label, category, action, answer_key FROM decided""")
def k2(spark, sf_dir):
    return K.with_decision(fields(spark, sf_dir)).select(
        "page_id", "field_no", "label", "decision.category", "decision.action", "decision.answer_key"
    )


def raw_controls(spark, sf_dir):
    """Raw controls of a form: duplicates of a field and an unlabeled helper behind some of them."""
    f = fields(spark, sf_dir)
    control = F.struct(
        F.lit("input").alias("tag"), F.col("type"), F.lit("").alias("id"), F.lit("").alias("name"), F.col("label"),
        F.lit("").alias("placeholder"), F.col("context_text"), F.col("required"), F.lit("v").alias("value"),
        F.array(F.col("type"), F.lit("Yes")).alias("options"),
    )
    twin = control.withField("type", F.lit("tel")).withField("options", F.array(F.lit("No"), F.lit("Yes")))
    helper = control.withField("label", F.lit("")).withField("type", F.lit("text")).withField(
        "context_text", F.when(F.col("field_no") % 2 == 0, F.concat(F.lit("x "), "label")).otherwise(F.lit("elsewhere"))
    )
    listed = f.select("page_id", "field_no", F.posexplode(F.array(control, twin, helper)).alias("n", "c"))
    return listed.select("page_id", (F.col("field_no") * 3 + F.col("n")).alias("index"), "c.*")


@b.query("k1_grouped_fields")
def k1(spark, sf_dir):
    grouped = K.group_fields(raw_controls(spark, sf_dir))
    return grouped.select(
        "page_id", "first_index", "label", "type", "required", "context_text", F.array_join("options", "|").alias("options"),
        F.array_join(F.transform("dom_indices", lambda i: i.cast("string")), ",").alias("dom_indices"), "source_count",
    )


def facts(spark, sf_dir):
    """Profile facts per market segment: which keys are present, three work-authorization facts."""
    c = b.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("profile_id")).distinct()
    keys = [*R.PROFILE_KEYS, *R.AUTHORIZATION_FACTS]
    size = F.length("profile_id")
    listed = c.select("profile_id", size.alias("s"), F.posexplode(F.array(*map(F.lit, keys))).alias("i", "answer_key"))
    boolean = F.when(F.col("s") == 9, F.lit(None).cast("boolean")).otherwise((F.col("s") + F.col("i")) % 2 == 0)
    return listed.select(
        "profile_id", "answer_key", ((F.col("s") + F.col("i")) % 4 != 0).alias("present"),
        F.when(F.col("answer_key").isin(R.AUTHORIZATION_FACTS), boolean).alias("bool_value"),
    )


_KEYS = [*R.PROFILE_KEYS, *R.AUTHORIZATION_FACTS]
_AT = {k: i for i, k in enumerate(_KEYS)}


def _bool(key: str) -> str:
    return f"(CASE WHEN len(profile_id) <> 9 THEN (len(profile_id) + {_AT[key]}) % 2 = 0 END)"


_A, _S, _F = (_bool(k) for k in R.AUTHORIZATION_FACTS)
_PRESENT = "(CASE answer_key " + " ".join(f"WHEN '{k}' THEN (len(profile_id) + {i}) % 4 <> 0" for k, i in _AT.items()) + \
    f" WHEN 'FULL_NAME' THEN (len(profile_id) + {_AT['FIRST_NAME']}) % 4 <> 0 AND (len(profile_id) + {_AT['LAST_NAME']}) % 4 <> 0 ELSE FALSE END)"
_ANSWER = f"""(CASE answer_key WHEN 'WORK_AUTHORIZED_US' THEN {_A} WHEN 'SPONSORSHIP_NOW' THEN {_S} WHEN 'SPONSORSHIP_FUTURE' THEN {_F}
  WHEN 'SPONSORSHIP_NOW_OR_FUTURE' THEN CASE WHEN {_S} IS NOT NULL AND {_F} IS NOT NULL THEN {_S} OR {_F} END
  WHEN 'WORK_AUTH_WITHOUT_SPONSORSHIP_NOW' THEN CASE WHEN {_A} IS NOT NULL AND {_S} IS NOT NULL THEN {_A} AND NOT {_S} END
  WHEN 'WORK_AUTH_WITHOUT_SPONSORSHIP_FUTURE' THEN CASE WHEN {_A} IS NOT NULL AND {_S} IS NOT NULL AND {_F} IS NOT NULL THEN {_A} AND NOT {_S} AND NOT {_F} END END)"""
_HINT = "(CASE answer_key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.FIXED_ANSWERS.items()) + " END)"
RESOLVED = f"""answered AS (SELECT *, {_PRESENT} AS present, CASE WHEN action = 'FIXED_ANSWER' THEN CASE {_ANSWER} WHEN TRUE THEN 'Yes' WHEN FALSE THEN 'No' END END AS answer,
    {_HINT} AS hint FROM decided),
resolved AS (SELECT *, CASE action WHEN 'IGNORE' THEN 'IGNORED' WHEN 'NEEDS_ASSISTANCE' THEN CASE WHEN required THEN 'REQUIRED_ASSISTANCE' ELSE 'OPTIONAL_ASSISTANCE' END
    WHEN 'RESUME_FILE' THEN CASE WHEN resume_present THEN 'READY' ELSE 'MISSING_RESUME' END
    WHEN 'PROFILE_VALUE' THEN CASE WHEN present THEN 'READY' WHEN required THEN 'MISSING_REQUIRED_PROFILE' ELSE 'OPTIONAL_MISSING' END
    WHEN 'FIXED_ANSWER' THEN CASE WHEN answer IS NULL THEN CASE WHEN required THEN 'REQUIRED_ASSISTANCE' ELSE 'OPTIONAL_ASSISTANCE' END
      WHEN answer <> hint THEN 'POLICY_MISMATCH' ELSE 'READY' END END AS status, required OR action = 'RESUME_FILE' AS must FROM answered)"""
FORMS = b.with_ctes(FIELDS, CLASSIFIED, RESOLVED)


def resolved(spark, sf_dir):
    return K.resolve_fields(K.with_decision(fields(spark, sf_dir)), facts(spark, sf_dir))


@b.query("k3_resolved_fields", FORMS + """
SELECT page_id, field_no, status, must AS required, answer AS display_answer,
  CASE action WHEN 'IGNORE' THEN 'none' WHEN 'NEEDS_ASSISTANCE' THEN 'human' WHEN 'RESUME_FILE' THEN 'matcher'
    WHEN 'PROFILE_VALUE' THEN 'profile' ELSE 'profile-policy' END AS source,
  CASE WHEN status = 'READY' OR answer IS NOT NULL THEN CASE WHEN answer_key IN ('EMAIL', 'PHONE', 'STREET_ADDRESS', 'POSTAL_CODE')
    THEN '<redacted>' ELSE coalesce(answer, '<present>') END END AS value_preview
FROM resolved""")
def k3(spark, sf_dir):
    return resolved(spark, sf_dir).select("page_id", "field_no", "status", "required", "display_answer", "source", "value_preview")


ROLLUP = """rollup AS (SELECT page_id, count(*) AS total_fields, count(*) FILTER (status = 'READY') AS ready_fields,
  count(*) FILTER (status IN ('REQUIRED_ASSISTANCE', 'MISSING_REQUIRED_PROFILE', 'MISSING_RESUME', 'POLICY_MISMATCH')) AS required_unresolved,
  count(*) FILTER (status IN ('OPTIONAL_ASSISTANCE', 'OPTIONAL_MISSING')) AS optional_unresolved,
  count(*) FILTER (status = 'POLICY_MISMATCH') AS policy_mismatches, count(*) FILTER (status = 'MISSING_RESUME') AS missing_resume
  FROM resolved GROUP BY page_id)"""


@b.query("k4_application_rollup", b.with_ctes(FIELDS, CLASSIFIED, RESOLVED, ROLLUP) + """
SELECT *, required_unresolved = 0 AS ready_for_submission FROM rollup""")
def k4(spark, sf_dir):
    return K.application_rollup(resolved(spark, sf_dir)).drop("browser_modified", "submit_attempted")


def handoffs(spark, sf_dir):
    """Packets per customer form; some fills failed, some pages showed a challenge."""
    c, key = b.dealt(b.table(spark, sf_dir, "customer"), "c_custkey"), F.col("c_custkey")
    pages = c.select(
        key.alias("page_id"), F.concat(F.lit("https://example.com/"), key.cast("string")).alias("requested_url"),
        F.concat(F.lit("Job Application for "), "c_mktsegment", F.lit(" at "), "c_name").alias("page_title"),
        F.lit(None).cast("string").alias("company"), F.lit("").alias("job_title"),
        F.concat(F.lit("/home/x/"), "c_mktsegment", F.lit(".pdf")).alias("resume_path"),
        (F.col("c_acctbal") < 1000).alias("challenge_detected"), F.array(F.lit("frame"), F.lit(" ")).alias("challenge_reasons"),
        F.when(F.col("c_nationkey") == 3, F.lit(1)).alias("submit_attempts_blocked"),
        (F.col("c_nationkey") == 5).alias("nonready_mutation_detected"), F.lit("").alias("nonready_mutation_reason"),
    )
    fills = c.filter(F.col("c_nationkey") < 8).select(
        key.alias("page_id"), F.lit("FILL_FAILED").alias("status"), F.lit("EMAIL").alias("answer_key"),
        F.lit("Email*").alias("label"), F.lit("EMAIL").alias("category"), (F.col("c_nationkey") < 4).alias("required"),
        F.lit("profile").alias("source"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("place"),
    )
    return K.build_handoffs(pages, resolved(spark, sf_dir), fills)


PACKETS = """packets AS (
  SELECT c_custkey AS page_id, c_mktsegment AS job_title, c_name AS company, c_mktsegment || '.pdf' AS selected_resume,
    c_acctbal < 1000 AS challenge, (c_nationkey < 8)::INT AS failures, c_nationkey = 3 AS blocked, c_nationkey = 5 AS mutated,
    (SELECT count(*) FROM resolved r WHERE r.page_id = c_custkey AND status = 'READY' AND NOT (c_nationkey < 8 AND coalesce(answer_key, '') = 'EMAIL')) AS ready,
    (SELECT count(*) FROM resolved r WHERE r.page_id = c_custkey AND status <> 'READY') + (c_nationkey < 8)::INT AS human,
    (SELECT count(*) FROM resolved r WHERE r.page_id = c_custkey AND status <> 'READY' AND must) + (c_nationkey < 4)::INT AS blocking,
    (SELECT count(*) FROM resolved r WHERE r.page_id = c_custkey AND status = 'POLICY_MISMATCH') AS mismatches,
    (SELECT count(*) FROM resolved r WHERE r.page_id = c_custkey AND status = 'MISSING_RESUME') AS no_resume
  FROM customer),
reasons AS (SELECT *, list_filter([CASE WHEN challenge THEN 'Page challenge / CAPTCHA detected.' END,
   CASE WHEN failures > 0 THEN '1 deterministic browser fill(s) failed.' END,
   CASE WHEN blocked THEN 'A form submission attempt was blocked by the browser safety guard.' END,
   CASE WHEN blocking > 0 THEN CAST(blocking AS VARCHAR) || ' required field(s) need human resolution.' END,
   CASE WHEN mismatches > 0 THEN 'Policy mismatch detected.' END, CASE WHEN no_resume > 0 THEN 'Selected resume is missing.' END,
   CASE WHEN mutated THEN 'Browser contamination safety violation detected.' END], lambda x: x IS NOT NULL) AS why FROM packets)"""
HANDOFFS = b.with_ctes(FIELDS, CLASSIFIED, RESOLVED, PACKETS)


@b.query("k5_handoff_packets", HANDOFFS + """
SELECT page_id, job_title, company, selected_resume, CASE WHEN len(why) > 0 THEN 'NEEDS_ASSISTANCE' ELSE 'AGENT_CONTINUE' END AS route,
  array_to_string(why, '|') AS route_reasons, CAST(ready AS INTEGER) AS ready_count, CAST(human AS INTEGER) AS human_assistance_count,
  CAST(blocking AS INTEGER) AS required_human_count FROM reasons""")
def k5(spark, sf_dir):
    return handoffs(spark, sf_dir).select(
        "page_id", "job_title", "company", "selected_resume", "route", F.array_join("route_reasons", "|").alias("route_reasons"),
        "summary.ready_count", "summary.human_assistance_count", "summary.required_human_count",
    )


@b.query("k6_safe_packets", HANDOFFS + """
SELECT page_id, selected_resume, CAST(ready AS INTEGER) AS ready_count, CAST(human AS INTEGER) AS human_count, challenge, mutated,
  (SELECT count(*) FROM resolved r WHERE r.page_id = reasons.page_id AND answer IS NOT NULL) AS shown_answers
FROM reasons""")
def k6(spark, sf_dir):
    safe = K.sanitize_handoffs(handoffs(spark, sf_dir))
    items = F.concat("deterministic_ready", "human_assistance")
    shown = F.size(F.filter(items, lambda i: i["display_answer"].isNotNull()))
    return safe.select(
        "page_id", "selected_resume", "summary.ready_count", F.col("summary.human_assistance_count").alias("human_count"),
        F.col("challenge.detected").alias("challenge"), F.col("browser_safety.nonready_mutation_detected").alias("mutated"),
        shown.cast("bigint").alias("shown_answers"),
    )


@b.query("k6_read_packets", HANDOFFS + """
SELECT page_id, CASE WHEN page_id % 7 IN (1, 2) THEN ready ELSE CAST(floor(ready + CASE WHEN page_id % 7 = 3 THEN 0.75 ELSE 0.5 END) AS BIGINT) END AS ready_count,
  blocking AS required_human_count, ready AS ready_items, human AS human_items,
  (SELECT count(*) FROM resolved r WHERE r.page_id = reasons.page_id AND answer IS NOT NULL) AS shown_answers
FROM reasons WHERE page_id % 7 <> 0 AND page_id % 11 <> 0 AND page_id % 13 <> 0 AND page_id % 17 <> 0""")
def k6_read(spark, sf_dir):
    safe, key = K.sanitize_handoffs(handoffs(spark, sf_dir)), F.col("page_id")
    count = F.col("summary.ready_count").cast("double")
    given = F.when(key % 7 == 1, F.lit("-1")).when(key % 7 == 2, F.lit("many")).when(key % 7 == 3, (count + 0.25).cast("string")).otherwise(count.cast("string"))
    packet = F.struct(
        # A null among the items is dropped on reading.
        F.concat("deterministic_ready", F.array(F.lit(None))).alias("deterministic_ready"), "human_assistance",
        F.struct(given.alias("ready_count"), F.lit(None).cast("string").alias("required_human_count")).alias("summary"),
    )
    requests = safe.select(
        "page_id", F.when(key % 11 == 0, F.lit("ELIGIBILITY")).otherwise(F.lit("BROWSER")).alias("source"), (key % 13 == 0).alias("resolved"),
        F.when(key % 17 == 0, F.lit(2)).otherwise(F.lit(1)).alias("handoff_version"), F.when(key % 7 != 0, packet).alias("handoff"),
    )
    shown = F.filter(F.concat("ready_items", "human_items"), lambda i: i["display_answer"].isNotNull())
    return K.read_packets(requests).select(
        "page_id", "ready_count", "required_human_count", F.size("ready_items").cast("bigint").alias("ready_items"),
        F.size("human_items").cast("bigint").alias("human_items"), F.size(shown).cast("bigint").alias("shown_answers"),
    )


@b.query("k7_assistance_texts", HANDOFFS + """
SELECT page_id, 'BROWSER: ' || coalesce(nullif(array_to_string(list_filter([CASE WHEN challenge THEN 'CAPTCHA' END,
    CASE WHEN blocking > 0 THEN 'REQUIRED_QUESTIONS=' || CAST(blocking AS VARCHAR) END, CASE WHEN mismatches > 0 THEN 'POLICY_MISMATCH' END,
    CASE WHEN no_resume > 0 THEN 'MISSING_RESUME' END, CASE WHEN mutated THEN 'SAFETY_VIOLATION' END], lambda x: x IS NOT NULL), ' + '), ''), 'HUMAN_REVIEW') AS reason,
  'Browser application handoff: ' || coalesce(nullif(array_to_string(list_filter([CASE WHEN challenge THEN 'CAPTCHA detected' END,
    CASE WHEN blocking > 0 THEN CAST(blocking AS VARCHAR) || ' required field(s) need review' END,
    CASE WHEN ready > 0 THEN CAST(ready AS VARCHAR) || ' deterministic field(s) are ready' END], lambda x: x IS NOT NULL), '; '), ''),
    'browser handoff needs review') || '.' AS question
FROM reasons""")
def k7(spark, sf_dir):
    safe = K.sanitize_handoffs(handoffs(spark, sf_dir))
    return safe.select(
        "page_id", K.assistance_reason(F.col("summary"), F.col("browser_safety")).alias("reason"),
        K.assistance_question(F.col("summary")).alias("question"),
    )


@b.query("k8_page_titles", """
SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_mktsegment END AS job_title, CASE WHEN c_nationkey < 20 THEN c_name END AS company FROM customer""")
def k8(spark, sf_dir):
    lead = F.when(F.col("c_nationkey") < 20, F.lit(" job application FOR  ")).otherwise(F.lit("Careers: "))
    title = F.concat(lead, "c_mktsegment", F.lit("  at "), "c_name", F.lit(" "))
    c = b.table(spark, sf_dir, "customer").withColumn("t", K.parse_page_title(title))
    return c.select("c_custkey", "t.job_title", "t.company")
