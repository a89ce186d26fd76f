"""Recorded application-form fields: grouping, classification, resolution, handoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..rules import boards as B
from ..rules import forms as R
from ..schemas import HANDOFF_ITEM
from ..session import fits

_ITEMS = f"array<{HANDOFF_ITEM}>"
_SLOTS = f"array<struct<stage: int, place: bigint, item: {HANDOFF_ITEM}>>"


def _plain(text: Column) -> Column:
    """Lower case letters and digits, everything else a single blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# --- grouping of raw controls -----------------------------------------------


def _is_technical() -> Column:
    signature = F.lower(F.concat_ws(" ", *[_text(n) for n in ("name", "id", "label", "context_text")]))
    return F.lower(_text("type")).isin(R.SKIPPED_TYPES) | C.contains_any(signature, R.GROUPING_TECHNICAL)


def _group_key() -> Column:
    kind, name, label = F.lower(_text("type")), _text("name"), _plain(F.col("label"))
    number = F.col("index").cast("string")
    purpose_text = _plain(F.concat(_text("label"), F.lit(" "), _text("context_text")))
    purpose = C.ladder(
        [
            (C.contains_any(purpose_text, R.RESUME_GROUP_WORDS), F.lit("resume")),
            (F.contains(purpose_text, F.lit(R.COVER_LETTER)), F.lit("cover_letter")),
        ],
        F.concat(F.lit("unknown_"), number),
    )
    return C.ladder(
        [
            (kind == "file", F.concat(F.lit("file:"), purpose)),
            (kind.isin(R.CHOICE_TYPES) & (name != ""), F.concat(F.lit("group:"), kind, F.lit(":"), name)),
            (name != "", F.concat(F.lit("named:"), name)),
            (label != "", F.concat(F.lit("field:"), label)),
        ],
        F.concat(F.lit("single:"), number),
    )


def group_fields(raw: DataFrame, page: Sequence[str] = ("page_id",)) -> DataFrame:
    """Raw controls to logical fields, one row per (page, field) in order of appearance.

    An unlabeled text control is a helper of the group before it when its
    context and that group's label contain each other, and every unlabeled
    control in between was a helper too.  A control that fails that test is
    a group without label, so none behind it can be a helper: the chain is
    broken once the last run in which a control failed is the current one.
    All windows look at one page, so its controls move once.
    """
    fields = raw.filter(~_is_technical()).withColumn("_key", _group_key())
    may_help = (
        (_plain(F.col("label")) == "") & (_text("name") == "") & (_text("placeholder") == "")
        & F.lower(_text("type")).isin("text", "search")
    )
    order = Window.partitionBy(*page).orderBy("index")
    fields = fields.withColumn("_may_help", may_help)
    fields = fields.withColumn("_label", F.first("label").over(Window.partitionBy(*page, "_key").orderBy("index")))
    fields = fields.withColumns({
        "_run": F.count_if(~F.col("_may_help")).over(order),
        "_before": F.last(
            F.when(~F.col("_may_help"), F.struct(F.col("_key").alias("key"), _plain(F.col("_label")).alias("label"))),
            ignorenulls=True,
        ).over(order),
    })
    label, context = F.col("_before.label"), _plain(F.col("context_text"))
    fits = (label != "") & (context != "") & (F.contains(context, label) | F.contains(label, context))
    fields = fields.withColumn("_fails", F.col("_may_help") & ~F.coalesce(fits, F.lit(False)))
    failed = F.max(F.when(F.col("_fails"), F.col("_run"))).over(order)
    fields = fields.withColumn("_helper", F.col("_may_help") & ~F.coalesce(failed == F.col("_run"), F.lit(False)))
    fields = fields.withColumn("_key", F.when(F.col("_helper"), F.col("_before.key")).otherwise(F.col("_key")))

    kind = F.lower(_text("type"))
    rank = C.ladder([(kind == k, F.lit(v)) for k, v in R.TYPE_PRIORITY.items()], F.lit(0))
    own = ~F.col("_helper")
    grouped = fields.groupBy(*page, "_key").agg(
        F.min("index").alias("first_index"),
        *[F.min_by(n, F.when(own, F.col("index"))).alias(n) for n in ("name", "id", "label", "placeholder")],
        F.min_by(F.struct("type", "tag"), F.when(own, F.struct((-rank).alias("r"), "index"))).alias("_kind"),
        F.min_by("type", F.when(own, F.col("index"))).alias("_first_type"),
        F.min_by(
            "context_text", F.when(own, F.struct((-F.length(_text("context_text"))).alias("n"), "index"))
        ).alias("context_text"),
        F.bool_or(own & F.coalesce("required", F.lit(False))).alias("required"),
        F.array_sort(F.collect_list(F.struct("index", kind.alias("kind"), own.alias("own"), "options", "value"))).alias("_all"),
    )
    owned = F.filter("_all", lambda f: f["own"])
    options = F.transform(owned, lambda f: F.coalesce(f["options"], C.empty_strings()))
    first = F.coalesce(F.get(options, F.lit(0)), C.empty_strings())
    later = F.array_distinct(F.flatten(F.slice(options, 2, F.greatest(F.size(options) - 1, F.lit(0)))))
    added = F.filter(F.array_except(later, first), lambda o: F.coalesce(o, F.lit("")) != "")
    kinds = F.array_distinct(F.transform("_all", lambda f: f["kind"]))
    return grouped.select(
        *page, F.col("_kind.tag").alias("tag"),
        F.when(F.lower(F.coalesce("_kind.type", F.lit(""))) == F.lower(F.coalesce("_first_type", F.lit(""))), F.col("_first_type"))
        .otherwise(F.lower("_kind.type")).alias("type"),
        "name", "id", "label", "placeholder", "context_text", "required",
        F.concat(first, added).alias("options"),
        F.transform("_all", lambda f: F.coalesce(f["value"], F.lit(""))).alias("field_values"),
        F.transform("_all", lambda f: f["index"]).alias("dom_indices"), kinds.alias("source_types"),
        F.size("_all").alias("source_count"), "first_index",
    )


# --- classification ---------------------------------------------------------

PROFILE_VALUE, FIXED_ANSWER, RESUME_FILE = "PROFILE_VALUE", "FIXED_ANSWER", "RESUME_FILE"
NEEDS_ASSISTANCE, IGNORE = "NEEDS_ASSISTANCE", "IGNORE"


def normalize_field_text(text: Column) -> Column:
    straight = F.translate(F.coalesce(text, F.lit("")), "’‘“”", "''\"\"")
    return F.lower(C.squash(straight))


def _decision(category: str, action: str, reason: str, key: str | None = None, answer: str | None = None) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(action).alias("action"), F.lit(reason).alias("reason"),
        F.lit(key).cast("string").alias("answer_key"), F.lit(answer).cast("string").alias("fixed_answer"),
    )


def _fixed(category: str, key: str, reason: str) -> Column:
    return _decision(category, FIXED_ANSWER, reason, key, R.FIXED_ANSWERS[key])


def _human(category: str, reason: str) -> Column:
    return _decision(category, NEEDS_ASSISTANCE, reason)


def with_decision(fields: DataFrame, into: str = "decision") -> DataFrame:
    """Classify fields from ``label``, ``type``, ``name``, ``placeholder`` and ``context_text``.

    The surrounding context counts only where the field's own wording says
    nothing.  The first rule that holds wins; unknown questions go to a human.
    """
    fields = fields.withColumns({
        "_label": normalize_field_text(F.col("label")), "_type": normalize_field_text(F.col("type")),
        "_name": normalize_field_text(F.col("name")), "_hint": normalize_field_text(F.col("placeholder")),
        "_context": normalize_field_text(F.col("context_text")),
    })

    def joined(*names: str) -> Column:
        return F.concat_ws(" ", *[F.nullif(F.col(n), F.lit("")) for n in names])

    fields = fields.withColumn("_own", joined("_label", "_name", "_hint"))
    fields = fields.withColumn("_everything", joined("_own", "_context"))
    own, everything, kind = F.col("_own"), F.col("_everything"), F.col("_type")
    generic = (own == "") | own.isin(R.GENERIC_LABELS)
    fields = fields.withColumn("_said", F.when(generic, everything).otherwise(own))
    said = F.col("_said")

    both = C.whole_word(said, "now") & C.whole_word(said, "future")
    fields = fields.withColumns({
        "_auth": C.contains_any(said, R.AUTHORIZATION), "_sponsor": C.contains_any(said, R.SPONSORSHIP),
        "_future": C.contains_any(said, R.FUTURE), "_current": C.contains_any(said, R.CURRENT),
        "_either": C.contains_any(said, R.NOW_OR_FUTURE) | both,
        "_without": C.contains_any(said, R.WITHOUT_SPONSORSHIP),
        "_resume": C.contains_any(everything, R.RESUME_WORDS),
        "_cover": F.contains(everything, F.lit(R.COVER_LETTER)),
    })
    auth, sponsor, future, current, either, without, resume, cover = (
        F.col(n) for n in ("_auth", "_sponsor", "_future", "_current", "_either", "_without", "_resume", "_cover")
    )
    file = kind == "file"
    mixed = auth & sponsor & without
    rungs = [
        (kind.isin(R.SKIPPED_TYPES) | C.contains_any(said, R.CLASSIFIER_TECHNICAL),
         _decision("TECHNICAL_CONTROL", IGNORE, "Technical/browser-verification control.")),
        (file & resume & ~cover,
         _decision("RESUME", RESUME_FILE, "Resume upload can use the resume already selected by the matcher.",
                   "SELECTED_RESUME_FILE")),
        (file & cover & ~resume, _human("COVER_LETTER_UPLOAD", "Cover-letter content is intentionally human-reviewed.")),
        (file, _human("UNKNOWN_FILE_UPLOAD", "File-upload purpose is not confidently recognized.")),
        (mixed & (future | either),
         _fixed("WORK_AUTH_WITHOUT_SPONSORSHIP_FUTURE", "WORK_AUTH_WITHOUT_SPONSORSHIP_FUTURE",
                "Question requires continuing work authorization without future sponsorship.")),
        (mixed & current & ~future,
         _fixed("WORK_AUTH_WITHOUT_SPONSORSHIP_NOW", "WORK_AUTH_WITHOUT_SPONSORSHIP_NOW",
                "Question is explicitly limited to current/start work authorization.")),
        (mixed, _human("WORK_AUTH_SPONSORSHIP_AMBIGUOUS",
                       "Question mixes work authorization and sponsorship without a clear time horizon.")),
        (sponsor & either,
         _fixed("SPONSORSHIP_NOW_OR_FUTURE", "SPONSORSHIP_NOW_OR_FUTURE",
                "Question asks whether sponsorship is needed now OR in the future.")),
        (sponsor & future & ~current,
         _fixed("SPONSORSHIP_FUTURE", "SPONSORSHIP_FUTURE", "Question explicitly asks about future sponsorship.")),
        (sponsor & current & ~future,
         _fixed("SPONSORSHIP_NOW", "SPONSORSHIP_NOW", "Question explicitly asks about current/start sponsorship.")),
        (sponsor, _human("SPONSORSHIP_AMBIGUOUS",
                         "Sponsorship is mentioned without enough temporal wording to choose a safe answer.")),
        (auth, _fixed("WORK_AUTHORIZATION_US", "WORK_AUTHORIZED_US",
                      "Direct U.S. work-authorization question without sponsorship wording.")),
    ]
    for category, phrases, whole, reason in R.SENSITIVE_QUESTIONS:
        hit = C.contains_any(said, phrases)
        for word in whole:
            hit = hit | C.whole_word(said, word)
        rungs.append((hit, _human(category, reason)))
    for category, key, phrases, whole, without_any, labels, control, reason in R.PROFILE_FIELDS:
        hit = C.contains_any(own, phrases) if phrases else F.lit(False)
        for word in whole:
            hit = hit | C.whole_word(own, word)
        if without_any:
            hit = hit & ~C.contains_any(own, without_any)
        if labels:
            exact = F.col("_label").isin(labels)
            hit = hit | ((exact & ~kind.isin(R.CHOICE_TYPES)) if category == "FULL_NAME" else exact)
        if control:
            hit = hit | (kind == control)
        rungs.append((hit, _human(category, reason) if key is None else _decision(category, PROFILE_VALUE, reason, key)))
    for category, phrases, reason in R.HUMAN_QUESTIONS:
        rungs.append((C.contains_any(said, phrases), _human(category, reason)))
    return C.pinned(fields, {into: C.ladder(rungs, _human(*R.UNKNOWN_FIELD))}).drop(
        "_label", "_type", "_name", "_hint", "_context", "_own", "_everything", "_said", "_auth", "_sponsor",
        "_future", "_current", "_either", "_without", "_resume", "_cover",
    )


# --- resolution -------------------------------------------------------------


def profile_facts(facts: DataFrame) -> DataFrame:
    """Facts (``profile_id``, ``answer_key``, ``present``, ``bool_value``) folded to one row per profile.

    Only the known keys are kept, so the array is bounded.  A full name is
    present when both of its parts are; values themselves are never read.
    """
    known = facts.filter(F.col("answer_key").isin(sorted({*R.PROFILE_KEYS, *R.AUTHORIZATION_FACTS})))

    def fact(key: str) -> Column:
        return F.bool_or(F.when(F.col("answer_key") == key, F.col("bool_value")))

    authorized, now, future = R.AUTHORIZATION_FACTS
    folded = known.groupBy("profile_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("present"), F.col("answer_key")))).alias("present_keys"),
        fact(authorized).alias("authorized"), fact(now).alias("sponsor_now"), fact(future).alias("sponsor_future"),
    )
    full = F.array_contains("present_keys", "FIRST_NAME") & F.array_contains("present_keys", "LAST_NAME")
    return folded.withColumn(
        "present_keys", F.when(full, F.array_append("present_keys", F.lit("FULL_NAME"))).otherwise(F.col("present_keys"))
    )


def policy_answer(key: Column, authorized: Column, now: Column, future: Column) -> Column:
    """Yes or No from the work-authorization facts; null while a needed fact is unknown."""

    def needs(*facts: Column) -> Column:
        known = F.lit(True)
        for fact in facts:
            known = known & fact.isNotNull()
        return known

    value = C.ladder(
        [
            (key == "WORK_AUTHORIZED_US", authorized),
            (key == "SPONSORSHIP_NOW", now),
            (key == "SPONSORSHIP_FUTURE", future),
            (key == "SPONSORSHIP_NOW_OR_FUTURE", F.when(needs(now, future), now | future)),
            (key == "WORK_AUTH_WITHOUT_SPONSORSHIP_NOW", F.when(needs(authorized, now), authorized & ~now)),
            (key == "WORK_AUTH_WITHOUT_SPONSORSHIP_FUTURE",
             F.when(needs(authorized, now, future), authorized & ~now & ~future)),
        ],
        F.lit(None).cast("boolean"),
    )
    return F.when(value, F.lit("Yes")).when(~value, F.lit("No"))


def resolve_fields(fields: DataFrame, facts: DataFrame, resume_present: str = "resume_present") -> DataFrame:
    """Status of every classified field for the profile of its page.

    ``fields`` has ``profile_id``, ``required``, ``decision`` and a flag
    column saying whether the selected profile file exists.  Adds ``status``,
    ``source``, ``display_answer`` (policy answers only), ``value_present``
    and ``value_preview`` (never for private keys).
    """
    # A few profiles serve very many fields, so fields are not laid out by profile unless the list is long.
    known = profile_facts(facts)
    joined = fields.join(F.broadcast(known) if fits(known) else known, "profile_id", "left")
    action, key = F.col("decision.action"), F.coalesce("decision.answer_key", F.lit(""))
    must = F.coalesce("required", F.lit(False))
    answer = policy_answer(key, F.col("authorized"), F.col("sponsor_now"), F.col("sponsor_future"))
    hint = F.col("decision.fixed_answer")
    helped = F.when(must, F.lit("REQUIRED_ASSISTANCE")).otherwise(F.lit("OPTIONAL_ASSISTANCE"))
    missing = F.when(must, F.lit("MISSING_REQUIRED_PROFILE")).otherwise(F.lit("OPTIONAL_MISSING"))
    present = F.coalesce(F.array_contains("present_keys", key), F.lit(False))
    joined = joined.withColumn("_answer", F.when(action == FIXED_ANSWER, answer)).withColumn("_present", present)
    answer, present = F.col("_answer"), F.col("_present")
    ready = F.lit(R.READY)
    mismatch = hint.isNotNull() & (F.lower(C.strip(hint)) != F.lower(answer))
    status = C.ladder(
        [
            (action == IGNORE, F.lit("IGNORED")),
            (action == NEEDS_ASSISTANCE, helped),
            (action == RESUME_FILE, F.when(F.coalesce(resume_present, F.lit(False)), ready).otherwise(F.lit("MISSING_RESUME"))),
            (action == PROFILE_VALUE, F.when(present, ready).otherwise(missing)),
            (action == FIXED_ANSWER,
             F.when(answer.isNull(), helped).when(mismatch, F.lit("POLICY_MISMATCH")).otherwise(ready)),
        ],
        helped,
    )
    source = C.ladder(
        [
            (action == IGNORE, F.lit("none")), (action == NEEDS_ASSISTANCE, F.lit("human")),
            (action == RESUME_FILE, F.lit("matcher")), (action == PROFILE_VALUE, F.lit("profile")),
            ((action == FIXED_ANSWER) & (key == ""), F.lit("policy")), (action == FIXED_ANSWER, F.lit("profile-policy")),
        ],
        F.lit("unknown"),
    )
    resolved = C.pinned(joined, {
        "label": F.coalesce(F.nullif("label", F.lit("")), F.lit("[unlabeled field]")),
        "required": must | (action == RESUME_FILE), "status": status, "source": source,
        "display_answer": F.when(key.isin(R.POLICY_KEYS), answer),
    })
    has_value = (F.col("status") == R.READY) | answer.isNotNull()
    preview = F.when(~F.col("value_present"), F.lit(None)).when(key.isin(R.PREVIEW_HIDDEN), F.lit("<redacted>"))
    return resolved.withColumn("value_present", has_value).withColumn(
        "value_preview", preview.otherwise(F.coalesce(answer, F.lit("<present>")))
    ).drop("_answer", "_present", "present_keys", "authorized", "sponsor_now", "sponsor_future")


def application_rollup(resolved: DataFrame, page: Sequence[str] = ("page_id",)) -> DataFrame:
    """Field counts per page and whether nothing required is open."""
    status = F.col("status")
    blocking = F.count_if(status.isin(R.BLOCKING))
    return resolved.groupBy(*page).agg(
        F.count("*").alias("total_fields"), F.count_if(status == R.READY).alias("ready_fields"),
        blocking.alias("required_unresolved"), F.count_if(status.isin(R.OPTIONAL)).alias("optional_unresolved"),
        F.count_if(status == "POLICY_MISMATCH").alias("policy_mismatches"),
        F.count_if(status == "MISSING_RESUME").alias("missing_resume"),
        (blocking == 0).alias("ready_for_submission"),
        F.lit(False).alias("browser_modified"), F.lit(False).alias("submit_attempted"),
    )


# --- handoff ----------------------------------------------------------------


def parse_page_title(title: Column) -> Column:
    """``struct<job_title, company>`` of a form page title, null parts where it does not fit."""
    regex = C.java(R.PAGE_TITLE)

    def part(number: int) -> Column:
        return F.nullif(C.strip(F.regexp_extract(title, regex, number)), F.lit(""))

    return F.struct(part(1).alias("job_title"), part(2).alias("company"))


def _item(label, category, required, status, source, key, display, reason) -> Column:
    return F.struct(
        label.alias("label"), category.alias("category"), required.alias("required"), status.alias("status"),
        source.alias("source"), key.alias("answer_key"), display.alias("display_answer"), reason.alias("reason"),
    ).cast(HANDOFF_ITEM)


def build_handoffs(
    pages: DataFrame, resolved: DataFrame, fill_results: DataFrame, page: Sequence[str] = ("page_id",)
) -> DataFrame:
    """One handoff packet per page.

    ``pages`` has the page columns (``requested_url``, ``page_title``,
    ``company``, ``job_title``, ``resume_path``) and the fill summary
    (``challenge_detected``, ``challenge_reasons``, ``submit_attempts_blocked``,
    ``nonready_mutation_detected``, ``nonready_mutation_reason``).  A failed
    fill takes its answer key out of the ready items.  Items of one form stay
    together; a form is a bounded group.  Fields, fills and pages only meet
    by page, so frames that lie by page are not moved.
    """
    none = F.lit(None).cast("string")
    failed = fill_results.filter(F.col("status") == "FILL_FAILED")
    item = _item(
        F.col("label"), F.col("decision.category"), F.col("required"), F.col("status"), F.col("source"),
        F.col("decision.answer_key"), F.col("display_answer"), F.col("decision.reason"),
    )
    is_ready = F.col("status") == R.READY
    slot = F.struct(F.lit(0).alias("stage"), F.col("first_index").cast("long").alias("place"), item.alias("item"))
    failure = _item(
        F.coalesce(F.nullif("label", F.lit("")), F.lit("[unlabeled field]")),
        F.coalesce(F.nullif("category", F.lit("")), F.lit("BROWSER_FILL_FAILURE")),
        F.coalesce("required", F.lit(False)), F.lit("FILL_FAILED"),
        F.coalesce(F.nullif("source", F.lit("")), F.lit("browser")), F.col("answer_key"), none,
        F.coalesce(F.nullif("reason", F.lit("")), F.lit("Deterministic browser fill failed.")),
    )
    failure_slot = F.struct(F.lit(1).alias("stage"), F.col("place").cast("long").alias("place"), failure.alias("item"))

    def items(*slots: Column) -> Column:
        return F.transform(F.array_sort(F.concat(*slots)), lambda s: s["item"])

    of_fields = resolved.groupBy(*page).agg(
        F.collect_list(F.when(is_ready, slot)).alias("_ready"), F.collect_list(F.when(~is_ready, slot)).alias("_open"),
        F.count_if(F.col("status") == "POLICY_MISMATCH").alias("policy_mismatches"),
        F.count_if(F.col("status") == "MISSING_RESUME").alias("missing_resume"),
        F.count_if(F.col("status") == "FILL_FAILED").alias("_given"),
    )
    of_fills = failed.groupBy(*page).agg(
        F.collect_list(failure_slot).alias("_failed"), F.collect_set(F.nullif("answer_key", F.lit(""))).alias("_keys"),
        F.count("*").alias("_failures"),
    )
    packet = pages.join(of_fields, list(page), "left").join(of_fills, list(page), "left")
    keys = F.coalesce("_keys", C.empty_strings())
    parsed = parse_page_title(F.col("page_title"))
    ready, opened, fallen = (F.coalesce(n, F.array().cast(_SLOTS)) for n in ("_ready", "_open", "_failed"))
    packet = packet.withColumns({
        "deterministic_ready": items(F.filter(ready, lambda s: ~F.coalesce(F.array_contains(keys, s["item"]["answer_key"]), F.lit(False)))),
        "human_assistance": items(opened, fallen),
    })
    blocking = F.size(F.filter("human_assistance", lambda i: i["required"]))
    zero, no = F.lit(0), F.lit(False)
    challenge = F.coalesce("challenge_detected", no)
    mutated = F.coalesce("nonready_mutation_detected", no)
    failures = F.coalesce("_given", zero) + F.coalesce("_failures", zero)
    reasons = C.compact(
        F.when(challenge, F.lit("Page challenge / CAPTCHA detected.")),
        F.when(failures > 0, F.concat(failures.cast("string"), F.lit(" deterministic browser fill(s) failed."))),
        F.when(F.coalesce("submit_attempts_blocked", zero) > 0,
               F.lit("A form submission attempt was blocked by the browser safety guard.")),
        F.when(blocking > 0, F.concat(blocking.cast("string"), F.lit(" required field(s) need human resolution."))),
        F.when(F.coalesce("policy_mismatches", zero) > 0, F.lit("Policy mismatch detected.")),
        F.when(F.coalesce("missing_resume", zero) > 0, F.lit("Selected resume is missing.")),
        F.when(mutated, F.lit("Browser contamination safety violation detected.")),
    )
    return packet.select(
        *page, F.lit(R.PACKET_VERSION).alias("packet_version"),
        F.coalesce(F.nullif("company", F.lit("")), parsed["company"]).alias("company"),
        F.coalesce(F.nullif("job_title", F.lit("")), parsed["job_title"]).alias("job_title"),
        "requested_url", "page_title", base_name(F.col("resume_path")).alias("selected_resume"),
        F.when(F.size(reasons) > 0, F.lit("NEEDS_ASSISTANCE")).otherwise(F.lit("AGENT_CONTINUE")).alias("route"),
        reasons.alias("route_reasons"),
        F.struct(
            challenge.alias("detected"),
            F.filter(F.coalesce("challenge_reasons", C.empty_strings()), lambda r: C.strip(r) != "").alias("reasons"),
        ).alias("challenge"),
        F.struct(
            no.alias("application_submitted"), no.alias("submit_clicked_by_agent"),
            mutated.alias("nonready_mutation_detected"),
            F.coalesce("nonready_mutation_reason", F.lit("")).alias("nonready_mutation_reason"),
        ).alias("browser_safety"),
        "deterministic_ready", "human_assistance",
        F.struct(
            F.size("deterministic_ready").alias("ready_count"), F.size("human_assistance").alias("human_assistance_count"),
            blocking.alias("required_human_count"), challenge.alias("challenge_detected"),
            F.coalesce(F.col("policy_mismatches"), zero).cast("int").alias("policy_mismatches"),
            F.coalesce(F.col("missing_resume"), zero).cast("int").alias("missing_resume"),
        ).alias("summary"),
    )


def base_name(path: Column) -> Column:
    """Last part of a path, without trailing slashes."""
    return F.nullif(F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]+$", 0), F.lit(""))


def safe_display_answer(key: Column, answer: Column) -> Column:
    """Answer text only for policy keys and only as plain yes / no."""
    text = C.safe_text(answer, 32)
    return F.when(key.isin(R.POLICY_KEYS) & text.isin(R.DISPLAY_ANSWERS), text)


def safe_item(item: Column) -> Column:
    key = C.safe_text(item["answer_key"])
    return _item(
        C.safe_text(item["label"]), C.safe_text(item["category"]),
        F.coalesce(item["required"], F.lit(False)), C.safe_text(item["status"]), C.safe_text(item["source"]),
        key, safe_display_answer(key, item["display_answer"]), C.safe_text(item["reason"]),
    )


def handoff_problem() -> Column:
    """Why a packet may not be stored, null when it may."""
    return F.coalesce(
        F.when(~F.col("packet_version").eqNullSafe(F.lit(R.PACKET_VERSION)), F.lit("UNSUPPORTED_VERSION")),
        F.when(~F.coalesce(C.safe_text(F.col("route")).isin(R.PACKET_ROUTES), F.lit(False)), F.lit("UNSUPPORTED_ROUTE")),
    )


def sanitize_handoffs(packets: DataFrame, page: Sequence[str] = ("page_id",), max_items: int | None = None) -> DataFrame:
    """Storable packets: known fields only, paths cut to names, counts over all items.

    A store that bounds its rows passes ``max_items``; ``items_left_out`` then says how many were not kept.
    """
    no = F.lit(False)

    def safe(name: str) -> Column:
        return F.transform(F.coalesce(name, F.array().cast(_ITEMS)), safe_item)

    def bounded(name: str) -> Column:
        return F.col(name) if max_items is None else F.slice(name, 1, max_items)

    kept = packets.filter(handoff_problem().isNull()).withColumns({
        "_ready": safe("deterministic_ready"), "_human": safe("human_assistance"),
    })
    detected = F.coalesce("challenge.detected", no)
    safety = F.col("browser_safety")
    return kept.select(
        *page, F.lit(R.PACKET_VERSION).alias("packet_version"), C.safe_text(F.col("company")).alias("company"),
        C.safe_text(F.col("job_title")).alias("job_title"),
        C.safe_text(F.col("requested_url")).alias("requested_url"),
        C.safe_text(F.col("page_title")).alias("page_title"),
        base_name(C.safe_text(F.col("selected_resume"))).alias("selected_resume"),
        C.safe_text(F.col("route")).alias("route"), C.safe_list(F.col("route_reasons")).alias("route_reasons"),
        F.struct(detected.alias("detected"), C.safe_list(F.col("challenge.reasons")).alias("reasons")).alias("challenge"),
        F.struct(
            F.coalesce(safety["application_submitted"], no).alias("application_submitted"),
            F.coalesce(safety["submit_clicked_by_agent"], no).alias("submit_clicked_by_agent"),
            F.coalesce(safety["nonready_mutation_detected"], no).alias("nonready_mutation_detected"),
            C.safe_text(safety["nonready_mutation_reason"]).alias("nonready_mutation_reason"),
        ).alias("browser_safety"),
        bounded("_ready").alias("deterministic_ready"), bounded("_human").alias("human_assistance"),
        (F.size("_ready") - F.size(bounded("_ready")) + F.size("_human") - F.size(bounded("_human"))).alias("items_left_out"),
        F.struct(
            F.size("_ready").alias("ready_count"), F.size("_human").alias("human_assistance_count"),
            F.size(F.filter("_human", lambda i: i["required"])).alias("required_human_count"),
            detected.alias("challenge_detected"),
            F.greatest(F.coalesce("summary.policy_mismatches", F.lit(0)), F.lit(0)).alias("policy_mismatches"),
            F.greatest(F.coalesce("summary.missing_resume", F.lit(0)), F.lit(0)).alias("missing_resume"),
        ).alias("summary"),
    )


def read_packets(requests: DataFrame) -> DataFrame:
    """Open browser requests whose stored packet can be shown, with its items, counts and shown answers.

    Another source, a resolved request, another version or a missing packet leave nothing to show.  Items that are null are
    dropped.  A stored count is rounded half up; a missing or negative one is replaced by the number of items.
    """
    stored = requests.filter(
        (F.col("source") == "BROWSER") & ~F.coalesce("resolved", F.lit(False)) & (F.col("handoff_version") == R.PACKET_VERSION)
        & F.col("handoff").isNotNull()
    )

    def items(name: str) -> Column:
        kept = F.filter(F.coalesce(F.col("handoff")[name], F.array().cast(_ITEMS)), lambda i: i.isNotNull())
        return F.transform(kept, lambda i: i.withField("display_answer", safe_display_answer(i["answer_key"], i["display_answer"])))

    def count(name: str, fallback: Column) -> Column:
        number = F.col("handoff.summary")[name].try_cast("double")
        return F.when(number >= 0, F.floor(number + F.lit(0.5))).otherwise(fallback.cast("bigint"))

    shown = stored.withColumns({"ready_items": items("deterministic_ready"), "human_items": items("human_assistance")})
    return shown.withColumns({
        "ready_count": count("ready_count", F.size("ready_items")),
        "required_human_count": count("required_human_count", F.size(F.filter("human_items", lambda i: F.coalesce(i["required"], F.lit(False))))),
    })


def assistance_reason(summary: Column, safety: Column) -> Column:
    """Compact reason, for instance "BROWSER: CAPTCHA + REQUIRED_QUESTIONS=2"."""
    count = summary["required_human_count"]
    tokens = C.compact(
        F.when(summary["challenge_detected"], F.lit("CAPTCHA")),
        F.when(count > 0, F.concat(F.lit("REQUIRED_QUESTIONS="), count.cast("string"))),
        F.when(summary["policy_mismatches"] > 0, F.lit("POLICY_MISMATCH")),
        F.when(summary["missing_resume"] > 0, F.lit("MISSING_RESUME")),
        F.when(safety["nonready_mutation_detected"], F.lit("SAFETY_VIOLATION")),
    )
    listed = F.when(F.size(tokens) > 0, F.array_join(tokens, " + ")).otherwise(F.lit("HUMAN_REVIEW"))
    return F.concat(F.lit(B.BROWSER_TAG + " "), listed)


def assistance_question(summary: Column) -> Column:
    needed, ready = summary["required_human_count"], summary["ready_count"]
    parts = C.compact(
        F.when(summary["challenge_detected"], F.lit("CAPTCHA detected")),
        F.when(needed > 0, F.concat(needed.cast("string"), F.lit(" required field(s) need review"))),
        F.when(ready > 0, F.concat(ready.cast("string"), F.lit(" deterministic field(s) are ready"))),
    )
    said = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.lit("browser handoff needs review"))
    return F.concat(F.lit("Browser application handoff: "), said, F.lit("."))
