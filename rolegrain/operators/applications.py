"""Evaluation history, application state machine and assistance requests.

State in, changes in, new state out. ``changed`` marks rows that a writer has
to store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..rules import boards as B

APPLICATION = (
    "job_id", "application_method", "status", "needs_assistance", "assistance_reason", "created_at",
    "last_updated_at",
)


def _open(status: Column) -> Column:
    return status.isin(B.OPEN_STATUSES)


def _tagged(reason: Column, tag: str) -> Column:
    return F.coalesce(reason, F.lit("")).startswith(tag)


def save_evaluations(history: DataFrame, new: DataFrame, key: Sequence[str] = ("run_id", "job_id")) -> DataFrame:
    """History with new evaluations; one row per run and job (and owner), the last new one wins."""
    key = C.owned(key, history, new)
    new = C.last_per_key(new, key)
    kept = history.join(new.select(*key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def _merge(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State joined with change rows, per owner where both name one; ``_had`` and ``_has`` tell the sides apart."""
    key = C.owned(["job_id"], state, changes)
    return state.withColumn("_had", F.lit(True)).join(changes.withColumn("_has", F.lit(True)), key, "full_outer")


def _apply(merged: DataFrame, values: dict[str, Column], changed: Column, now: Column) -> DataFrame:
    """Insert where there was no row, update where ``changed``, keep the rest."""
    is_new = F.col("_had").isNull()
    touched = F.coalesce(changed, F.lit(False)) | is_new
    out = {
        "job_id": F.col("job_id"),
        **{name: F.when(touched, value).otherwise(F.col(name)) for name, value in values.items()},
        "created_at": F.when(is_new, now).otherwise(F.col("created_at")),
        "last_updated_at": F.when(touched, now).otherwise(F.col("last_updated_at")),
    }
    rest = [c for c in merged.columns if c not in out and not c.startswith("_")]
    return merged.select(*[out.get(c, F.col(c)).alias(c) for c in [*out, *rest]], touched.alias("changed"))


def ensure_applications(state: DataFrame, routed: DataFrame, now: Column) -> DataFrame:
    """Application per routed job (``job_id``, ``route``).

    New ones start PENDING.  Open ones follow the route and lose eligibility
    assistance; progressed ones are never touched.
    """
    merged = _merge(state, routed.select(*C.owned(["job_id"], state, routed), F.col("route").alias("_route")))
    is_new, is_open = F.col("_had").isNull(), F.coalesce(_open(F.col("status")), F.lit(False))
    method = F.when(F.col("_route") == "MANUAL_PRIORITY", F.lit("MANUAL")).otherwise(F.lit("AGENT"))
    clears = F.coalesce("needs_assistance", F.lit(False)) & _tagged(F.col("assistance_reason"), B.ELIGIBILITY_TAG)
    moves = ~F.col("application_method").eqNullSafe(method)
    changed = F.col("_has").isNotNull() & is_open & (moves | clears)
    values = {
        "application_method": method,
        "status": F.coalesce("status", F.lit("PENDING")),
        "needs_assistance": F.when(is_new | clears, F.lit(False)).otherwise(F.col("needs_assistance")),
        "assistance_reason": F.when(~is_new & ~clears, F.col("assistance_reason")),
    }
    return _apply(merged, values, changed, now)


def ensure_assistance(state: DataFrame, flagged: DataFrame, now: Column) -> DataFrame:
    """Application in assistance per flagged job (``job_id``, ``reason``), with the same protection."""
    merged = _merge(state, flagged.select(*C.owned(["job_id"], state, flagged), F.col("reason").alias("_reason")))
    tagged = F.concat(F.lit(B.ELIGIBILITY_TAG + " "), F.col("_reason"))
    is_open = F.coalesce(_open(F.col("status")), F.lit(False))
    differs = ~F.coalesce("needs_assistance", F.lit(False)) | ~F.col("assistance_reason").eqNullSafe(tagged)
    values = {
        "application_method": F.coalesce("application_method", F.lit("AGENT")),
        "status": F.coalesce("status", F.lit("PENDING")),
        "needs_assistance": F.lit(True),
        "assistance_reason": tagged,
    }
    return _apply(merged, values, F.col("_has").isNotNull() & is_open & differs, now)


def open_assistance_requests(requests: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Requests plus one per wanted (``application_id``, ``reason``) that no unresolved one covers."""
    key = C.owned(["application_id", "reason"], requests, wanted)
    pending = requests.filter(~F.coalesce("resolved", F.lit(False))).select(*key)
    missing = wanted.select(*key).distinct().join(pending, key, "left_anti")
    added = missing.select(
        *key, F.lit(B.ELIGIBILITY_QUESTION).alias("question"), F.lit(False).alias("resolved"),
        F.lit("ELIGIBILITY").alias("source"), now.alias("updated_at"), F.lit(True).alias("changed"),
    )
    return requests.withColumn("changed", F.lit(False)).unionByName(added, allowMissingColumns=True)


def merge_browser_requests(requests: DataFrame, handoffs: DataFrame, now: Column) -> DataFrame:
    """One unresolved BROWSER request per application.

    ``handoffs`` (``application_id``, ``reason``, ``question``, ``handoff``) is
    unique by application.  The first open request is updated, further ones
    are resolved, and where there is none a new one is added.
    """
    is_open = (F.col("source") == "BROWSER") & ~F.coalesce("resolved", F.lit(False))
    opened, rest = requests.filter(is_open), requests.filter(~F.coalesce(is_open, F.lit(False)))
    earliest = opened.groupBy("application_id").agg(F.min("id").alias("_first"))
    new = handoffs.select(
        "application_id", F.col("reason").alias("_reason"), F.col("question").alias("_question"),
        F.col("handoff").alias("_handoff"), F.lit(True).alias("_has"),
    )
    new = new.join(earliest, "application_id", "left")
    merged = opened.join(new, "application_id", "left").unionByName(new.filter(F.col("_first").isNull()), allowMissingColumns=True)
    has = F.coalesce("_has", F.lit(False))
    insert = has & F.col("_first").isNull()
    first = has & (insert | (F.col("id") == F.col("_first")))
    extra = has & (F.col("id") > F.col("_first"))
    differs = (
        ~F.col("reason").eqNullSafe(F.col("_reason")) | ~F.col("question").eqNullSafe(F.col("_question"))
        | ~F.col("handoff").eqNullSafe(F.col("_handoff")) | ~F.col("handoff_version").eqNullSafe(F.lit(1))
    )
    changed = extra | (first & (insert | differs))
    values = {
        "reason": F.when(first, F.col("_reason")).otherwise(F.col("reason")),
        "question": F.when(first, F.col("_question")).otherwise(F.col("question")),
        "handoff": F.when(first, F.col("_handoff")).otherwise(F.col("handoff")),
        "handoff_version": F.when(first, F.lit(1)).otherwise(F.col("handoff_version")),
        "source": F.lit("BROWSER"),
        "resolved": F.when(extra, F.lit(True)).otherwise(F.coalesce("resolved", F.lit(False))),
        "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
    }
    out = merged.select(
        *[values.get(c, F.col(c)).alias(c) for c in requests.columns], changed.alias("changed")
    )
    return out.unionByName(rest.withColumn("changed", F.lit(False)))


def apply_handoffs(state: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Handoff outcomes (``job_id``, ``route``, ``reason``) into applications.

    NEEDS_ASSISTANCE sets assistance but never overwrites another stage's
    reason; AGENT_CONTINUE clears only this stage's own.
    """
    merged = _merge(state, outcomes.select("job_id", F.col("route").alias("_route"), F.col("reason").alias("_reason")))
    is_new = F.col("_had").isNull()
    is_open = F.coalesce(_open(F.col("status")), F.lit(False))
    needs, asks = F.coalesce("needs_assistance", F.lit(False)), F.col("_route") == "NEEDS_ASSISTANCE"
    own = _tagged(F.col("assistance_reason"), B.BROWSER_TAG)
    free = (F.coalesce("assistance_reason", F.lit("")) == "") | own
    clears = ~asks & needs & own
    writes = free & ~F.col("assistance_reason").eqNullSafe(F.col("_reason"))
    changed = F.col("_has").isNotNull() & is_open & F.when(asks, ~needs | writes).otherwise(clears)
    values = {
        "application_method": F.coalesce("application_method", F.lit("AGENT")),
        "status": F.coalesce("status", F.lit("PENDING")),
        "needs_assistance": F.when(asks, F.lit(True)).when(is_new | clears, F.lit(False)).otherwise(needs),
        "assistance_reason": F.when(asks & (is_new | free), F.col("_reason")).when(
            ~clears, F.col("assistance_reason")
        ),
    }
    return _apply(merged, values, changed, now)


def resolve_browser_requests(requests: DataFrame, continued: DataFrame, now: Column) -> DataFrame:
    """Resolve open BROWSER requests of the given ``application_id``s; others stay."""
    done = continued.select("application_id").distinct().withColumn("_done", F.lit(True))
    marked = requests.join(done, "application_id", "left").withColumn(
        "changed",
        F.coalesce((F.col("source") == "BROWSER") & ~F.coalesce("resolved", F.lit(False)) & F.col("_done"), F.lit(False)),
    )
    return marked.withColumns({
        "resolved": F.when(F.col("changed"), F.lit(True)).otherwise(F.col("resolved")),
        "updated_at": F.when(F.col("changed"), now).otherwise(F.col("updated_at")),
    }).select(*requests.columns, "changed")


def block_reason(route: Column, active: Column, application: Column, has_file: Column) -> Column:
    """First reason why a job may not be processed, null when it may.

    ``application`` is the application struct or null.
    """
    needs = F.coalesce(application["needs_assistance"], F.lit(False))
    return F.coalesce(
        F.when(~F.coalesce(active, F.lit(True)), F.lit("INACTIVE")),
        F.when(~F.coalesce(route == "AGENT_APPLY", F.lit(False)), F.lit("ROUTE")),
        F.when(application.isNull(), F.lit("NO_APPLICATION")),
        F.when(~application["application_method"].eqNullSafe(F.lit("AGENT")), F.lit("METHOD")),
        F.when(~F.coalesce(_open(application["status"]), F.lit(False)), F.lit("STATUS")),
        F.when(needs & ~_tagged(application["assistance_reason"], B.BROWSER_TAG), F.lit("OTHER_ASSISTANCE")),
        F.when(~F.coalesce(has_file, F.lit(False)), F.lit("NO_PROFILE_FILE")),
    )


def execution_guard(jobs: DataFrame, latest_evaluations: DataFrame, applications: DataFrame) -> DataFrame:
    """``block_reason`` of every job from its latest evaluation and its application."""
    evaluated = latest_evaluations.select("job_id", "route", "selected_resume_file")
    applied = applications.select(
        "job_id",
        F.struct("application_method", "status", "needs_assistance", "assistance_reason").alias("_application"),
    )
    joined = jobs.join(evaluated, "job_id", "left").join(applied, "job_id", "left")
    file_known = F.coalesce(F.col("selected_resume_file"), F.lit("")) != ""
    return joined.withColumn(
        "block_reason", block_reason(F.col("route"), F.col("is_active"), F.col("_application"), file_known)
    ).drop("_application")


def mark_ready(state: DataFrame, ready: DataFrame, now: Column) -> DataFrame:
    """PENDING applications of ready jobs become IN_PROGRESS; ``refused`` marks ones already beyond."""
    marked = state.join(ready.select("job_id").distinct().withColumn("_ready", F.lit(True)), "job_id", "left")
    is_ready = F.coalesce("_ready", F.lit(False))
    changed = is_ready & (F.col("status") == "PENDING")
    return marked.withColumns({
        "refused": is_ready & ~F.coalesce(_open(F.col("status")), F.lit(False)),
        "changed": changed,
        "last_updated_at": F.when(changed, now).otherwise(F.col("last_updated_at")),
        "status": F.when(changed, F.lit("IN_PROGRESS")).otherwise(F.col("status")),
    }).drop("_ready")


def latest_changes(changes: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last change per key."""
    return C.first_by_rank(changes, key, order)


def change_statuses(state: DataFrame, changes: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """Apply a feed of (``job_id``, ``status``, ``changed_at``): the last one wins, APPLIED stamps ``applied_at``.

    ``applied_at`` is the time of the last APPLIED in the feed, whatever came behind it.
    """
    last = latest_changes(changes, ["job_id"], order or [F.desc("changed_at"), F.desc("status")])
    applied = changes.filter(F.col("status") == "APPLIED").groupBy("job_id").agg(F.max("changed_at").alias("_applied"))
    new = last.select("job_id", F.col("status").alias("_status"), F.col("changed_at").alias("_at"))
    merged = state.join(new, "job_id", "left").join(applied, "job_id", "left")
    return merged.withColumns({
        "applied_at": F.coalesce("_applied", "applied_at"),
        "last_updated_at": F.coalesce("_at", "last_updated_at"),
        "status": F.coalesce("_status", "status"),
        "changed": F.col("_status").isNotNull(),
    }).drop("_status", "_at", "_applied")


def upsert_run_history(history: DataFrame, runs: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Run history with the given runs; one row per ``run_key`` (and owner), the last one wins."""
    key = C.owned(["run_key"], history, runs)
    latest = latest_changes(runs, key, order)
    kept = history.join(latest.select(*key), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)
