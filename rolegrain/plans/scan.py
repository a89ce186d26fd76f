"""The scan: from board snapshots to scored postings and new state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import applications as A
from ..operators import eligibility as G
from ..operators import experience as E
from ..operators import filters as L
from ..operators import lifecycle as J
from ..operators import ranking as K
from ..operators import requirements as Q
from ..operators import similarity as M
from ..operators import text as X
from ..rules import boards as B
from ..session import stored

KEYS = ("board_token", "posting_id")


def mark_stages(postings: DataFrame) -> DataFrame:
    """Role, employment, location and profile of every posting: native rules on short columns."""
    return postings.withColumns({
        "is_role": F.coalesce(L.keep_role(F.col("title")), F.lit(False)),
        "employment": L.classify_employment(F.col("title"), F.col("metadata")),
        "location_status": L.classify_location(F.col("location"), F.col("offices")),
        "job_profile": L.classify_profile(F.col("title")),
    })


def passes_short_rules() -> Column:
    return (
        F.col("is_role") & (F.col("employment.decision") != "REJECT") & (F.col("location_status") == "US")
    )


def annotate(postings: DataFrame, text: str | None = None) -> DataFrame:
    """All stage columns of the funnel in one scan of the postings.

    The long content goes to the HTML reader only for postings that passed the
    short rules; for the others it is null, so they cost nothing and still
    count.  ``text`` names a column with plain text to use instead.
    """
    marked = mark_stages(postings).withColumn("_in", passes_short_rules())
    if text is None:
        marked = marked.withColumn("_content", F.when(F.col("_in"), F.col("content")))
        marked = X.with_parsed_html(marked, "_content").drop("_content")
        marked = marked.withColumn("text", F.col("parsed.text"))
    else:
        marked = marked.withColumn("text", F.when(F.col("_in"), F.col(text)))
    marked = E.with_mentions(marked.withColumn("text", F.coalesce("text", F.lit(""))))
    marked = marked.withColumn("experience_status", E.classify_experience(F.col("mentions")))
    return G.with_eligibility(marked).drop("_in")


def survivors(annotated: DataFrame) -> DataFrame:
    """Postings that go on to eligibility: US, employed, a role, not rejected by experience."""
    return annotated.filter(passes_short_rules() & F.col("experience_status").isin("ACCEPT", "REVIEW"))


def one_row_per_posting(annotated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A posting that a snapshot holds twice is one posting; rows without an id cannot be told apart and all stay."""
    row = F.when(F.col("posting_id").isNull(), F.monotonically_increasing_id())
    return C.last_per_key(annotated.withColumn("_row", row), [*keys, "_row"]).drop("_row")


def score(
    passed: DataFrame, profiles: DataFrame, profile_chunks: DataFrame, posting_chunks: DataFrame,
    keys: Sequence[str] = KEYS, requirements: DataFrame | None = None,
) -> DataFrame:
    """Eligible postings with their requirements and ``semantic``, the raw similarity to every profile.

    ``profiles`` has ``profile``, ``profile_order``, ``filename`` and ``skills`` and serves all owners; the chunk frames carry
    vectors.  A posting without chunks has similarity 0.
    """
    found = Q.extract_requirements(passed, keys) if requirements is None else requirements
    slim = passed.select(*keys, "title", "job_profile", "mentions").join(found, list(keys))
    chunk_keys = [k for k in keys if k in posting_chunks.columns]
    own = posting_chunks.join(passed.select(*chunk_keys).distinct(), chunk_keys, "left_semi")
    return slim.join(M.semantic_by_posting(own, profile_chunks, chunk_keys), chunk_keys, "left")


def raw_similarity(profile: Column) -> Column:
    """Similarity of the row's posting to a profile, 0 where none is known."""
    known = F.map_from_entries(F.col("semantic"))
    return F.coalesce(F.try_element_at(known, profile["profile"]), F.lit(0.0))


def run(
    postings: DataFrame, profiles: DataFrame, profile_chunks: DataFrame, posting_chunks: DataFrame,
    jobs: DataFrame, evaluations: DataFrame, applications: DataFrame, requests: DataFrame,
    run_id: str, now: Column, new_job_id: Column | None = None,
) -> dict[str, DataFrame]:
    """One scan over a full snapshot: funnel frame, best scores and the next version of every table.

    Where postings have an ``owner_id``, every table has one, and owners never meet: it is part of every key and of new job
    ids, which are derived from the natural key, so a repeated run gives the same ids.  Postings without an id are counted in
    the funnel; nothing can be tracked of them.
    """
    for name, table in (("jobs", jobs), ("evaluations", evaluations), ("applications", applications), ("requests", requests)):
        if (C.OWNER in table.columns) != (C.OWNER in postings.columns):
            raise ValueError(f"either postings and {name} both have {C.OWNER}, or none of them")
    keys = C.owned(KEYS, postings)
    owner = [k for k in keys if k == C.OWNER]
    job_id = F.sha2(F.concat_ws("/", *keys), 256) if new_job_id is None else new_job_id
    # Everything below reads the annotated frame: keep it once, without the raw content.
    named = postings.withColumn("posting_id", J.posting_key(F.col("posting_id")))
    annotated = stored(one_row_per_posting(annotate(named).drop("content", "offices", "metadata"), keys))
    passed = survivors(annotated).filter(F.col("posting_id").isNotNull())
    flagged = passed.filter(F.col("eligibility.decision") == "NEEDS_ASSISTANCE")
    eligible = passed.filter(F.col("eligibility.decision") == "PASS")
    ready = score(eligible, profiles, profile_chunks, posting_chunks, keys)
    best = stored(K.with_explanation(K.best_of_profiles(ready, profiles, keys, raw_similarity)).drop("semantic"))

    seen = passed.filter(F.col("eligibility.decision") != "SKIP").select(
        *keys, job_id.alias("job_id"), "company", "title", X.location_display(F.col("location")).alias("location"),
        "url", F.col("job_profile").alias("detected_profile"),
    )
    stale = J.find_stale(jobs, annotated.select(*keys))
    closed = J.sync_lifecycle(jobs, annotated, now, stale).drop("changed")
    known = jobs.select(*keys, F.col("job_id").alias("_old"))
    seen = seen.join(known, keys, "left").withColumn("job_id", F.coalesce("_old", "job_id")).drop("_old")
    next_jobs = J.upsert_postings(closed, seen, now)

    ids = seen.select(*keys, "job_id")
    evaluated = best.join(ids, keys).select(
        *owner, F.lit(run_id).alias("run_id"), "job_id", F.col("final_score").alias("score"), "selection_score", "confidence",
        "route", F.col("profile").alias("selected_resume"), F.col("filename").alias("selected_resume_file"),
        "role_score", "required_score", "preferred_score", "semantic_score", "experience_score", "explanation",
        now.alias("created_at"),
    )
    flagged_jobs = flagged.join(ids, keys).select(*owner, "job_id", F.col("eligibility.reason").alias("reason"))
    routed = A.ensure_applications(applications, evaluated, now).drop("changed")
    next_applications = A.ensure_assistance(routed, flagged_jobs, now).drop("changed").withColumn(
        "application_id", F.coalesce(F.col("application_id").cast("string"), F.col("job_id").cast("string"))
    )
    still_open = next_applications.filter(F.col("status").isin(B.OPEN_STATUSES))
    wanted = still_open.join(flagged_jobs.select(*owner, "job_id"), [*owner, "job_id"], "left_semi").select(
        *owner, "application_id", F.col("assistance_reason").alias("reason")
    )
    return {
        "annotated": annotated, "scored": ready, "best": best, "stale": stale,
        "jobs": next_jobs.drop("changed"), "evaluations": A.save_evaluations(evaluations, evaluated),
        "applications": next_applications,
        "requests": A.open_assistance_requests(requests, wanted, now).drop("changed"),
    }
