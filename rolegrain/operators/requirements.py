"""Skills and requirement structure of posting text.

Lines are rows.  The reading state of a page (current section, continuation
lines, pending "at least N of") is expressed with windows over the lines of
one posting; what a single line says is expressed with array functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.matcher import Matcher, matches, matches_each
from ..rules import skills as S
from ..schemas import GROUP
from . import text as X

KEYS = ("board_token", "posting_id")
_GROUPS = f"array<{GROUP}>"


# --- skills -----------------------------------------------------------------


def _skill_patterns() -> dict[str, list[str]]:
    packs = {skill: list(patterns) for skill, patterns in S.SKILLS.items()}
    packs["Go"] = packs["Go"] + S.GO_PHRASES
    return dict(sorted(packs.items()))


def _line_matcher() -> Matcher:
    """Skills, those directly followed by "(is) preferred", and cues of a line."""
    tail = r"\s*(?:is\s+)?preferred\b"
    preferred = {skill: f"(?:{'|'.join(pack)}){tail}" for skill, pack in {**S.SKILLS, "Go": [S.GO_WORD]}.items()}
    cues = {"boilerplate": S.BOILERPLATE, "preferred": S.PREFERRED_LINES, "required": S.REQUIRED_LINES, "continues": S.CONTINUATIONS}
    return Matcher({"skills": _skill_patterns(), "cues": cues}, {"preferred": ("skills", "preferred", preferred)})


_LINE, _SKILLS = matches(_line_matcher()), Matcher({"skills": _skill_patterns()})
_TEXT_SKILLS, _PIECE_SKILLS = matches(_SKILLS), matches_each(_SKILLS, "skills")


def with_skills(df: DataFrame, text: str, into: str = "skills") -> DataFrame:
    """Add the sorted, distinct skills named in a text column."""
    return df.withColumn("_found", _TEXT_SKILLS(F.lower(F.coalesce(F.col(text), F.lit(""))))).withColumn(into, F.col("_found.skills")).drop("_found")


def with_preferred(df: DataFrame, text: str, into: str = "preferred") -> DataFrame:
    """Add the skills that a text column names directly in front of "(is) preferred"."""
    return df.withColumn("_found", _LINE(F.lower(F.coalesce(F.col(text), F.lit(""))))).withColumn(into, F.col("_found.preferred")).drop("_found")


# --- headings and line classes ----------------------------------------------


def normalize_heading(line: Column) -> Column:
    return C.strip(F.regexp_replace(C.squash(F.lower(line)), ":+$", ""))


def heading_type(line: Column) -> Column:
    """required / preferred / general for a standalone heading, else null."""
    return _heading_of(normalize_heading(line))


def _heading_of(normal: Column) -> Column:
    return C.ladder(
        [((F.length(normal) <= S.MAX_HEADING_CHARS) & normal.isin(words), F.lit(kind)) for kind, words in S.HEADINGS],
        F.lit(None).cast("string"),
    )


def _inline_regex(words: Sequence[str]) -> str:
    longest_first = sorted(words, key=len, reverse=True)
    return C.java(r"^\s*(?:" + "|".join(C.regex_quote(w) for w in longest_first) + r")\s*(?::|—|–|-)\s*(.+)$")


def inline_heading(line: Column) -> Column:
    """``struct<section, rest>`` of "Heading: rest"; section is null without such a heading."""
    plain = F.struct(F.lit(None).cast("string").alias("section"), line.alias("rest"))
    return C.ladder(
        [
            (
                line.rlike(_inline_regex(words)),
                F.struct(
                    F.lit(kind).alias("section"),
                    C.strip(F.regexp_extract(line, _inline_regex(words), 1)).alias("rest"),
                ),
            )
            for kind, words in S.HEADINGS
        ],
        plain,
    )


def classify_line(line: Column, current_section: Column) -> Column:
    """``struct<section, reason>`` of a line on its own; the first cue that holds wins."""

    def verdict(section: str, reason: str) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(reason).alias("reason"))

    return C.ladder(
        [
            (C.any_of(line, S.BOILERPLATE), verdict("general", "boilerplate")),
            (C.any_of(line, S.PREFERRED_LINES), verdict("preferred", "preferred_language")),
            (current_section == "preferred", verdict("preferred", "preferred_section")),
            (current_section == "required", verdict("required", "required_section")),
            (C.any_of(line, S.REQUIRED_LINES), verdict("required", "requirement_language")),
        ],
        verdict("general", "general_context"),
    )


def is_continuation(line: Column) -> Column:
    return C.any_of(F.lower(C.strip(line)), S.CONTINUATIONS)


def at_least_count(line: Column) -> Column:
    """N of "at least N of", at least 1, else null."""
    word = F.lower(F.regexp_extract(line, C.java(S.AT_LEAST_OF), 1))
    number = C.ladder([(word == w, F.lit(n)) for w, n in S.NUMBER_WORDS.items()], word.try_cast("int"))
    return F.when(number.isNotNull(), F.greatest(F.lit(1), number))


# --- reading state ----------------------------------------------------------


def carry_sections(
    lines: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str = "line_no",
) -> DataFrame:
    """Section and forced count of every line from per-line flags.

    Expects ``heading`` (standalone heading kind or null), ``inline`` (section
    of an inline heading or null), ``boiler``, ``wants_preferred``,
    ``wants_required``, ``continues``, ``has_skills`` and ``min_count``.
    Heading rows keep a null ``section``; ``own_reason`` is the reason before a
    pending count takes a line over.
    """
    page = Window.partitionBy(*keys).orderBy(order)
    marked = lines.withColumn("_mark", F.coalesce("heading", "inline"))
    marked = marked.withColumns({
        "_segment": F.count("_mark").over(page),
        "current_section": F.coalesce(F.last("_mark", ignorenulls=True).over(page), F.lit("general")),
    })
    reason = C.ladder(
        [
            (F.col("boiler"), F.lit("boilerplate")),
            (F.col("wants_preferred"), F.lit("preferred_language")),
            (F.col("current_section") == "preferred", F.lit("preferred_section")),
            (F.col("current_section") == "required", F.lit("required_section")),
            (F.col("wants_required"), F.lit("requirement_language")),
        ],
        F.lit("general_context"),
    )
    body = F.col("heading").isNull()
    marked = marked.withColumn("_reason", F.when(body, reason))
    marked = marked.withColumn(
        "_base",
        F.when(F.col("_reason").startswith("preferred"), F.lit("preferred"))
        .when(F.col("_reason").isin("required_section", "requirement_language"), F.lit("required"))
        .when(body, F.lit("general")),
    )
    marked = marked.withColumn("_joins", (F.col("_reason") == "general_context") & F.col("continues"))

    before = (
        Window.partitionBy(*keys, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    anchor = F.last(F.when(~F.col("_joins"), F.col("_base")), ignorenulls=True).over(before)
    marked = marked.withColumn("_inherited", F.when(F.col("_joins"), anchor))
    inherits = F.col("_inherited").isin("required", "preferred")
    marked = marked.withColumns({
        "_own": F.when(inherits, F.col("_inherited")).otherwise(F.col("_base")),
        "_why": F.when(inherits, F.lit("continuation_line")).otherwise(F.col("_reason")),
    })

    event = F.when(
        F.col("has_skills"), F.struct(F.lit(0).alias("count"), F.lit("").alias("section"))
    ).when(F.col("min_count").isNotNull(), F.struct(F.col("min_count").alias("count"), F.col("_own").alias("section")))
    marked = marked.withColumn("_pending", F.last(F.when(body, event), ignorenulls=True).over(before))
    pending = body & F.col("min_count").isNull() & (F.coalesce(F.col("_pending.count"), F.lit(0)) > 0)
    takes = pending & F.col("has_skills") & F.col("_pending.section").isin("required", "preferred")
    return marked.withColumns({
        "section": F.when(takes, F.col("_pending.section")).otherwise(F.col("_own")),
        "reason": F.when(takes, F.lit("minimum_count_continuation")).otherwise(F.col("_why")),
        "forced_min": F.when(pending & F.col("has_skills"), F.col("_pending.count")),
        "own_reason": F.col("_why"),
    }).drop("_mark", "_segment", "_reason", "_base", "_joins", "_inherited", "_own", "_why", "_pending")


# --- structure of one line --------------------------------------------------


def make_group(section: Column, skills: Column, kind: str, text: Column, min_matches: Column) -> Column:
    """Requirement group: sorted distinct skills, count clamped to 1..n."""
    unique = F.array_sort(F.array_distinct(skills))
    return F.struct(
        section.alias("section"), unique.alias("skills"),
        F.greatest(F.lit(1), F.least(min_matches, F.size(unique))).cast("int").alias("min_matches"),
        F.lit(kind).alias("kind"), text.alias("text"),
    )


_PARTS = "array<struct<skills: array<string>, listed: boolean, example: boolean>>"


def with_parts(lines: DataFrame, line: str = "line", skills: str = "base_skills") -> DataFrame:
    """Add ``_parts``: what a line holds by itself, before any state is known.

    ``struct<count, either, inner, behind, clauses>``: the count of "at least N of", whether it says "one of", its
    parentheses, the skills behind an example marker, and the skills of its OR clauses.  The skills of all these pieces of a
    line come from one call.
    """
    base, low = F.col(skills), F.col("_low")
    none = C.empty_strings()
    first, second = (C.java(m) for m in S.EXAMPLE_MARKERS)
    tail = F.when(low.rlike(first), F.get(F.split(low, first, 2), F.lit(1))).when(
        low.rlike(second), F.get(F.split(low, second, 2), F.lit(1))
    )
    or_clauses = F.filter(F.split(low, C.java(S.AND_SPLIT)), lambda c: c.rlike(C.java(S.OR_CLAUSE)))
    named = F.size(base) >= 1
    lines = lines.withColumn("_low", F.lower(line)).withColumns({
        "_count": F.when(named & F.contains(F.col("_low"), F.lit("least")), at_least_count(F.col(line))),
        "_either": named & F.coalesce(F.col("_low").rlike(C.java(S.ONE_OF)), F.lit(False)),
    })
    free = named & ((F.size(base) < 2) | (F.col("_count").isNull() & ~F.col("_either")))
    lines = C.pinned(lines, {"_pieces": F.when(free, F.struct(
        F.when(F.contains(low, F.lit("(")), F.regexp_extract_all(low, F.lit(S.PARENTHESES), F.lit(1))).otherwise(none).alias("inner"),
        F.coalesce(F.array_compact(F.array(tail)), none).alias("tail"),
        F.when(low.rlike(C.java(S.OR_CLAUSE)), or_clauses).otherwise(none).alias("clauses"),
    ))})
    asked = F.concat("_pieces.inner", "_pieces.tail", "_pieces.clauses")
    lines = lines.withColumn("_answers", _PIECE_SKILLS(F.when(F.size(asked) > 0, asked)))
    inner, behind, clauses = (F.size(F.col("_pieces")[n]) for n in ("inner", "tail", "clauses"))

    def answers(start: Column, count: Column) -> Column:
        part = F.transform(F.slice("_answers", start, count), lambda found: F.array_intersect(found, base))
        return F.when(F.coalesce(count, F.lit(0)) > 0, part)

    def in_parentheses(part: Column, here: Column) -> Column:
        listed = F.contains(part, F.lit(",")) | F.contains(part, F.lit("/")) | part.rlike(C.java(S.OR_WORD))
        return F.struct(
            here.alias("skills"), ((F.size(here) >= 2) & listed).alias("listed"),
            C.any_of(part, S.EXAMPLE_IN_PARENTHESES).alias("example"),
        )

    parts = F.filter(F.zip_with("_pieces.inner", answers(F.lit(1), inner), in_parentheses), lambda p: F.size(p["skills"]) > 0)
    return lines.withColumn("_parts", F.struct(
        F.col("_count").alias("count"), F.col("_either").alias("either"), F.coalesce(parts, F.array().cast(_PARTS)).alias("inner"),
        F.coalesce(F.get(answers(inner + F.lit(1), behind), F.lit(0)), none).alias("behind"),
        F.coalesce(answers(inner + behind + F.lit(1), clauses), F.array().cast("array<array<string>>")).alias("clauses"),
    )).drop("_low", "_count", "_either", "_pieces", "_answers")


def with_structure(
    lines: DataFrame, line: str = "line", skills: str = "base_skills", section: str = "section",
    forced: str = "forced_min",
) -> DataFrame:
    """Add ``standalone``, ``groups`` and ``non_scoring`` of every line with skills.

    In order: forced count, count on the same line, "one of", and otherwise
    parenthetical examples, inline examples and OR clauses, each looking only
    at skills that nothing before has taken.
    """
    if "_parts" not in lines.columns:
        lines = with_parts(lines, line, skills)
    base, text, kind = F.col(skills), F.col(line), F.col("_mode")
    no_skills = C.empty_strings()
    many = F.size(base) >= 2
    lines = lines.withColumn("_mode", C.ladder(
        [
            (F.size(base) < 1, F.lit("none")),
            (many & F.col(forced).isNotNull(), F.lit("forced")),
            (many & F.col("_parts.count").isNotNull(), F.lit("count")),
            (many & F.col("_parts.either"), F.lit("either")),
        ],
        F.lit("free"),
    ))

    def skills_of(chosen: Column) -> Column:
        return F.flatten(F.transform(chosen, lambda p: p["skills"]))

    inner = F.col("_parts.inner")
    lines = lines.withColumns({
        "_taken": F.array_distinct(skills_of(F.filter(inner, lambda p: p["listed"] | p["example"]))),
        "_single": skills_of(F.filter(inner, lambda p: ~p["listed"] & p["example"])),
    })
    lines = lines.withColumn("_inline", F.array_except("_parts.behind", "_taken"))

    def take(state: Column, clause: Column) -> Column:
        fresh = F.array_except(clause, state["taken"])
        enough = F.size(fresh) >= 2
        return F.struct(
            F.when(enough, F.array_union(state["taken"], fresh)).otherwise(state["taken"]).alias("taken"),
            F.when(enough, F.concat(state["found"], F.array(fresh))).otherwise(state["found"]).alias("found"),
        )

    begin = F.struct(
        F.array_union("_taken", "_inline").alias("taken"), F.array().cast("array<array<string>>").alias("found")
    )
    lines = lines.withColumn("_or", F.aggregate("_parts.clauses", begin, take))

    where = F.col(section)

    def group(found: Column, name: str, count: Column) -> Column:
        return make_group(where, found, name, text, count)

    one = F.lit(1)
    free_groups = F.concat(
        F.transform(F.filter("_parts.inner", lambda p: p["listed"]), lambda p: group(p["skills"], "example_group", one)),
        F.when(F.size("_inline") >= 2, F.array(group(F.col("_inline"), "example_group", one))).otherwise(
            F.array().cast(_GROUPS)
        ),
        F.transform(F.col("_or.found"), lambda s: group(s, "alternative", one)),
    )
    lines = C.pinned(lines, {
        "groups": C.ladder(
            [
                (kind == "forced", F.array(group(base, "minimum_count", F.col(forced)))),
                (kind == "count", F.array(group(base, "minimum_count", F.col("_parts.count")))),
                (kind == "either", F.array(group(base, "alternative", one))),
                (kind == "free", free_groups),
            ],
            F.array().cast(_GROUPS),
        ).cast(_GROUPS),
        "standalone": F.when(kind == "free", F.array_sort(F.array_except(base, F.col("_or.taken")))).otherwise(no_skills),
        "non_scoring": F.when(kind == "free", F.array_sort(F.array_distinct(F.concat(
            F.col("_single"), F.when(F.size("_inline") == 1, F.col("_inline")).otherwise(no_skills)
        )))).otherwise(no_skills),
    })
    return lines.drop("_mode", "_parts", "_taken", "_single", "_inline", "_or")


# --- per posting ------------------------------------------------------------


def line_flags(lines: DataFrame, line: str = "line") -> DataFrame:
    """Everything a line says by itself; the text behind an inline heading replaces the line."""
    raw, low = F.col(line), F.col("_low")
    marked = lines.withColumn("_normal", normalize_heading(raw)).withColumn("heading", _heading_of(F.col("_normal")))
    may_lead = F.col("heading").isNull() & C.contains_any(raw, S.HEADING_MARKS)
    marked = marked.withColumn("_inline", F.when(may_lead, inline_heading(raw)))
    marked = marked.withColumns({
        "inline": F.col("_inline.section"), line: F.coalesce(F.col("_inline.rest"), raw),
    }).drop("_inline", "_normal").withColumn("_low", F.lower(line))
    body = F.col("heading").isNull()
    marked = marked.withColumn("_found", _LINE(low))

    def cue(name: str) -> Column:
        return F.array_contains("_found.cues", name)

    def of_body(names: Column) -> Column:
        return F.when(body, names).otherwise(C.empty_strings())

    return marked.withColumns({
        "boiler": cue("boilerplate"), "wants_preferred": cue("preferred"), "wants_required": cue("required"), "continues": cue("continues"),
        "min_count": F.when(body & F.contains(low, F.lit("least")), at_least_count(raw)),
        "skills": of_body(F.col("_found.skills")), "preferred_overrides": of_body(F.col("_found.preferred")),
        "has_skills": body & (F.size("_found.skills") > 0),
    }).withColumn("base_skills", F.array_except("skills", "preferred_overrides")).drop("_found", "_low")


def read_lines(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Line rows (keys, ``line_no``, ``line``) with section, reason, skills and structure.

    What a line says by itself comes first; behind the one shuffle of the windows everything is built-in.
    """
    return with_structure(carry_sections(with_parts(line_flags(lines)), keys))


def evidence_rows(read: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per skill-bearing line with the reason of its class."""
    return read.filter("has_skills").select(
        *keys, "line_no", "section", "skills", F.col("standalone").alias("standalone_skills"), "preferred_overrides",
        F.col("non_scoring").alias("non_scoring_examples"),
        F.transform("groups", lambda g: F.struct(g["skills"], g["min_matches"], g["kind"])).alias("groups"),
        (F.size("groups") > 0).alias("alternative"), F.col("reason").alias("classification_reason"),
        F.col("line").alias("text"),
    )


def same_group(a: Column, b: Column) -> Column:
    return (
        (a["section"] == b["section"]) & (a["skills"] == b["skills"])
        & (a["min_matches"] == b["min_matches"]) & (a["kind"] == b["kind"])
    )


def distinct_groups(groups: Column) -> Column:
    """First group of every (section, skills, count, kind), order kept."""
    return F.filter(
        groups, lambda g, i: ~F.exists(F.slice(groups, 1, i), lambda earlier: same_group(earlier, g))
    )


def dedupe_group_rows(groups: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Row form of ``distinct_groups``: keeps the first row per key and group identity."""
    return C.first_by_rank(groups, [*keys, "section", "skills", "min_matches", "kind"], order)


def settle_sets(required: Column, preferred: Column, general: Column, groups: Column) -> Column:
    """``struct<required_skills, preferred_skills, general_skills>``.

    Required beats preferred beats general, and members of a group leave the
    standalone sets it covers.
    """

    def members(section: str) -> Column:
        return F.flatten(F.transform(F.filter(groups, lambda g: g["section"] == section), lambda g: g["skills"]))

    in_required, in_preferred = members("required"), members("preferred")
    grouped = F.concat(in_required, in_preferred)
    return F.struct(
        F.array_sort(F.array_except(required, in_required)).alias("required_skills"),
        F.array_sort(F.array_except(F.array_except(preferred, required), grouped)).alias("preferred_skills"),
        F.array_sort(
            F.array_except(F.array_except(general, F.concat(required, preferred)), grouped)
        ).alias("general_skills"),
    )


def extraction_stats(sets: Column, groups: Column, lines: Column, headings: Column, required: Column, preferred: Column):
    """The ten counters of one posting as a struct."""

    def in_section(section: str) -> Column:
        return F.size(F.filter(groups, lambda g: g["section"] == section))

    return F.struct(
        lines.cast("int").alias("line_count"), headings.cast("int").alias("recognized_heading_count"),
        F.size(sets["required_skills"]).alias("required_skill_count"),
        F.size(sets["preferred_skills"]).alias("preferred_skill_count"),
        F.size(sets["general_skills"]).alias("general_skill_count"),
        in_section("required").alias("required_group_count"),
        in_section("preferred").alias("preferred_group_count"),
        in_section("general").alias("general_group_count"),
        required.cast("int").alias("requirement_language_lines"),
        preferred.cast("int").alias("preferred_language_lines"),
    )


def collect_requirements(read: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Requirements of every posting from its read lines: three sets, groups, stats."""
    skill_line = F.col("has_skills")
    section = F.col("section")

    def union(values: Column) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(values)))

    def standalone(condition: Column) -> Column:
        return F.when(skill_line & condition, F.col("standalone"))

    grouped = read.groupBy(*keys).agg(
        union(standalone(section == "required")).alias("_required"),
        F.array_union(
            union(F.when(skill_line, F.col("preferred_overrides"))), union(standalone(section == "preferred"))
        ).alias("_preferred"),
        F.array_union(
            union(F.when(skill_line, F.col("non_scoring"))),
            union(standalone(~section.isin("required", "preferred"))),
        ).alias("_general"),
        F.array_sort(F.collect_list(F.when(F.size("groups") > 0, F.struct("line_no", "groups")))).alias("_groups"),
        F.count("line_no").alias("_lines"),
        F.count(F.coalesce("heading", "inline")).alias("_headings"),
        F.count_if(skill_line & (F.col("own_reason") == "requirement_language")).alias("_req_lines"),
        F.count_if(skill_line & (F.col("own_reason") == "preferred_language")).alias("_pref_lines"),
    )
    grouped = grouped.withColumn(
        "requirement_groups", distinct_groups(F.flatten(F.transform("_groups", lambda g: g["groups"])))
    )
    grouped = grouped.withColumn(
        "_sets", settle_sets(F.col("_required"), F.col("_preferred"), F.col("_general"), F.col("requirement_groups"))
    )
    return grouped.select(
        *keys, "_sets.required_skills", "_sets.preferred_skills", "_sets.general_skills", "requirement_groups",
        extraction_stats(
            F.col("_sets"), F.col("requirement_groups"), F.col("_lines"), F.col("_headings"), F.col("_req_lines"),
            F.col("_pref_lines"),
        ).alias("extraction_stats"),
    )


def extract_requirements(postings: DataFrame, keys: Sequence[str] = KEYS, parsed: str = "parsed") -> DataFrame:
    """Requirements of postings whose ``parsed`` column comes from the HTML reader.

    Lines are read where their page lies; then they are laid out by posting once, for the windows and the final grouping.
    """
    lines = postings.select(*keys, F.posexplode_outer(X.logical_lines(F.col(parsed))).alias("line_no", "line"))
    return collect_requirements(read_lines(lines, keys), keys)


def inspect_targets(targets: DataFrame, postings: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Named titles per board with the last posting of that title, and ``found`` false where there is none."""
    wanted = postings.join(
        targets.select("board_token", "title").distinct(), ["board_token", "title"], "left_semi"
    )
    last = C.first_by_rank(wanted, ["board_token", "title"], order)
    return targets.join(last, ["board_token", "title"], "left").withColumn("found", F.col("posting_id").isNotNull())
