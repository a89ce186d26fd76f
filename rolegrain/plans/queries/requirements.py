"""Skills and requirement structure."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ...operators import requirements as R
from ...operators import text as X
from ...rules import skills as S
from . import bindings as b
from .text import SENTENCES

KEYS = ["board_token", "posting_id"]

# \b in SQL knows ASCII letters only; the texts have others.
_EDGE = "[^\\pL\\pN\\pM_]"


def _wide(pattern: str) -> str:
    """A pattern whose outer word boundaries see every letter."""
    if pattern.startswith("\\b"):
        pattern = f"(?:^|{_EDGE})(?:{pattern[2:]}" + ")"
        if pattern.endswith("\\b)"):
            return pattern[:-3] + f"(?:$|{_EDGE}))"
        return pattern
    return pattern


def skills_sql(text: str) -> str:
    rungs = ", ".join(
        f"CASE WHEN regexp_matches({text}, {b.q('(?i)(?:' + '|'.join(map(_wide, pack)) + ')')}) THEN {b.q(skill)} END"
        for skill, pack in R._skill_patterns().items()
    )
    return f"list_filter([{rungs}], lambda x: x IS NOT NULL)"


def _joined(column: str):
    return F.array_join(column, "|").alias(column)


def _page(spark, sf_dir):
    """Posting pages as the HTML reader sees them."""
    return X.with_parsed_html(b.postings(spark, sf_dir).select(*KEYS, "content"))


def _lines(spark, sf_dir):
    """Requirement lines of every posting: heading and the two requirement lines, with the text behind."""
    p = b.postings(spark, sf_dir)
    listed = F.array(
        F.concat(F.col("heading"), F.when(F.col("doc_id") % 2 == 0, F.lit(" :")).otherwise(F.lit(""))),
        F.concat("heading", F.lit(": "), "line_1"), F.col("line_1"), F.col("line_2"),
        F.concat(F.lit("and "), "line_2"), F.col("text"),
    )
    return p.select(*KEYS, "doc_id", F.posexplode(listed).alias("line_no", "line"))


LINES = """lines AS (
  SELECT doc_id, board_token, posting_id, CAST(n - 1 AS INTEGER) AS line_no, ls[n] AS line FROM (
    SELECT doc_id, board_token, posting_id, unnest(range(1, 7)) AS n,
           [heading || CASE WHEN doc_id % 2 = 0 THEN ' :' ELSE '' END, heading || ': ' || line_1, line_1, line_2,
            'and ' || line_2, text] AS ls FROM p))"""


@b.query("d1_skills", b.with_ctes(b.POSTINGS) + f"SELECT doc_id, array_to_string({skills_sql('body')}, '|') AS skills FROM p")
def d1(spark, sf_dir):
    return R.with_skills(b.postings(spark, sf_dir).select("doc_id", "body"), "body").select("doc_id", _joined("skills"))


def _list(words) -> str:
    return ", ".join(map(b.q, words))


HEADING_SQL = "CASE " + " ".join(
    f"WHEN len(h) <= {S.MAX_HEADING_CHARS} AND h IN ({_list(words)}) THEN '{kind}'" for kind, words in S.HEADINGS
) + " END"
NORMAL_HEADING = b.strip_sql(f"regexp_replace({b.squash_sql('lower(line)')}, ':+$', '')")


@b.query("d2_headings", b.with_ctes(b.POSTINGS, LINES) + f"""
SELECT doc_id, line_no, {HEADING_SQL} AS heading FROM (SELECT *, {NORMAL_HEADING} AS h FROM lines)""")
def d2(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", R.heading_type(F.col("line")).alias("heading"))


def _inline(words) -> str:
    ordered = sorted(words, key=len, reverse=True)
    return b.q("(?i)^\\s*(?:" + "|".join(re.escape(w).replace("\\ ", " ").replace("’", "’") for w in ordered) + ")\\s*(?::|—|–|-)\\s*(.+)$")


INLINE_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(line, {_inline(w)}) THEN '{k}'" for k, w in S.HEADINGS) + " END"
INLINE_REST = "CASE " + " ".join(
    f"WHEN regexp_matches(line, {_inline(w)}) THEN trim(regexp_extract(line, {_inline(w)}, 1))" for _, w in S.HEADINGS
) + " ELSE line END"


@b.query("d3_inline_headings", b.with_ctes(b.POSTINGS, LINES) + f"""
SELECT doc_id, line_no, {INLINE_SECTION} AS section, {INLINE_REST} AS rest FROM lines""")
def d3(spark, sf_dir):
    found = R.inline_heading(F.col("line"))
    return _lines(spark, sf_dir).withColumn("i", found).select("doc_id", "line_no", "i.section", "i.rest")


_SECTION = b.pick_sql(["general", "required", "preferred"], "doc_id + line_no")


def _reason(section: str) -> str:
    return b.case_sql(
        [
            (b.matches_sql("line", S.BOILERPLATE), "'boilerplate'"),
            (b.matches_sql("line", S.PREFERRED_LINES), "'preferred_language'"),
            (f"{section} = 'preferred'", "'preferred_section'"), (f"{section} = 'required'", "'required_section'"),
            (b.matches_sql("line", S.REQUIRED_LINES), "'requirement_language'"),
        ],
        "'general_context'",
    )


@b.query("d4_line_classes", b.with_ctes(b.POSTINGS, LINES) + f"""
SELECT doc_id, line_no, CASE WHEN reason LIKE 'preferred%' THEN 'preferred'
  WHEN reason LIKE 'requir%' THEN 'required' ELSE 'general' END AS section, reason
FROM (SELECT doc_id, line_no, {_reason(_SECTION)} AS reason FROM lines)""")
def d4(spark, sf_dir):
    section = b.pick(["general", "required", "preferred"], F.col("doc_id") + F.col("line_no"))
    verdict = R.classify_line(F.col("line"), section)
    return _lines(spark, sf_dir).withColumn("v", verdict).select("doc_id", "line_no", "v.section", "v.reason")


STATE = """a AS (SELECT *, count(hs) OVER w AS seg, coalesce(last_value(hs IGNORE NULLS) OVER w, 'general') AS cur
      FROM l WINDOW w AS (PARTITION BY d ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN boil THEN 'boilerplate' WHEN pp THEN 'preferred_language' WHEN cur = 'preferred' THEN 'preferred_section'
        WHEN cur = 'required' THEN 'required_section' WHEN rp THEN 'requirement_language' ELSE 'general_context' END AS why,
        CASE WHEN boil THEN 'general' WHEN pp THEN 'preferred' WHEN cur <> 'general' THEN cur
        WHEN rp THEN 'required' ELSE 'general' END AS base FROM a WHERE NOT standalone),
c AS (SELECT *, why = 'general_context' AND ct AS joins FROM b),
e AS (SELECT *, CASE WHEN joins THEN coalesce(last_value(CASE WHEN NOT joins THEN base END IGNORE NULLS) OVER (PARTITION BY d, seg
        ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'general') ELSE base END AS e1 FROM c),
e2 AS (SELECT *, CASE WHEN joins AND e1 <> 'general' THEN 'continuation_line' ELSE why END AS own_reason FROM e),
f AS (SELECT *, last_value(CASE WHEN sk THEN {'m': 0, 's': ''} WHEN mn IS NOT NULL THEN {'m': mn, 's': e1} END IGNORE NULLS)
        OVER (PARTITION BY d, seg ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pd FROM e2),
g AS (SELECT *, mn IS NULL AND sk AND coalesce(pd.m, 0) > 0 AS forced FROM f),
state AS (SELECT *, CASE WHEN forced AND pd.s IN ('required', 'preferred') THEN pd.s ELSE e1 END AS section,
        CASE WHEN forced AND pd.s IN ('required', 'preferred') THEN 'minimum_count_continuation' ELSE own_reason END AS reason,
        CASE WHEN forced THEN pd.m END AS forced_min FROM g)"""

_TURNS = """l AS (SELECT conv_id AS d, turn AS p, len(text) % 7 = 0 AS standalone,
   CASE len(text) % 14 WHEN 0 THEN 'required' WHEN 7 THEN CASE WHEN turn % 2 = 0 THEN 'preferred' ELSE 'general' END
     WHEN 3 THEN 'required' END AS hs,
   len(text) % 11 = 1 AS boil, len(text) % 13 = 2 AS pp, len(text) % 5 = 3 AS rp, len(text) % 3 = 1 AS ct,
   len(text) % 4 <> 2 AS sk, CASE WHEN len(text) % 6 = 4 THEN CAST(len(text) % 3 + 1 AS INTEGER) END AS mn
 FROM conversations)"""


def _turns(spark, sf_dir):
    size = F.length("text")
    standalone = size % 7 == 0
    section = F.when(size % 14 == 0, F.lit("required")).when(
        size % 14 == 7, F.when(F.col("turn") % 2 == 0, F.lit("preferred")).otherwise(F.lit("general"))
    ).when(size % 14 == 3, F.lit("required"))
    return b.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(standalone, section).alias("heading"), F.when(~standalone, section).alias("inline"),
        (size % 11 == 1).alias("boiler"), (size % 13 == 2).alias("wants_preferred"), (size % 5 == 3).alias("wants_required"),
        (size % 3 == 1).alias("continues"), (size % 4 != 2).alias("has_skills"),
        F.when(size % 6 == 4, (size % 3 + 1).cast("int")).alias("min_count"),
    )


@b.query("d5_section_state", b.with_ctes(_TURNS, STATE) + """
SELECT d AS conv_id, p AS turn, section, reason, own_reason FROM state WHERE sk""")
def d5(spark, sf_dir):
    state = R.carry_sections(_turns(spark, sf_dir), ["conv_id"], "turn")
    kept = state.filter(F.col("heading").isNull() & F.col("has_skills"))
    return kept.select("conv_id", "turn", "section", "reason", "own_reason")


@b.query("d6_pending_counts", b.with_ctes(_TURNS, STATE) + """
SELECT d AS conv_id, p AS turn, forced_min FROM state WHERE sk""")
def d6(spark, sf_dir):
    state = R.carry_sections(_turns(spark, sf_dir), ["conv_id"], "turn")
    return state.filter(F.col("heading").isNull() & F.col("has_skills")).select("conv_id", "turn", "forced_min")


_AT_LEAST = f"lower(regexp_extract(line, {b.q('(?i)' + S.AT_LEAST_OF)}, 1))"
MIN_COUNT = f"CASE {_AT_LEAST} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in S.NUMBER_WORDS.items()) + \
    f" ELSE CASE WHEN TRY_CAST({_AT_LEAST} AS INTEGER) < 1 THEN 1 ELSE TRY_CAST({_AT_LEAST} AS INTEGER) END END"


@b.query("d6_at_least", b.with_ctes(b.POSTINGS, LINES) + f"""
SELECT doc_id, line_no, min_count FROM (SELECT doc_id, line_no, {MIN_COUNT} AS min_count FROM lines) WHERE min_count IS NOT NULL""")
def d6_at_least(spark, sf_dir):
    counted = _lines(spark, sf_dir).withColumn("min_count", R.at_least_count(F.col("line")))
    return counted.filter(F.col("min_count").isNotNull()).select("doc_id", "line_no", "min_count")


_PREFERRED = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(line, {b.q('(?i)(?:' + '|'.join(pack) + ')' + chr(92) + 's*(?:is' + chr(92) + 's+)?preferred' + chr(92) + 'b')}) THEN {b.q(skill)} END"
    for skill, pack in sorted(S.SKILLS.items()) if skill != "Go"
) + "], lambda x: x IS NOT NULL)"


def _preferred_lines(p):
    """A line that prefers one of two skills, in front of the whole text."""
    first, second = b.pick(["AWS", "Kafka", "React", "SQL"], F.col("doc_id")), b.pick(["Docker", "Redis", "Spark"], F.col("doc_id"))
    return F.concat(F.lit("Cloud work ("), first, F.lit(" is preferred), "), second, F.lit(" welcome. "), F.col("text"))


@b.query("d7_targeted_preference", f"""
WITH l AS (SELECT doc_id, 'Cloud work (' || {b.pick_sql(['AWS', 'Kafka', 'React', 'SQL'], 'doc_id')} || ' is preferred), '
  || {b.pick_sql(['Docker', 'Redis', 'Spark'], 'doc_id')} || ' welcome. ' || text AS line FROM documents)
SELECT doc_id, array_to_string({_PREFERRED}, '|') AS preferred FROM l""")
def d7(spark, sf_dir):
    p = b.postings(spark, sf_dir)
    lines = R.with_preferred(p.select("doc_id", _preferred_lines(p).alias("line")), "line")
    return lines.select("doc_id", _joined("preferred"))


def _structured(spark, sf_dir):
    """All lines of every posting, read whole, with the skills of the line."""
    lines = R.with_skills(_lines(spark, sf_dir), "line", "base_skills")
    section = b.pick(["required", "preferred", "general"], F.col("doc_id"))
    lines = lines.withColumns({"section": section, "forced_min": F.when(F.col("doc_id") % 10 == 9, F.lit(2))})
    return R.with_structure(lines)


def _groups(frame):
    return frame.select("doc_id", "line_no", "line", F.explode("groups").alias("g")).select(
        "doc_id", "line_no", F.array_join("g.skills", "|").alias("skills"), "g.section", "g.min_matches", "g.kind"
    )


_BEHIND = [b.q(f"^(?s:.*?)(?i:{m})((?s:.*))$") for m in S.EXAMPLE_MARKERS]
_MARKED = [b.matches_sql("low", [m]) for m in S.EXAMPLE_MARKERS]
_IN_BASE = "lambda x: list_contains(base, x)"
_GROUP = "{{'section': section, 'skills': {skills}, 'min_matches': {count}, 'kind': '{kind}', 'text': line}}"


def structure_sql(lines: str) -> str:
    """CTEs from ``lines`` (``line``, ``base``, ``section``, ``forced`` and others) to ``structured`` with groups, standalone, non_scoring."""
    one = _GROUP.format(skills="piece.skills", count="1", kind="example_group")
    clamp = "greatest(1, least({0}, len(base)))::INTEGER"
    forced, counted = (_GROUP.format(skills="base", count=clamp.format(c), kind="minimum_count") for c in ("forced", "own_count"))
    either, inline = _GROUP.format(skills="base", count="1", kind="alternative"), _GROUP.format(skills="inline", count="1", kind="example_group")
    found = _GROUP.format(skills="f", count="1", kind="alternative")
    return f"""lowered AS (SELECT *, lower(line) AS low FROM {lines}),
modes AS (
  SELECT *, {MIN_COUNT} AS own_count,
    CASE WHEN len(base) < 1 THEN 'none' WHEN len(base) >= 2 AND forced IS NOT NULL THEN 'forced'
         WHEN len(base) >= 2 AND {MIN_COUNT} IS NOT NULL THEN 'count' WHEN len(base) >= 2 AND {b.matches_sql('low', [S.ONE_OF])} THEN 'either' ELSE 'free' END AS mode
  FROM lowered),
named AS (
  SELECT *, CASE WHEN mode = 'free' THEN list_filter(list_transform(regexp_extract_all(low, {b.q(S.PARENTHESES)}, 1), lambda t: {{
      'skills': list_filter({skills_sql('t')}, {_IN_BASE}), 'listed': contains(t, ',') OR contains(t, '/') OR {b.matches_sql('t', [S.OR_WORD])},
      'example': {b.matches_sql('t', S.EXAMPLE_IN_PARENTHESES)}}}), lambda piece: len(piece.skills) > 0) ELSE [] END AS paren,
    CASE WHEN mode = 'free' THEN CASE WHEN {_MARKED[0]} THEN regexp_extract(low, {_BEHIND[0]}, 1) WHEN {_MARKED[1]} THEN regexp_extract(low, {_BEHIND[1]}, 1) END END AS tail,
    CASE WHEN mode = 'free' THEN list_transform(list_filter(regexp_split_to_array(low, {b.q(S.AND_SPLIT)}), lambda t: {b.matches_sql('t', [S.OR_CLAUSE])}),
      lambda t: list_filter({skills_sql('t')}, {_IN_BASE})) ELSE [] END AS clauses
  FROM modes),
parts AS (
  SELECT *, list_filter(paren, lambda piece: piece.listed AND len(piece.skills) >= 2) AS groups_in,
    list_distinct(flatten(list_transform(list_filter(paren, lambda piece: (piece.listed AND len(piece.skills) >= 2) OR piece.example), lambda piece: piece.skills))) AS taken,
    flatten(list_transform(list_filter(paren, lambda piece: piece.example AND NOT (piece.listed AND len(piece.skills) >= 2)), lambda piece: piece.skills)) AS single
  FROM named),
tails AS (
  SELECT *, CASE WHEN tail IS NULL THEN [] ELSE list_filter({skills_sql('tail')}, lambda x: list_contains(base, x) AND NOT list_contains(taken, x)) END AS inline FROM parts),
folded AS (
  SELECT *, list_reduce(list_prepend({{'taken': list_concat(taken, inline), 'found': []::VARCHAR[][]}}, list_transform(clauses, lambda c: {{'taken': c, 'found': []::VARCHAR[][]}})),
    lambda s, e: CASE WHEN len(list_filter(e.taken, lambda x: NOT list_contains(s.taken, x))) >= 2 THEN
      {{'taken': list_concat(s.taken, list_filter(e.taken, lambda x: NOT list_contains(s.taken, x))),
        'found': list_append(s.found, list_filter(e.taken, lambda x: NOT list_contains(s.taken, x)))}} ELSE s END) AS fold
  FROM tails),
structured AS (
  SELECT *, CASE mode WHEN 'forced' THEN [{forced}] WHEN 'count' THEN [{counted}] WHEN 'either' THEN [{either}] WHEN 'free' THEN
      list_concat(list_transform(groups_in, lambda piece: {one}), CASE WHEN len(inline) >= 2 THEN [{inline}] ELSE [] END, list_transform(fold.found, lambda f: {found})) ELSE [] END AS groups,
    CASE WHEN mode = 'free' THEN list_filter(base, lambda x: NOT list_contains(fold.taken, x)) ELSE [] END AS standalone,
    CASE WHEN mode = 'free' THEN list_sort(list_distinct(list_concat(single, CASE WHEN len(inline) = 1 THEN inline ELSE [] END))) ELSE [] END AS non_scoring
  FROM folded)"""


_STRUCTURED = b.with_ctes(b.POSTINGS, LINES, f"""skilled AS (
  SELECT doc_id, line_no, line, {skills_sql('line')} AS base, {b.pick_sql(['required', 'preferred', 'general'], 'doc_id')} AS section,
         CASE WHEN doc_id % 10 = 9 THEN 2 END AS forced FROM lines)""", structure_sql("skilled"), """
rows AS (SELECT doc_id, line_no, line, unnest(groups) AS g FROM structured)""")
_ROWS = "SELECT doc_id, line_no, array_to_string(g.skills, '|') AS skills, g.section, g.min_matches, g.kind FROM rows"


@b.query("d8_parenthetical_groups", _STRUCTURED + _ROWS + " WHERE contains(line, '(') AND g.kind = 'example_group'")
def d8(spark, sf_dir):
    frame = _structured(spark, sf_dir).filter(F.contains("line", F.lit("(")))
    return _groups(frame).filter(F.col("kind") == "example_group")


@b.query("d9_inline_examples", _STRUCTURED + "SELECT doc_id, line_no, array_to_string(non_scoring, '|') AS non_scoring FROM structured WHERE len(non_scoring) > 0")
def d9(spark, sf_dir):
    frame = _structured(spark, sf_dir).filter(F.size("non_scoring") > 0)
    return frame.select("doc_id", "line_no", _joined("non_scoring"))


@b.query("d10_line_structure", _STRUCTURED + _ROWS)
def d10(spark, sf_dir):
    return _groups(_structured(spark, sf_dir))


@b.query("d11_distinct_groups", """
SELECT l_orderkey, section, skills, min_matches, kind, l_linenumber FROM (
  SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'required' ELSE 'preferred' END AS section,
         CASE WHEN l_linestatus = 'F' THEN 'AWS|Go' ELSE 'Java' END AS skills,
         CASE WHEN l_linestatus = 'F' THEN CAST(least(l_linenumber, 2) AS INTEGER) ELSE 1 END AS min_matches, 'alternative' AS kind,
         row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R', l_linestatus, least(l_linenumber, 2) * (l_linestatus = 'F')::INT
                            ORDER BY l_linenumber, l_partkey) AS r
  FROM lineitem) WHERE r = 1""")
def d11(spark, sf_dir):
    wide = F.col("l_linestatus") == "F"
    skills = F.when(wide, F.array(F.lit("Go"), F.lit("AWS"), F.lit("Go"))).otherwise(F.array(F.lit("Java")))
    section = F.when(F.col("l_returnflag") == "R", F.lit("required")).otherwise(F.lit("preferred"))
    group = R.make_group(section, skills, "alternative", F.col("l_linestatus"), F.col("l_linenumber").cast("int"))
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", group.alias("g"))
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "g.*")
    kept = R.dedupe_group_rows(rows, ["l_orderkey"], [F.asc("l_linenumber"), F.asc("l_partkey")])
    return kept.select("l_orderkey", "section", _joined("skills"), "min_matches", "kind", "l_linenumber")


UNIVERSE = [
    "AWS", "Docker", "Go", "Java", "Kafka", "Kubernetes", "Python", "React", "SQL", "Spark", "Terraform", "TypeScript",
]


def some(factor: int, modulus: int, rest: int, key: str = "doc_id"):
    """Skills whose place fits the document number."""
    return F.filter(
        F.array(*map(F.lit, UNIVERSE)), lambda s, i: F.pmod(F.col(key) + i * F.lit(factor), F.lit(modulus)) == rest
    )


def some_sql(factor: int, modulus: int, rest: int, key: str = "doc_id") -> str:
    return (
        f"list_filter({b.sql_list(UNIVERSE)}, "
        f"lambda s: ({key} + (list_position({b.sql_list(UNIVERSE)}, s) - 1) * {factor}) % {modulus} = {rest})"
    )


@b.query("d12_settled_sets", f"""
WITH s AS (SELECT doc_id, {some_sql(1, 3, 0)} AS r, {some_sql(2, 3, 1)} AS pr, {some_sql(1, 2, 0)} AS ge,
                  {some_sql(1, 7, 2)} AS gr, {some_sql(1, 5, 3)} AS gp FROM documents)
SELECT doc_id, array_to_string(list_filter(r, lambda x: NOT list_contains(gr, x)), '|') AS required_skills,
  array_to_string(list_filter(pr, lambda x: NOT list_contains(list_concat(r, gr, gp), x)), '|') AS preferred_skills,
  array_to_string(list_filter(ge, lambda x: NOT list_contains(list_concat(r, pr, gr, gp), x)), '|') AS general_skills
FROM s""")
def d12(spark, sf_dir):
    one = F.lit(1)
    groups = F.array(
        R.make_group(F.lit("required"), some(1, 7, 2), "alternative", F.lit(""), one),
        R.make_group(F.lit("preferred"), some(1, 5, 3), "alternative", F.lit(""), one),
    )
    d = b.documents(spark, sf_dir).withColumn("groups", groups)
    sets = R.settle_sets(some(1, 3, 0), some(2, 3, 1), some(1, 2, 0), F.col("groups"))
    return d.withColumn("s", sets).select("doc_id", "s.*").select(
        "doc_id", _joined("required_skills"), _joined("preferred_skills"), _joined("general_skills")
    )


# Lines of the posting pages in SQL: three blocks, cut into sentences.
PAGE_LINES = f"""blocks AS (
  SELECT posting_id, board_token, unnest([1, 2, 3, 4]) AS block_no, unnest([heading, line_1, line_2, text]) AS block FROM p),
sentences AS (SELECT posting_id, board_token, block_no, {SENTENCES.format(b.squash_sql('block'))} AS parts FROM blocks),
page_lines AS (
  SELECT posting_id, board_token, row_number() OVER (PARTITION BY posting_id ORDER BY block_no, n) - 1 AS line_no, parts[n] AS line
  FROM (SELECT posting_id, board_token, block_no, parts, unnest(range(1, len(parts) + 1)) AS n FROM sentences)),
headed AS (SELECT *, {HEADING_SQL} AS heading FROM (SELECT *, {NORMAL_HEADING} AS h FROM page_lines)),
inlined AS (SELECT posting_id, board_token, line_no, heading, CASE WHEN heading IS NULL THEN {INLINE_SECTION} END AS inline_section,
                   CASE WHEN heading IS NULL THEN {INLINE_REST} ELSE line END AS line FROM headed),
l AS (SELECT posting_id AS d, board_token, line_no AS p, line, heading IS NOT NULL AS standalone,
             coalesce(heading, inline_section) AS hs, {b.matches_sql('line', S.BOILERPLATE)} AS boil,
             {b.matches_sql('line', S.PREFERRED_LINES)} AS pp, {b.matches_sql('line', S.REQUIRED_LINES)} AS rp,
             regexp_matches(lower(trim(line)), {b.q('(?:' + '|'.join(S.CONTINUATIONS) + ')')}) AS ct,
             {MIN_COUNT} AS mn, skills, len(skills) > 0 AS sk
      FROM (SELECT *, CASE WHEN heading IS NULL THEN {skills_sql('line')} ELSE [] END AS skills FROM inlined))"""


@b.query("b1_known_pages", b.with_ctes(b.POSTINGS) + f"""
SELECT posting_id, {b.squash_sql("heading || ' ' || line_1 || ' ' || line_2 || ' ' || text")} AS text FROM p""")
def b1_known(spark, sf_dir):
    """Pages whose text is known, through the same reader as ``b1_clean_html``."""
    return X.with_parsed_html(b.postings(spark, sf_dir), "content").select("posting_id", "parsed.text")


@b.query("b4_known_lines", b.with_ctes(b.POSTINGS, PAGE_LINES) + "SELECT posting_id, CAST(line_no AS INTEGER) AS line_no, line FROM page_lines")
def b4_known(spark, sf_dir):
    """The same for ``b4_logical_lines``."""
    pages = X.with_parsed_html(b.postings(spark, sf_dir), "content").select("posting_id", "parsed")
    return X.explode_lines(pages, X.logical_lines(F.col("parsed"))).select("posting_id", "line_no", "line")


@b.query("d13_evidence", b.with_ctes(b.POSTINGS, PAGE_LINES, STATE) + """
SELECT board_token, d AS posting_id, CAST(p AS INTEGER) AS line_no, section, reason AS classification_reason,
       array_to_string(skills, '|') AS skills, line AS text FROM state WHERE sk""")
def d13(spark, sf_dir):
    page = _page(spark, sf_dir)
    lines = X.explode_lines(page.select(*KEYS, "parsed"), X.logical_lines(F.col("parsed")))
    rows = R.evidence_rows(R.read_lines(lines.drop("parsed"), KEYS), KEYS)
    return rows.select(*KEYS, "line_no", "section", "classification_reason", _joined("skills"), "text")


@b.query("d14_extraction_stats", b.with_ctes(b.POSTINGS, PAGE_LINES, STATE) + """
SELECT l.board_token, l.d AS posting_id, CAST(count(*) AS INTEGER) AS line_count,
       CAST(count(l.hs) AS INTEGER) AS recognized_heading_count,
       CAST(count(*) FILTER (l.sk AND s.own_reason = 'requirement_language') AS INTEGER) AS requirement_language_lines,
       CAST(count(*) FILTER (l.sk AND s.own_reason = 'preferred_language') AS INTEGER) AS preferred_language_lines
FROM l LEFT JOIN state s ON s.d = l.d AND s.p = l.p GROUP BY ALL""")
def d14(spark, sf_dir):
    found = R.extract_requirements(_page(spark, sf_dir), KEYS).select(*KEYS, "extraction_stats.*")
    return found.select(
        *KEYS, "line_count", "recognized_heading_count", "requirement_language_lines", "preferred_language_lines"
    )


_FOLLOWED = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(line, {b.q('(?i)(?:' + '|'.join(pack) + ')' + chr(92) + 's*(?:is' + chr(92) + 's+)?preferred' + chr(92) + 'b')}) THEN {b.q(skill)} END"
    for skill, pack in sorted({**S.SKILLS, "Go": [S.GO_WORD]}.items())
) + "], lambda x: x IS NOT NULL)"


def _union(column: str, condition: str) -> str:
    return f"list_distinct(flatten(coalesce(list({column}) FILTER ({condition}), [])))"


def _without(items: str, *others: str) -> str:
    return f"list_sort(list_filter({items}, lambda x: NOT list_contains(list_concat({', '.join(others)}, []), x)))"


_REQUIREMENTS = b.with_ctes(b.POSTINGS, PAGE_LINES, STATE, f"""marked AS (
  SELECT d, board_token, p, line, section, forced_min, skills, list_filter({_FOLLOWED}, lambda x: list_contains(skills, x)) AS overrides FROM state WHERE sk),
readable AS (SELECT d, board_token, p, line, section, forced_min AS forced, overrides, list_filter(skills, lambda x: NOT list_contains(overrides, x)) AS base FROM marked)""",
    structure_sql("readable"), f"""numbered AS (
  SELECT d, p, unnest(range(1, len(groups) + 1)) AS i, unnest(groups) AS g FROM structured),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY d, g.section, g.skills, g.min_matches, g.kind ORDER BY p, i) AS n FROM numbered),
kept AS (SELECT d, list(g ORDER BY p, i) AS groups FROM firsts WHERE n = 1 GROUP BY d),
unions AS (
  SELECT d, {_union('standalone', "section = 'required'")} AS required,
    list_distinct(list_concat({_union('overrides', 'TRUE')}, {_union('standalone', "section = 'preferred'")})) AS preferred,
    list_distinct(list_concat({_union('non_scoring', 'TRUE')}, {_union('standalone', "section NOT IN ('required', 'preferred')")})) AS general
  FROM structured GROUP BY d),
members AS (
  SELECT u.*, coalesce(groups, []) AS groups,
    coalesce(flatten(list_transform(list_filter(groups, lambda g: g.section = 'required'), lambda g: g.skills)), []) AS in_required,
    coalesce(flatten(list_transform(list_filter(groups, lambda g: g.section = 'preferred'), lambda g: g.skills)), []) AS in_preferred
  FROM unions u LEFT JOIN kept USING (d)),
settled AS (
  SELECT d, groups, {_without('required', 'in_required')} AS required_skills, {_without('preferred', 'required', 'in_required', 'in_preferred')} AS preferred_skills,
    {_without('general', 'required', 'preferred', 'in_required', 'in_preferred')} AS general_skills FROM members),
counted AS (
  SELECT l.board_token, l.d, CAST(count(*) AS INTEGER) AS line_count, CAST(count(l.hs) AS INTEGER) AS recognized_heading_count,
    CAST(count(*) FILTER (l.sk AND s.own_reason = 'requirement_language') AS INTEGER) AS requirement_language_lines,
    CAST(count(*) FILTER (l.sk AND s.own_reason = 'preferred_language') AS INTEGER) AS preferred_language_lines
  FROM l LEFT JOIN state s ON s.d = l.d AND s.p = l.p GROUP BY ALL)""")
_SECTIONS = ("required", "preferred", "general")
_COUNTS = ", ".join([
    *[f"CAST(coalesce(len({s}_skills), 0) AS INTEGER) AS {s}_skill_count" for s in _SECTIONS],
    *[f"CAST(coalesce(len(list_filter(groups, lambda g: g.section = '{s}')), 0) AS INTEGER) AS {s}_group_count" for s in _SECTIONS],
])


@b.query("d14_counters", _REQUIREMENTS + f"""
SELECT board_token, d AS posting_id, line_count, recognized_heading_count, {_COUNTS}, requirement_language_lines, preferred_language_lines
FROM counted LEFT JOIN settled USING (d)""")
def d14_counters(spark, sf_dir):
    """All ten counters."""
    return R.extract_requirements(_page(spark, sf_dir), KEYS).select(*KEYS, "extraction_stats.*")


@b.query("d14_requirements", _REQUIREMENTS + """
SELECT board_token, d AS posting_id, coalesce(array_to_string(required_skills, '|'), '') AS required_skills,
  coalesce(array_to_string(preferred_skills, '|'), '') AS preferred_skills, coalesce(array_to_string(general_skills, '|'), '') AS general_skills,
  coalesce(to_json(groups)::VARCHAR, '[]') AS groups
FROM counted LEFT JOIN settled USING (d)""")
def d14_all(spark, sf_dir):
    found = R.extract_requirements(_page(spark, sf_dir), KEYS)
    return found.select(
        *KEYS, _joined("required_skills"), _joined("preferred_skills"), _joined("general_skills"),
        F.to_json("requirement_groups").alias("groups"),
    )


@b.query("d15_targets", b.with_ctes(b.POSTINGS) + f"""
, targets AS (SELECT DISTINCT source AS board_token, t.title FROM documents, (SELECT unnest({b.sql_list(b.TITLES[:5] + ['Archivist'])}) AS title) t)
SELECT board_token, title, arg_max(posting_id, doc_id) AS posting_id, count(posting_id) > 0 AS found
FROM targets LEFT JOIN p USING (board_token, title) GROUP BY 1, 2""")
def d15(spark, sf_dir):
    p = b.postings(spark, sf_dir)
    titles = F.explode(F.array(*map(F.lit, b.TITLES[:5] + ["Archivist"]))).alias("title")
    targets = p.select("board_token").distinct().select("board_token", titles)
    found = R.inspect_targets(targets, p.select("board_token", "posting_id", "title", "doc_id"), [F.desc("doc_id")])
    return found.select("board_token", "title", "posting_id", "found")


@b.query("i3_skill_sets", f"""
WITH s AS (SELECT doc_id, {some_sql(1, 3, 0)} AS a, {some_sql(1, 2, 1)} AS c FROM documents)
SELECT doc_id, array_to_string(list_filter({b.sql_list(UNIVERSE)}, lambda x: list_contains(a, x) OR list_contains(c, x)), '|') AS both_sets,
       array_to_string(list_filter(a, lambda x: list_contains(c, x)), '|') AS common,
       array_to_string(list_filter(a, lambda x: NOT list_contains(c, x)), '|') AS only_first
FROM s""")
def i3(spark, sf_dir):
    first, second = some(1, 3, 0), some(1, 2, 1)
    return b.documents(spark, sf_dir).select(
        "doc_id", F.array_join(F.array_sort(F.array_union(first, second)), "|").alias("both_sets"),
        F.array_join(F.array_intersect(first, second), "|").alias("common"),
        F.array_join(F.array_except(first, second), "|").alias("only_first"),
    )
