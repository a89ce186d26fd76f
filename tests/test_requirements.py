import random

import pytest
from pyspark.sql import functions as F

from rolegrain.operators import requirements as R
from rolegrain.operators import text as X

CASES = {
    "required section": ("<h3>Requirements</h3><ul><li>Experience with Python</li><li>Strong knowledge of AWS</li></ul>",
                         ["AWS", "Python"], [], [], []),
    "preferred section": ("<h3>Preferred Qualifications</h3><ul><li>Knowledge of Terraform</li></ul>", [], ["Terraform"], [], []),
    "inline heading": ("<p>What you'll need: Experience with Python and AWS.</p>", ["AWS", "Python"], [], [], []),
    "responsibilities": ("<h3>What You'll Do</h3><p>Build services using Python.</p>", [], [], ["Python"], []),
    "not the language": ("<p>Help the product go to market.</p>", [], [], [], []),
    "either": ("<p>Experience with Java or Go.</p>", [], [], [], [("required", ["Go", "Java"], 1, "alternative")]),
    "targeted preference": ("<p>Experience with distributed systems and cloud platforms (AWS preferred).</p>",
                            ["Distributed Systems"], ["AWS"], [], []),
    "parentheses": ("<p>Experience with cloud providers (AWS, Azure, GCP).</p>", [], [], [],
                    [("required", ["AWS", "Azure", "GCP"], 1, "example_group")]),
    "or and and": ("<p>Proficient in Python or Javascript/Typescript, and SQL.</p>", ["SQL"], [], [],
                   [("required", ["JavaScript", "Python", "TypeScript"], 1, "alternative")]),
    "at least two": ("<h3>Minimum Requirements</h3><p>Proficiency in at least two of: Ruby, Node.js, or Next.js</p>", [], [], [],
                     [("required", ["Next.js", "Node.js", "Ruby"], 2, "minimum_count")]),
    "count on the line before": ("<h3>Requirements</h3><p>At least two of the following:</p><p>Ruby, Python, Java</p>", [], [], [],
                                 [("required", ["Java", "Python", "Ruby"], 2, "minimum_count")]),
    "single example": ("<p>Experience with platforms, such as Temporal and AWS Step Functions.</p>", [], [], ["AWS"], []),
    "boilerplate": ("<p>Paid sick leave in compliance with the requirements of the Minimum Wage Act.</p>", [], [], ["Security"], []),
    "sentence scope": ("<p>You have experience with Kafka. You will work with LLMs.</p>", ["Kafka"], [], ["LLMs"], []),
    "continuation": ("<p>You must have Python</p><p>and Docker</p><p>Docker is nice</p>", ["Docker", "Python"], [], [], []),
    "nothing": ("", [], [], [], []),
}


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [("b", name, page[0]) for name, page in CASES.items()]
    frame = X.with_parsed_html(spark.createDataFrame(rows, "board_token string, posting_id string, content string"))
    return {r.posting_id: r for r in R.extract_requirements(frame).collect()}


@pytest.mark.parametrize("name", CASES)
def test_cases(extracted, name):
    row, (_, required, preferred, general, groups) = extracted[name], CASES[name]
    assert (row.required_skills, row.preferred_skills, row.general_skills) == (required, preferred, general)
    assert [(g.section, g.skills, g.min_matches, g.kind) for g in row.requirement_groups] == groups


def sections_model(lines):
    """The reading state as one pass over the lines."""
    section, previous, pending, out = "general", None, None, []
    for line in lines:
        if line["heading"] or line["inline"]:
            section, previous, pending = line["heading"] or line["inline"], None, None
            if line["heading"]:
                continue
        if line["boiler"]:
            here, why = "general", "boilerplate"
        elif line["wants_preferred"]:
            here, why = "preferred", "preferred_language"
        elif section in ("preferred", "required"):
            here, why = section, section + "_section"
        elif line["wants_required"]:
            here, why = "required", "requirement_language"
        else:
            here, why = "general", "general_context"
        if why == "general_context" and previous in ("required", "preferred") and line["continues"]:
            here, why = previous, "continuation_line"
        if line["min_count"] is not None:
            pending = (line["min_count"], here)
        previous = here
        if not line["has_skills"]:
            continue
        forced, own = None, why
        if pending is not None:
            if line["min_count"] is None:
                forced = pending[0]
                if pending[1] != "general":
                    here, why = pending[1], "minimum_count_continuation"
            pending = None
        out.append((line["line_no"], here, why, own, forced))
    return out


def test_reading_state_against_one_pass(spark):
    rng = random.Random(5)
    pages, rows = {}, []
    for page in range(150):
        pages[page] = []
        for n in range(rng.randint(1, 14)):
            kind = rng.random()
            mark = rng.choice(["required", "preferred", "general"])
            line = {
                "page": page, "line_no": n, "heading": mark if kind < 0.15 else None, "inline": mark if 0.15 <= kind < 0.25 else None,
                "boiler": rng.random() < 0.1, "wants_preferred": rng.random() < 0.1, "wants_required": rng.random() < 0.3,
                "continues": rng.random() < 0.4, "has_skills": rng.random() < 0.6,
                "min_count": rng.randint(1, 3) if rng.random() < 0.2 else None,
            }
            pages[page].append(line)
            rows.append(tuple(line.values()))
    frame = spark.createDataFrame(rows, "page int, line_no int, heading string, inline string, boiler boolean, wants_preferred boolean, "
                                        "wants_required boolean, continues boolean, has_skills boolean, min_count int")
    state = R.carry_sections(frame, ["page"]).filter(F.col("heading").isNull() & F.col("has_skills"))
    got = {}
    for r in state.orderBy("page", "line_no").collect():
        got.setdefault(r.page, []).append((r.line_no, r.section, r.reason, r.own_reason, r.forced_min))
    assert got == {p: out for p, lines in pages.items() if (out := sections_model(lines))}


def test_one_shuffle_for_the_whole_extraction(spark):
    frame = X.with_parsed_html(spark.createDataFrame([("b", "1", "<p>Java</p>")], "board_token string, posting_id string, content string"))
    plan = R.extract_requirements(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
