import random
import re

import pytest

from rolegrain.operators import forms as K
from rolegrain.rules import forms as R
from rolegrain.schemas import FORM_FIELD

DECISIONS = [
    ("First Name", "text", "", "FIRST_NAME"), ("Preferred First Name", "text", "", "PREFERRED_FIRST_NAME"), ("Phone", "tel", "", "PHONE"),
    ("Attach", "file", "Resume/CV Attach", "RESUME"), ("Attach", "file", "Cover Letter Attach", "COVER_LETTER_UPLOAD"),
    ("Are you currently eligible to work legally in the United States of America?", "text", "", "WORK_AUTHORIZATION_US"),
    ("Do you currently require sponsorship to start employment?", "text", "", "SPONSORSHIP_NOW"),
    ("Will you require sponsorship in the future?", "text", "", "SPONSORSHIP_FUTURE"),
    ("Will you now (or in the future) require visa sponsorship?", "text", "", "SPONSORSHIP_NOW_OR_FUTURE"),
    ("LinkedIn Profile*", "text", "Do you now or in the future require visa sponsorship?", "LINKEDIN"),
    ("What is your military status?", "text", "", "VOLUNTARY_DEMOGRAPHIC"), ("Country*", "text", "", "COUNTRY"), ("Location (City)*", "text", "", "CITY"),
    ("What is your preferred office location?", "text", "", "OFFICE_PREFERENCE"), ("g-recaptcha-response", "textarea", "", "TECHNICAL_CONTROL"),
    ("Describe your favorite technical problem.", "textarea", "", "UNKNOWN_CUSTOM_FIELD"), ("I identify as:", "text", "", "VOLUNTARY_DEMOGRAPHIC"),
    ("Name", "radio", "", "UNKNOWN_CUSTOM_FIELD"), ("", "text", "Desired salary", "COMPENSATION_EXPECTATION"),
]


def test_decisions(spark):
    rows = [(i, label, kind, None, "", context) for i, (label, kind, context, _) in enumerate(DECISIONS)]
    frame = spark.createDataFrame(rows, "n int, label string, type string, name string, placeholder string, context_text string")
    got = K.with_decision(frame).orderBy("n").select("decision.category").collect()
    assert [r.category for r in got] == [d[3] for d in DECISIONS]


def plain(text):
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip()


def grouping_model(fields):
    """Fields in order, folded into groups."""
    groups, last = {}, None
    for f in fields:
        kind = f["type"]
        if kind in R.SKIPPED_TYPES or "captcha" in " ".join([f["name"], f["id"], f["label"], f["context_text"]]).lower():
            continue
        before = groups.get(last)
        label, context = plain(before["label"]) if before else "", plain(f["context_text"])
        if (before and not plain(f["label"]) and not f["name"] and not f["placeholder"] and kind in ("text", "search") and label and context
                and (label in context or context in label)):
            before["indices"].append(f["index"])
            continue
        if kind == "file":
            said = plain(f["label"] + " " + f["context_text"])
            key = ("file", "resume" if "resume" in said else "letter" if "cover letter" in said else f["index"])
        elif f["name"]:
            key = (kind if kind in R.CHOICE_TYPES else "named", f["name"])
        else:
            key = ("field", plain(f["label"])) if plain(f["label"]) else ("single", f["index"])
        if key not in groups:
            groups[key] = {"label": f["label"], "type": kind, "context": f["context_text"], "required": f["required"],
                           "options": list(f["options"]), "indices": [f["index"]]}
        else:
            g = groups[key]
            g["indices"].append(f["index"])
            g["required"] |= f["required"]
            g["options"] += [o for o in dict.fromkeys(f["options"]) if o and o not in g["options"]]
            if R.TYPE_PRIORITY.get(kind, 0) > R.TYPE_PRIORITY.get(g["type"], 0):
                g["type"] = kind
            if len(f["context_text"]) > len(g["context"]):
                g["context"] = f["context_text"]
        last = key
    return [tuple(g.values()) for g in groups.values()]


def test_grouping_against_fold(spark):
    rng = random.Random(7)
    rows, pages = [], {}
    for page in range(120):
        pages[page] = []
        for n in range(rng.randint(1, 10)):
            f = {
                "index": n, "tag": "input", "type": rng.choice(["text", "text", "search", "tel", "file", "radio", "hidden", "textarea"]), "id": "",
                "name": rng.choice(["", "", "", "n1", "n2"]), "label": rng.choice(["", "", "Phone", "Email*", "Attach", "captcha box"]),
                "option_label": "", "placeholder": rng.choice(["", "", "", "hint"]),
                "context_text": rng.choice(["", "Phone number", "your email", "Resume/CV", "Cover Letter", "mail"]),
                "required": rng.random() < 0.5, "value": "", "options": rng.sample(["a", "b", "", "c"], rng.randint(0, 3)),
            }
            pages[page].append(f)
            rows.append((page, tuple(f.values())))
    raw = spark.createDataFrame(rows, f"page_id int, f {FORM_FIELD}").select("page_id", "f.*")
    got = {}
    for r in K.group_fields(raw).orderBy("page_id", "first_index").collect():
        got.setdefault(r.page_id, []).append((r.label, r.type, r.context_text, r.required, r.options, r.dom_indices))
    assert got == {p: out for p, fields in pages.items() if (out := grouping_model(fields))}


@pytest.mark.parametrize("path, name", [("/a/b/c.pdf", "c.pdf"), ("c.pdf", "c.pdf"), ("", None)])
def test_base_name(spark, path, name):
    from tests.test_functions import values

    assert values(spark, K.base_name, [path]) == [name]


def shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_controls_and_fields_that_lie_by_page_are_not_moved(spark):
    controls = [(page, n, "", ["Email", "", "x Email", ""][n % 4], "input", "text", "", "", "x Email", False, "", []) for page in range(5) for n in range(6)]
    raw = spark.createDataFrame(controls, "page_id int, index int, name string, label string, tag string, type string, id string, placeholder string, "
                                          "context_text string, required boolean, value string, options array<string>")
    assert shuffles(K.group_fields(raw.repartition(3, "page_id"))) == 1
    resolved = spark.createDataFrame(
        [(1, "a", 1, "READY", "EMAIL"), (1, "b", 0, "READY", "PHONE"), (1, "c", 2, "READY", None), (1, "d", 3, "POLICY_MISMATCH", "EMAIL"), (2, "e", 0, "MISSING_RESUME", "")],
        "page_id int, label string, first_index int, status string, key string",
    ).selectExpr("page_id", "label", "first_index", "status", "true as required", "'profile' as source", "null as display_answer",
                 "named_struct('category', 'C', 'action', 'A', 'reason', 'r', 'answer_key', key, 'fixed_answer', null) as decision").repartition(3, "page_id")
    pages = spark.createDataFrame([(1,), (2,), (3,), (4,)], "page_id int").selectExpr(
        "page_id", "'u' as requested_url", "'t' as page_title", "'co' as company", "'job' as job_title", "null as resume_path", "false as challenge_detected",
        "array('x') as challenge_reasons", "0 as submit_attempts_blocked", "false as nonready_mutation_detected", "'' as nonready_mutation_reason",
    ).repartition(3, "page_id")
    fills = spark.createDataFrame(
        [(1, "FILL_FAILED", "EMAIL"), (1, "FILL_FAILED", "EMAIL"), (1, "FILLED", "PHONE"), (2, "FILL_FAILED", ""), (2, "FILL_FAILED", None), (3, "FILL_FAILED", "PHONE")],
        "page_id int, status string, answer_key string",
    ).selectExpr("*", "null as label", "null as category", "true as required", "null as source", "null as reason", "0 as place").repartition(3, "page_id")
    packets = K.build_handoffs(pages, resolved, fills)
    assert shuffles(packets) == 3  # the three of this test
    got = {r["page_id"]: ([i["label"] for i in r["deterministic_ready"]], [i["label"] for i in r["human_assistance"]], r["summary"]["policy_mismatches"],
                          r["summary"]["missing_resume"], [x for x in r["route_reasons"] if "fill(s)" in x]) for r in packets.collect()}
    failed, count = "[unlabeled field]", "{} deterministic browser fill(s) failed.".format
    assert got == {
        1: (["b", "c"], ["d", failed, failed], 1, 0, [count(2)]), 2: ([], ["e", failed, failed], 0, 1, [count(2)]),
        3: ([], [failed], 0, 0, [count(1)]), 4: ([], [], 0, 0, []),
    }
