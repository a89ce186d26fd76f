import random
import re

import pytest
from pyspark.sql import functions as F

from rolegrain.operators import eligibility as G
from rolegrain.operators import experience as E
from rolegrain.operators import filters as L
from rolegrain.rules import eligibility as ER
from rolegrain.rules import experience as XR
from tests.test_functions import values

PROFILES = {
    "DevOps Engineer, Security": "devops_engineer", "IT Systems Engineer": "systems_engineer",
    "Software Engineer - AI Enablement": "ai_ml_engineer", "Software Engineer, Platform": "software_engineer",
    "Software Engineer, Gen AI": "ai_ml_engineer", "Full Stack Engineer": "fullstack_engineer",
    "Software Engineer - Full-Stack": "fullstack_engineer", "Front End Engineer": "frontend_engineer",
    "Backend Engineer, Core": "backend_engineer", "Site Reliability Engineer": "devops_engineer",
    "Application Support Engineer": "production_support_engineer", "LLM Engineer": "ai_ml_engineer",
    "Full Stack Machine Learning Engineer": "ai_ml_engineer", "": "software_engineer",
}


def test_profiles(spark):
    assert values(spark, L.classify_profile, list(PROFILES)) == list(PROFILES.values())


def test_roles(spark):
    rows = ["Software Engineer", "Sr. Software Engineer", "Product Designer", "SRE", "Lead ML Engineer", "Headless Software Engineer"]
    assert values(spark, L.keep_role, rows) == [True, False, False, True, False, True]


def test_title_exclusion(spark):
    rows = ["Software Engineer Intern", "Engineer - Contract", "Smart Contract Engineer (Contract)", "Engineer, contract ",
            "Engineer, 6 month contract", "Internal Tools Engineer", "Co-op Engineer"]
    assert values(spark, L.title_exclusion, rows) == ["intern", "- contract", None, ", contract", "6 month contract", None, "co-op"]


@pytest.mark.parametrize("place, status", [
    ("San Francisco, CA", "US"), ("Toronto, CA", "US"), ("Indianapolis", "NON_US"), ("Georgia", "US"), ("London", "NON_US"),
    (" n/a ", "UNKNOWN"), ("Remote", "UNKNOWN"), ("US", "US"), ("Remote, US", "US"), ("Lagos", "UNKNOWN"), ("Paris | NY", "US"),
])
def test_locations(spark, place, status):
    assert values(spark, L.classify_location_text, [place]) == [status]


CASES = [
    ("Build software for public-sector customers.", "PASS"), ("No security clearance required for this position.", "PASS"),
    ("Applicants are considered regardless of citizenship.", "PASS"), ("You must be authorized to work here.", "PASS"),
    ("U.S. citizenship is required for this position.", "NEEDS_ASSISTANCE"), ("Hold an active Top Secret clearance.", "NEEDS_ASSISTANCE"),
    ("We are unable to provide visa sponsorship.", "NEEDS_ASSISTANCE"), ("Applicants must qualify as a U.S. person (ITAR).", "NEEDS_ASSISTANCE"),
    ("A current professional certification is required.", "NEEDS_ASSISTANCE"),
]


def test_eligibility_cases(spark):
    got = values(spark, lambda x: G.decide(G.first_findings(G.combined_text(F.lit("Engineer"), x)))["decision"], [c[0] for c in CASES])
    assert got == [c[1] for c in CASES]


def test_findings_against_plain_search(spark):
    rng = random.Random(3)
    bits = [c[0] for c in CASES] + ["no clearance required", "x " * 70, "must hold a license", "no sponsorship now"]
    texts = [" ".join(rng.sample(bits, 4)) for _ in range(40)]

    def model(text):
        low = "t. " + " ".join(text.split()).lower()
        out = []
        for category, _, patterns, exceptions in ER.CATEGORIES:
            if any(re.search(p, low) for p in exceptions):
                continue
            for p in patterns:
                out += [(category, low[max(0, m.start() - 120):m.end() + 120].strip()) for m in re.finditer(p, low)]
        return out

    everything = lambda x: G.all_findings(G.combined_text(F.lit("T"), x))
    first = lambda x: G.first_findings(G.combined_text(F.lit("T"), x))
    for text, found, kept in zip(texts, values(spark, everything, texts), values(spark, first, texts)):
        expected = model(text)
        assert [(f.category, f.evidence) for f in found] == expected
        firsts = {}
        for category, evidence in expected:
            firsts.setdefault(category, evidence)
        assert {f.category: f.evidence for f in kept} == firsts


def mentions_model(text):
    taken, out = [], []
    for kind, pattern in XR.MENTION_KINDS:
        for m in re.finditer(pattern, text, re.I):
            s, e = m.span()
            if any(s < b and e > a for a, b in taken):
                continue
            around = text[max(0, s - 140):e + 140].strip().lower()
            if "experience" not in around:
                continue
            if any(t in around for t in XR.DEGREE_TERMS) and "experience" not in text[max(0, s - 25):e + 50].lower():
                continue
            numbers = [int(g) for g in m.groups()]
            out.append((kind, m.group(0), min(numbers), max(numbers), any(w in around for w in XR.PREFERRED_WORDS), s, e))
            taken.append((s, e))
    return out


def test_mentions_against_sequential_model(spark):
    rng = random.Random(4)
    bits = ["2-5 years", "3 to 6 yrs", "at least 5 years", "minimum of 4 years", "7+ years", "10 years", "of experience", "preferred",
            "year degree", "word " * 20, "4-year bachelor's degree", "foreign degree", "and", "Ünïcode", "experience with Java", "a plus"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = E.with_mentions(frame).withColumn("status", E.classify_experience(F.col("mentions"))).orderBy("n").collect()
    for text, row in zip(texts, rows):
        expected = mentions_model(text)
        got = [(m.type, m.match, m.min_years, m.max_years, m.preferred, m.start, m.end) for m in row.mentions]
        assert got == expected, text
        years = [m[2] for m in expected if not m[4]]
        assert row.status == ("REJECT" if any(y >= 5 for y in years) else "REVIEW" if 4 in years else "ACCEPT")


def test_years_of_any_size_and_script(spark):
    texts = ["99999999999 years of experience", "٣ years of experience", "9" * 30 + " years of experience", "5 years of experience"]
    frame = E.with_mentions(spark.createDataFrame(list(enumerate(texts)), "n int, text string"))
    got = {r.n: (r.mentions[0].min_years, r.status) for r in frame.withColumn("status", E.classify_experience(F.col("mentions"))).collect()}
    assert got == {0: (99999999999, "REJECT"), 1: (3, "ACCEPT"), 2: ((1 << 63) - 1, "REJECT"), 3: (5, "REJECT")}
