"""One automaton for all packs against every pattern on its own."""

import pickle
import random
import re

from pyspark.sql import functions as F

from rolegrain.functions.matcher import Matcher, matches, matches_each
from rolegrain.operators import requirements as R
from rolegrain.rules import skills as S

GROUPS = {"skills": R._skill_patterns(), "cues": {"required": S.REQUIRED_LINES, "continues": S.CONTINUATIONS}}
FOLLOW = {"liked": ("skills", "preferred", {"Java": r"\bjava\b\s*preferred", "Go": r"\bgo\b\s*preferred"})}


def plain(low):
    found = {g: sorted(n for n, pack in packs.items() if any(re.search(p, low) for p in pack)) for g, packs in GROUPS.items()}
    found["liked"] = sorted(n for n, p in FOLLOW["liked"][2].items() if n in found["skills"] and re.search(p, low))
    return found


def texts(count):
    rng = random.Random(3)
    words = ["java", "javascript", "go", "golang", "c++", "c#", "c sharp", "node.js", "nodejs", "ci/cd", "(aws)", "experience with", "experience in go", "preferred", "and", "or",
             ", ", "must  have", "at least two of", "ünder", "sql", "pl/sql", "rest", "restful api", "xjava", "javax", "", "é", "spark\n"]
    return [rng.choice(["", "", " "]).join(" " * rng.randint(0, 1) + rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(count)]


def test_against_single_patterns():
    matcher = pickle.loads(pickle.dumps(Matcher(GROUPS, FOLLOW)))
    for low in [None, *texts(3000)]:
        assert matcher.search(low) == (plain(low) if low else {g: [] for g in ("skills", "cues", "liked")}), low


def test_columns(spark):
    matcher = Matcher(GROUPS, FOLLOW)
    sample = [*texts(40), None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(sample)], "i int, t string")
    empty = {"skills": [], "cues": [], "liked": []}
    for r in frame.withColumn("f", matches(matcher)("t")).collect():
        assert r.f.asDict() == (plain(r.t) if r.t else empty)
    pairs = frame.withColumn("l", F.when(F.col("t").isNotNull(), F.array("t", F.lit("java"))))
    for r in pairs.withColumn("f", matches_each(matcher, "skills")("l")).collect():
        assert r.f == (None if r.t is None else [plain(r.t)["skills"], ["Java"]])
