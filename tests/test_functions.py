import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from rolegrain.functions import columns as C
from rolegrain.functions import html
from rolegrain.functions.batches import SLICE, by_slices, slices
from rolegrain.functions.html import read_html
from rolegrain.functions.literals import required_literals
from rolegrain.functions.spans import find_all
from rolegrain.operators import text as X
from rolegrain.rules import eligibility, skills


def values(spark, column, rows, kind="string"):
    """Evaluate a column function over plain values, in order."""
    frame = spark.createDataFrame(list(enumerate(rows)), f"n int, x {kind}")
    return [r.y for r in frame.select("n", column(F.col("x")).alias("y")).orderBy("n").collect()]


def test_rounding_equals_python(spark):
    rng = random.Random(1)
    numbers = [2.675, 1.005, 0.285, 1.115, 2.5, 0.125, 66.665, -1.005, 0.0]
    numbers += [rng.randint(0, 10**5) / 1000 for _ in range(3000)] + [i / 7 for i in range(2000)]
    assert values(spark, C.round2, numbers, "double") == [round(n, 2) for n in numbers]
    assert values(spark, lambda x: C.round_half_even(x, 3), numbers, "double") == [round(n, 3) for n in numbers]


def test_all_matches_with_offsets(spark):
    texts = ["", "5 years", "a 5 yrs b 10 years", "é 3 years\n12yrs years", "no", "1 year2 years"]
    pattern = r"(\d+)\s*(?:years?|yrs?)\b"
    got = values(spark, lambda x: find_all(x, C.java(pattern)), texts)
    for text, spans in zip(texts, got):
        assert [tuple(s) for s in spans] == [
            (m.start(), m.end(), m.group(0)) for m in re.finditer(pattern, text, re.I)
        ]


def test_literals_never_lose_a_match():
    rng = random.Random(2)
    packs = list(skills.SKILLS.values()) + [row[2] for row in eligibility.CATEGORIES] + [skills.GO_PHRASES]
    parts = [w for pack in packs for p in pack for w in re.findall(r"[a-z+#]+", p)] + [" ", ".", ",", "/", "in", "is"]
    for _ in range(3000):
        text = " ".join(rng.choice(parts) for _ in range(6))
        for pack in packs:
            if any(re.search(p, text, re.I) for p in pack):
                assert any(literal in text for literal in required_literals(pack))


def test_chunks(spark):
    def model(text, size=120, overlap=25):
        words = text.split()
        if not text:
            return []
        if len(words) <= size:
            return [text]
        out, at = [], 0
        while True:
            out.append(" ".join(words[at:at + size]))
            if at + size >= len(words):
                return out
            at += size - overlap

    texts = ["", "one  two", *[" ".join(f"w{i}" for i in range(n)) for n in (119, 120, 121, 215, 216, 400)]]
    assert values(spark, X.chunk_words, texts) == [model(t) for t in texts]


def test_sentences(spark):
    got = values(spark, X.split_sentences, ["Use e.g. Java. Then Go! now? 5 more. U.S. law. X", ""])
    assert got == [["Use e.g. Java.", "Then Go! now?", "5 more. U.S. law.", "X"], []]


def test_names_and_lists(spark):
    assert values(spark, X.pretty_name, ["ai_ml_engineer", "x-RAY o'neil"]) == ["Ai Ml Engineer", "X-Ray O'Neil"]
    assert values(spark, lambda x: X.format_list(F.split(x, ","), 2), ["a", "a,b,c,d"]) == ["a", "a, b (+2 more)"]


def test_board_token(spark):
    rows = [
        " acme/ ", "https://boards.greenhouse.io/acme", "https://job-boards.greenhouse.io/embed/job_board?for=acme",
        "https://example.com/acme", "https://boards.greenhouse.io/embed/", "",
    ]
    assert values(spark, X.board_token, rows) == ["acme", "acme", "acme", None, None, None]


def test_html_reader():
    assert read_html("&lt;p&gt;A &amp;amp; B&lt;/p&gt;") == ("A & B", ["A & B"])
    assert read_html("<ul><li><p>x</p> y</li></ul><script>var p='<p>';</script>z") == ("x y z", ["x y"])
    assert read_html("<div>a<br>b<!-- c --></div>") == ("a b", None)
    assert read_html("<p>a<p>b</p></p> tail") == ("a b tail", ["a b"])
    assert read_html("") == ("", []) == read_html(None)


def test_very_many_matches(spark):
    """More matches than a block of running lengths holds, on both sides of the border."""
    for count in (255, 256, 257, 1500):
        text = "é" + " ".join(f"{n} years" for n in range(count))
        got = values(spark, lambda x: find_all(x, C.java(r"(\d+)\s*years\b")), [text, None])
        assert [tuple(s) for s in got[0]] == [(m.start(), m.end(), m.group(0)) for m in re.finditer(r"\d+ years", text)]
        assert got[1] is None


def test_values_are_not_cut(spark):
    long = "x" * 9000
    assert values(spark, C.safe_text, [f" {long} ", "  ", None]) == [long, None, None]
    listed = [f"v{i % 400}" for i in range(800)] + [" ", None]
    assert values(spark, C.safe_list, [listed], "array<string>") == [[f"v{i}" for i in range(400)]]
    assert values(spark, lambda x: C.safe_list(x, 2, 1), [[" ", "ab", "a", "c", "d"]], "array<string>") == [["a", "c"]]
    assert values(spark, lambda x: C.nonneg_int(x, 7), ["3000000000", "-5", "x", None]) == [3000000000, 0, 7, 7]


def test_parts_of_a_date_are_no_timestamps(spark):
    rows = ["2026", "2026-09", "12:30", "T10", "2026-09-04", "2026-09-04T01:02:03Z", "2026-09-04 01:02+02:00", "2026-13-04", None]
    got = values(spark, lambda x: F.unix_timestamp(X.parse_utc(x)), rows)
    assert got == [None, None, None, None, 1788480000, 1788483723, 1788476520, None, None]


def test_python_steps_hold_a_slice_of_a_batch(spark):
    pages = [f"&lt;p&gt;{n}&lt;/p&gt;{'é' * 20_000}" for n in range(300)] + [None, ""]
    column = pa.array(pages, pa.string())
    parts = list(slices(column))
    assert pa.concat_arrays(parts).equals(column) and len(parts) > 8 and max(p.nbytes for p in parts) <= SLICE
    assert [len(p) for p in slices(pa.array(["x" * 100, "y", "z"]), 50)] == [1, 2] and len(list(slices(column[:0]))) == 1
    # What a step returns is cut like what it reads, so a worker never holds a whole batch's result.
    read = list(by_slices(html._parsed)(iter([column, column[:0], column[:2]])))
    assert [len(r) for r in read] == [*map(len, parts), 0, 2]
    assert [tuple(x.as_py().values()) for x in pa.concat_arrays(read[:-2])] == [read_html(p) for p in pages]
    got = spark.createDataFrame(list(enumerate(pages)), "n int, x string").repartition(2).select("n", html.parse_html("x").alias("p")).orderBy("n").collect()
    assert [tuple(r["p"]) for r in got] == [read_html(p) for p in pages]
