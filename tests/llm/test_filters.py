"""URL rules, languages, quality."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rolegrain.llm import language, quality, queries, url_filter
from rolegrain.llm.hashing import pieces, sliding_argmin

URLS = [
    "https://Sub.Example.ORG/es/a?x#y", "http://example.org/en/1", "http://example.org/en/12/3", "http://example.org/en/2", "http://example.org",
    "http://notexample.org/es/", "http://a.com/fr/", "http://com/de/x", "http://a.com.net/de/", "no scheme", None, "", "x://", "http://h.org?q=/es/", "a://b://c.org/x",
]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    best = None
    for rule, verdict in queries.RULES:
        domain, _, head = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + head) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, "allow"))


def test_rules_against_a_plain_loop_and_a_join(spark):
    rows = spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS + URLS[:1])], "page_id long, url string, rule string")
    expected = [(i, *plain_rule(u)) for i, u in enumerate(URLS + URLS[:1])]
    assert sorted(tuple(r) for r in url_filter.judge(rows, queries.RULES).collect()) == expected
    frame = spark.createDataFrame(queries.RULES, "rule string, verdict string")
    assert sorted(tuple(r) for r in url_filter.judge(rows, frame).collect()) == expected
    assert sorted(tuple(r) for r in url_filter.judge(rows, frame, max_bytes=0).collect()) == expected
    assert url_filter.judge(rows.filter("1 = 0"), queries.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(rows, []).collect()} == {"allow"}


def test_colliding_digests_are_told_apart(tmp_path):
    same = lambda text: len(text) % 2
    file = tmp_path / "list"
    file.write_bytes(url_filter.encode([("ab/", "allow"), ("cd/", "block"), ("efg/", "allow")], same))
    known = url_filter.DigestArray(str(file), same)
    places = known.find([b"cd/", b"ab/", b"xx/", b"efg/", b"zzzz"])
    assert [known.stored(i)[0] if i >= 0 else None for i in places] == [b"cd/", b"ab/", None, b"efg/", None]


@pytest.mark.parametrize("rightmost", [False, True])
def test_sliding_argmin(rightmost):
    keys = np.random.default_rng(1).integers(0, 5, 300).astype(np.uint64) << np.uint64(30)
    for window in (1, 7, 64, 300, 301):
        expected = []
        for i in range(len(keys) - window + 1):
            part = keys[i : i + window]
            expected.append(i + (window - 1 - int(np.argmin(part[::-1])) if rightmost else int(np.argmin(part))))
        assert sliding_argmin(keys, window, rightmost).tolist() == expected


def test_pieces_hold_every_word():
    texts = [b"a b c" * 40, b"", b"x" * 500, b"one two"]
    found = {}
    for owners, parts in pieces(texts, 64):
        assert sum(map(len, parts)) <= 64
        for i, p in zip(owners, parts, strict=True):
            found[i] = found.get(i, b"") + p
    assert found == {i: t for i, t in enumerate(texts) if t}


def test_language_held_out(spark, sf_dir, documents):
    done = queries.QUERIES["op2_language"](spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(done) > 20 and (done["lang"] == done["lang_pred"]).mean() > 0.9
    assert done["score"].between(0, 1).all()


def test_language_of_odd_rows(odd, none):
    model = language.fit(odd, F.lit(True))
    found = language.predict(odd, model, ["doc_id"])
    und = sorted(r["doc_id"] for r in found.filter("lang_pred = 'und'").collect())
    assert und == [1, 2, 4, 8] and found.count() == odd.count()
    assert language.fit(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in language.predict(odd, None, ["doc_id"]).collect()} == {"und"}
    assert language.predict(none, model, ["doc_id"]).count() == 0


def test_folded_scores_equal_the_plain_average():
    texts = [language.plain(t) for t in ("the quick brown fox", "a", "word " * 5000)]
    model = language.train(language.counts(texts) * 4, ["x", "y", "x"] * 4)
    bags = language.counts(texts)
    for got, (bucket, number) in zip(model.scores(texts), bags, strict=True):
        mean = (model.table[:, bucket] * number).sum(axis=1) / number.sum()
        assert np.allclose(got, language.softmax((mean + model.bias)[None] / model.temperature)[0], atol=1e-4)


def test_quality_held_out(spark, sf_dir):
    done = queries.QUERIES["op3_quality"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = done.join(labels, "doc_id").filter("held_out").toPandas()
    assert (held["quality"] == held["predicted"]).mean() > 0.9
    assert done.filter("score between 0 and 1 and predicted = cast(score >= 0.5 as int)").count() == done.count()


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (9, 1, None), (None, 1, 1), (10, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    machine = quality.fit(odd, labels, F.lit(True))
    assert quality.score(odd, machine, ["doc_id"]).count() == odd.count()
    kept = quality.keep_good(odd, machine)
    assert kept.columns == odd.columns and {r["score"] for r in kept.collect()} <= {"own score"}
    assert quality.fit(odd, labels.filter("1 = 0"), F.lit(True)) is None
    assert quality.keep_good(odd, None).count() == odd.count() and quality.keep_good(none, machine).count() == 0


def test_interactions_by_squares_equal_all_pairs():
    rng = np.random.default_rng(2)
    features = [(np.array([1, 5, 9], np.int32), np.array([0.5, 0.2, 0.7], np.float32))]
    statistics = rng.normal(size=(1, len(quality.STATISTICS)))
    width = quality.BUCKETS + len(quality.STATISTICS) * quality.BINS
    machine = quality.Machine(np.sort(rng.normal(size=(len(quality.STATISTICS), quality.BINS - 1)), axis=1), 0.1, rng.normal(size=width) * 0.1, rng.normal(size=(width, 8)) * 0.1)
    at = [1, 5, 9, *machine.places(statistics)[0].tolist()]
    x = [0.5, 0.2, 0.7] + [1.0] * len(quality.STATISTICS)
    logit = 0.1 + sum(w * machine.w[i] for w, i in zip(x, at, strict=True))
    logit += sum(x[a] * x[b] * machine.v[at[a]] @ machine.v[at[b]] for a in range(len(at)) for b in range(a))
    assert np.isclose(machine.scores(features, statistics)[0], 1 / (1 + np.exp(-logit)), atol=1e-5)


def test_statistics_do_not_depend_on_pieces(monkeypatch):
    text = ("Some words, some WORDS! 12 lines\n" * 3000).encode()
    whole = quality.Reader()([text, b"", b"one"], [1.0, -1.0, 3.0])
    monkeypatch.setattr(quality, "pieces", lambda texts, _: pieces(texts, 1 << 12))
    parts = quality.Reader()([text, b"", b"one"], [1.0, -1.0, 3.0])
    assert all((a[0] == b[0]).all() and np.allclose(a[1], b[1]) for a, b in zip(whole[0], parts[0], strict=True))
    assert np.allclose(whole[1], parts[1], rtol=0.05, atol=0.02)


def test_sql_of_rules(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = sorted(connection.execute(queries.SQL["op1_url_filter"]).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op1_url_filter"](spark, sf_dir).select("page_id", "host", "path", "rule", "verdict").collect()) == want


def test_one_verdict_whatever_the_size_of_the_list(spark):
    """A rule with two verdicts, in both orders, through the array and through the join."""
    urls = spark.createDataFrame([(1, "http://a.example.org/x"), (2, "http://b.org/" + "p" * 20_000)], "page_id long, url string").withColumn("verdict", F.lit("own"))
    for pairs in ([("Example.org/x", "block"), ("example.org/x", "allow"), ("org/", "allow")], [("org/", "allow"), ("example.org/x", "allow"), ("EXAMPLE.org/x", "block")]):
        rules = spark.createDataFrame(pairs, "rule string, verdict string")
        for most in (url_filter.MAX_BYTES, 0):
            assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(urls, rules, max_bytes=most).collect()} == {
                1: ("example.org/x", "block"), 2: ("org/", "allow")}
