"""Winnowing, repeated byte strings, SimHash."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

import corpus_pipeline
from rolegrain.llm import queries, simhash, suffixes, winnowing


def test_winnowing_guarantee_and_rightmost_ties():
    winnow = winnowing.Winnower(5, 4)
    shared = "wxyz1234"  # window + gram - 1
    one, other = winnow("aaaa bbbb " + shared + " cc"), winnow("zzz" + shared + "tail of another text")
    assert set(one[0].tolist()) & set(other[0].tolist())
    hashes, places = winnow("a" * 20)
    assert places.tolist() == list(range(3, 16)) and len(set(hashes.tolist())) == 1
    assert len(winnow("")[0]) == 0 and len(winnow("ab")[0]) == 1


def test_edited_texts(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_winnowing"](spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    winnow = winnowing.Winnower()
    for i, doc in enumerate(order):
        text, follower = texts[doc] or "", texts[order[(i + 1) % len(order)]] or ""
        part = len(text) // 3
        edited = text[: len(text) - part] + follower[:part]
        row = rows[doc]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, after = (set(winnow(t)[0].tolist()) for t in (text, edited, follower))
        assert row["near_edited"] == pytest.approx(len(own & changed) / len(own | changed) if own | changed else 1.0)
        assert row["near_next"] == pytest.approx(len(own & after) / len(own | after) if own | after else 1.0)
        assert row["fingerprint"] == winnowing.digest(*winnow(text)) and row["edited_fingerprint"] == winnowing.digest(*winnow(edited))


def test_winnowing_of_odd_rows(odd, none):
    rows = winnowing.compare_edited(odd).collect()
    assert len(rows) == odd.count() and len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    single = winnowing.compare_edited(odd.filter("doc_id = 9")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0
    assert winnowing.compare_edited(none).count() == 0
    assert winnowing.fingerprints(odd).count() == odd.count()


def plain_removed(datas, length):
    seen = {}
    for data in datas:
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            seen[part] = seen.get(part, 0) + 1
    out = []
    for data in datas:
        covered = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                covered[i : i + length] = True
        runs = suffixes.spans_of(covered)
        out.append((len(data), int(covered.sum()), len(runs[0]), hashlib.sha256(bytes(b for b, c in zip(data, covered, strict=True) if not c)).hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=6), st.integers(2, 9))
def test_interval_expansion_against_all_strings(segments, length):
    segments = [s.encode() for s in segments]
    seen = {}
    for s in segments:
        for i in range(len(s) - length + 1):
            seen[s[i : i + length]] = seen.get(s[i : i + length], 0) + 1
    expected = [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in segments]
    assert [m.tolist() for m in suffixes.repeated_starts(segments, length)] == expected


@pytest.mark.parametrize("group", [1000, 3])
def test_repeated_strings_against_all_strings(spark, group):
    """The small group limit sends shared passages through blocks and single strings."""
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(rng.choice(list("abcdé "), n))
    passage, near = letters(120), letters(150)
    rows = [letters(30) + passage + letters(int(n)) for n in rng.integers(0, 60, 12)] + [near[:k] + "#" + near[k:] for k in (20, 60, 61, 100, 149)]
    rows += [rows[0], rows[0], "", None, "short", "ab" * 200, "x" * 90, passage[:59], letters(300)]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(rows)] + [(7, rows[3]), (7, rows[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.remove(docs, ["doc_id"], length=60, group=group).collect()
    want = plain_removed([(t or "").encode() for _, t in rows], 60)
    key = lambda x: (x[0] is None, *map(str, x))
    assert sorted([tuple(r) for r in got], key=key) == sorted([(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=key)


def test_phrases_said_over_and_over_against_all_strings(spark):
    """Equal segments of a text are one row that keeps all places, so what is joined grows with texts and kinds."""
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(rng.choice(list("abcdé "), n))
    phrases = ["ox it ", "x", "so be it, "]
    rows = [letters(20) + phrase * n + letters(20) for phrase in phrases for n in (7, 40, 60)] + ["ox it " * 50, letters(200), "", None]
    rows = [(i if i % 4 else None, t) for i, t in enumerate(rows)] + [(1, rows[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    segments = suffixes.anchored(docs, 60, 30).collect()
    assert len(segments) < sum(len(r["starts"]) for r in segments) / 4
    assert all(r["places"] == len(r["starts"]) and r["starts"] == sorted(set(r["starts"])) for r in segments)
    assert sum(r["places"] * r["count"] for r in segments) == sum(max(0, len((t or "").encode()) - 59) for _, t in rows)
    got = suffixes.remove(docs, ["doc_id"], length=60).collect()
    want = plain_removed([(t or "").encode() for _, t in rows], 60)
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *w)) for (i, _), w in zip(rows, want, strict=True))


def test_repeated_strings_query(spark, sf_dir, texts):
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op5_suffix_dedup"](spark, sf_dir).collect()}
    order = sorted(texts)
    assert [rows[i] for i in order] == plain_removed([(texts[i] or "").encode() for i in order], 400)


def test_cut_texts_of_odd_rows(odd, none):
    done = suffixes.cut_texts(odd)
    assert done.columns == odd.columns and done.count() == odd.count()
    rows = done.collect()
    assert all(r["n_chars"] == len(r["text"]) and r["spans"] == "own spans" for r in rows)
    assert [r["text"] for r in rows if r["doc_id"] == 10] == [""]
    assert suffixes.cut_texts(none).count() == 0


def plain_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """``prints``: (id, fingerprint) pairs."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if label[j] < label[i] and (a ^ b).bit_count() <= radius:
                    label[i], changed = label[j], True
    groups = {}
    for (key, _), own in zip(prints, label, strict=True):
        groups.setdefault(own, []).append(key)
    return {own: min((k for k in keys if k is not None), default=None) for own, keys in groups.items()}, label


def test_simhash_query(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op10_simhash"](spark, sf_dir).collect()}
    prints = [(i, plain_fingerprint(texts[i], 4)) for i in sorted(texts)]
    names, label = plain_components(prints, 4)
    for (i, fp), own in zip(prints, label, strict=True):
        assert rows[i]["fingerprint"] == f"{fp:016x}" and rows[i]["component_id"] == names[own]


@pytest.mark.parametrize("limit", [2048, 5])
def test_links_through_blocks(spark, limit):
    """Chains of near fingerprints, in shards far beyond the limit."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 63))
    values = {centre}
    for _ in range(60):
        base = int(rng.choice(np.array(sorted(values), np.uint64)))
        values.add(base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 7)), replace=False)))
    values |= {int(v) for v in rng.integers(0, 1 << 63, 30)} | {0, (1 << 64) - 1}
    prints = [(i, v) for i, v in enumerate(sorted(values))]
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for _, v in prints], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 4, limit)).collect()}
    _, label = plain_components(prints, 4)
    signed = [v - (1 << 64) if v >> 63 else v for _, v in prints]
    roots = [found.get(v, v) for v in signed]
    assert [[a == b for b in roots] for a in roots] == [[a == b for b in label] for a in label]


def test_search_of_a_tree_is_exact():
    rng = np.random.default_rng(6)
    nodes = np.concatenate([np.unique(rng.integers(0, 1 << 12, n)) for n in (400, 1, 30)]).astype(np.uint64)
    cell = np.sort(rng.integers(0, 3, len(nodes)))
    asked, of = rng.integers(0, 1 << 12, 50).astype(np.uint64), rng.integers(0, 4, 50)
    got = {(q, n) for hits, at in simhash.BKTrees(nodes, cell).search(asked, of, 2) for q, n in zip(hits.tolist(), at.tolist(), strict=True)}
    assert got == {(q, n) for q in range(50) for n in range(len(nodes)) if of[q] == cell[n] and int(asked[q] ^ nodes[n]).bit_count() <= 2}


def test_simhash_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    group = {r["doc_id"]: r["component_id"] for r in rows}
    assert group[1] == group[2] == group[8] == 1 and group[5] == group[6] == 5
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 3, 4, 5, 7, 9, 10, None]
    assert simhash.near_duplicates(none).count() == 0


def plain_shingles(text, shingle=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def plain_similar(texts):
    """Label per text: components of all pairs whose Jaccard similarity is 0.8 or more."""
    sets, label = [plain_shingles(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    return label, pairs


def test_similar_texts_against_all_pairs(spark):
    """Pairs around the limit, a chain, a group of near copies, and a passage that unlike texts share."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    changed = lambda own, places: [f"new{rng.integers(1 << 40)}" if i in places else w for i, w in enumerate(own)]
    texts = []
    for share in (0.01, 0.015, 0.02, 0.022, 0.025, 0.03) * 6:
        own = words(int(rng.integers(100, 400)))
        texts += [own, changed(own, set(rng.integers(0, len(own), max(1, int(share * len(own)))).tolist()))]
    chain = words(200)
    for at in range(6):
        texts.append(chain := changed(chain, {30 * at + 5, 30 * at + 15}))
    base, passage = words(150), words(60)
    texts += [changed(base, {int(rng.integers(150))}) for _ in range(40)] + [words(40) + passage + words(40) for _ in range(40)]
    texts = [" ".join(t) for t in texts] + ["one two three", "One  two three", "one two three four", " \n", "", None]
    label, pairs = plain_similar(texts)
    assert len(pairs) > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    roots = {r["doc_id"]: r["root"] for r in simhash.similar_groups(docs).collect()}
    found = [roots[i] for i in range(len(texts))]
    assert [found.index(r) for r in found] == [label.index(x) for x in label]
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == sorted(set(label))


def test_trees_of_fingerprints_link_the_pipelines_groups(spark, monkeypatch):
    """Without the lists' pairs, groups are what the fingerprints link and the whole sets confirm."""
    rng = np.random.default_rng(5)
    texts = []
    for n in range(40):
        own = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        other = [*own[:150], f"new{n}", *own[151:]] if n % 2 else [*own[:100], *(f"x{n}y{i}" for i in range(100)), *own[200:]]
        texts += [" ".join(own), " ".join(other)]
    texts += ["v " * 40, "v " * 50 + "v", "", None]
    monkeypatch.setattr(simhash.shingles, "hub_pairs", lambda found: found.selectExpr("node as one", "hub as other").limit(0))
    monkeypatch.setattr(simhash.shingles, "open_pairs", lambda found, roots: found.selectExpr("node as one", "hub as other").limit(0))
    roots = {r["doc_id"]: r["root"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bits = [simhash.text_fingerprint(t, 5) for t in texts]
    near = {n for n in range(0, len(texts), 2) if (bits[n] ^ bits[n + 1]).bit_count() <= 4}
    alike = {n for n in near if 5 * len(plain_shingles(texts[n]) & plain_shingles(texts[n + 1])) >= 4 * len(plain_shingles(texts[n]) | plain_shingles(texts[n + 1]))}
    assert {n for n in range(0, len(texts), 2) if roots[n] == roots[n + 1]} == alike and len(alike) > 8
    assert len(set(roots.values())) == len(texts) - len(alike)


def test_edited_copies_around_the_limit(spark):
    """A family of copies with few and many edits, of several lengths, read in small batches so that lists cross them."""
    rng = np.random.default_rng(21)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for n in range(70):
        own = base[: int(rng.integers(230, 301))] if n % 3 == 0 else list(base)
        for at in rng.integers(0, len(own), int(rng.integers(1, 16))):
            own[at] = f"new{rng.integers(1 << 40)}"
        texts.append(" ".join(own))
    label, pairs = plain_similar(texts)
    assert 1 < len(set(label)) < len(texts) and len(pairs) > 100
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        roots = {r["doc_id"]: r["root"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = [roots[i] for i in range(len(texts))]
    assert [found.index(r) for r in found] == [label.index(x) for x in label]


def test_keep_first_keeps_rows_not_ids(spark):
    """Several documents without an id, and one id with two texts."""
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [
        (None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (None, text("d") + " more"), (3, text("d")),
        (5, text("e")), (5, text("f")), (5, text("f")), (4, text("f") + " more"), (None, None), (None, ""), (6, text("g")), (6, text("h")), (7, text("g")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r["doc_id"], r["text"] or "") for r in simhash.keep_first(docs).collect()), key=str)
    want = [(None, text("a")), (None, text("b")), (None, text("c")), (3, text("d")), (5, text("e")), (4, text("f") + " more"), (None, ""), (6, text("g")), (6, text("h"))]
    assert kept == sorted(want, key=str)


def plain_words_removed(texts, words):
    """What remains when every passage of ``words`` words that starts twice goes, with the white space behind it."""
    own = [[(m.group(), m.start()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    seen = {}
    for row in own:
        for i in range(len(row) - words + 1):
            part = tuple(w for w, _ in row[i : i + words])
            seen[part] = seen.get(part, 0) + 1
    out = []
    for text, row in zip(texts, own, strict=True):
        kept, starts = np.ones(len(text), bool), [s for _, s in row] + [len(text)]
        for i in range(len(row) - words + 1):
            if seen[tuple(w for w, _ in row[i : i + words])] > 1:
                kept[starts[i] : starts[i + words]] = False
        out.append(bytes(b for b, k in zip(text, kept, strict=True) if k).decode())
    return out


def test_passages_of_over_50_words(spark, sf_dir):
    """Passages of 51 words go however short the words are, those of 50 stay."""
    rng = np.random.default_rng(9)
    words = lambda n, size=7: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), int(rng.integers(1, size)))) for _ in range(n)]
    passages = [words(51), words(51, 2), words(50), words(50, 4), words(51, 11), words(57)]
    rows = [" ".join(words(30) + p + words(30)) for p in passages for _ in range(3)]
    rows += ["\n ".join(["x", *passages[0], "y"]), " ".join(passages[0]), " ".join(passages[1][:-1]), "", " ", None, rows[3], "k " * 60]
    rows = [(i if i % 4 else None, t) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).collect()
    want = plain_words_removed([(t or "").encode() for _, t in rows], 51)
    assert sum(len(t or "") - len(w) for (_, t), w in zip(rows, want, strict=True)) > 2000
    assert sorted(map(str, got)) == sorted(str(Row(doc_id=i, text=w)) for (i, _), w in zip(rows, want, strict=True))
