"""Exact search, conversation tries and spelling variants against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolegrain.llm import metric_tree, spelling, turn_trie

END = 2**63 - 1


def plain_search(rows, asked, k=5):
    """Results by scoring every pair with Python integers."""
    def whole(v):
        if not v or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            return None
        return tuple(max(-END - 1, min(END, math.floor(x * 256))) for x in v)

    known = {(i, whole(v)) for i, v in rows if whole(v)}
    out = []
    for i, v in sorted(({(i, whole(v)) for i, v in asked if whole(v)}), key=str):
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0) for j, w in known if (j, w) != (i, v) and len(w) == len(v)]
        out += [(i, n + 1, None if unnamed else j, max(-END - 1, min(END, -s))) for n, (s, unnamed, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("id", "v", "cell", "mark", "score", "rank", "block")})


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_search_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 3
    data = [(i, (centres[i % 12] + rng.standard_normal(16) / 8).round(3).tolist()) for i in range(1500)]
    data += [(2000 + i, data[7][1]) for i in range(700)]  # one vector is a third of all rows
    rows = vectors_of(spark, data)
    asked = rows.filter("vec_id % 50 = 0")
    expected = plain_search(data, [x for x in data if x[0] % 50 == 0])
    assert found(metric_tree.search(rows, asked, cell=100)) == expected
    # Small trees, several tasks per tree.
    assert found(metric_tree.search(rows, asked, cell=400, tree_bytes=1, served=3)) == expected


def test_search_of_odd_vectors(spark):
    data = [
        (50, [0.0, 1.0]), (50, [1.0, 0.1]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (None, [0.9, 0.9]), (5, [1e30, 1.0]),
        (100, [1e17, -1e17]), (6, [1.0, 2.0, 3.0]), (150, [3.0, 2.0, 1.0]), (7, []), (8, [0.0, 0.0]), (200, [0.0, 0.0]), (9, [float("inf"), 0.0]), (-50, [-0.5, 0.25]),
        (250, [0.001] * 3000), (10, [-0.001] * 3000),
    ]
    rows = vectors_of(spark, data)
    asked = rows.filter("vec_id % 50 = 0")
    expected = plain_search(data, [x for x in data if x[0] is not None and math.fmod(x[0], 50) == 0])
    assert found(metric_tree.search(rows, asked)) == expected
    assert metric_tree.search(rows.filter("1 = 0"), asked).count() == 0 and metric_tree.search(rows, asked.filter("1 = 0")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-9, 9)] * 3), min_size=1, max_size=80), st.tuples(*[st.integers(-9, 9)] * 3), st.integers(1, 6))
def test_tree_against_all_rows(rows, query, k):
    matrix, asked = np.array(rows, float), np.array(query, float)
    old = metric_tree.PAGE, metric_tree.FAN
    metric_tree.PAGE, metric_tree.FAN = 4, 3
    try:
        tree = metric_tree.MTree(matrix)
    finally:
        metric_tree.PAGE, metric_tree.FAN = old
    ids = np.arange(len(rows))
    best, scores = tree.search(asked, (ids, np.zeros(len(rows), bool)), -1, k, -np.inf)
    expected = sorted((-float(m @ asked), i) for i, m in enumerate(matrix))[:k]
    assert list(zip((-scores).tolist(), best.tolist(), strict=True)) == expected


def test_tree_skips_pages_by_stored_distances():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    rows = (np.repeat(centres, 1000, axis=0) + rng.integers(-9, 9, (16_000, 8))).astype(float)
    tree = metric_tree.MTree(rows)
    opened = []
    tree.pages = _Counting(tree.pages, opened)
    tree.search(rows[5], (np.arange(len(rows)), np.zeros(len(rows), bool)), 5, 5, -np.inf)
    assert len(opened) < len(tree.pages) / 4


class _Counting(list):
    def __init__(self, pages, opened):
        super().__init__(pages)
        self.opened = opened

    def __getitem__(self, number):
        self.opened.append(number)
        return super().__getitem__(number)


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, path = defaultdict(list), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h]) + tuple(turns[h:])
        for d in range(len(path[c]) + 1):
            members[path[c][:d]].append(c)
    children, leaves, saved, ends = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for c, p in path.items():
        ends[p].append(c)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
         for p, m in members.items()), key=str,
    )


TURN_SCHEMA = "conv_id long, turn long, role string, text string"


def test_tries_of_all_conversations(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    expected = plain_trie([tuple(r) for r in docs.collect()])
    assert found(turn_trie.conversation_trie(docs)) == expected
    assert found(turn_trie.conversation_trie(docs, turns=40, conversations=5)) == expected


def test_tries_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "PIECE", 7)
    long = "word " * 50_000
    rows = [(c, t, "user", f"turn {t}") for c in range(300, 420) for t in range(5)]  # equal conversations span ranges
    rows += [(1, None, None, None), (1, 2, "a", ""), (1, 2, "a", ""), (1, None, "", ""), (None, 1, "user", "x"), (-5, 0, "user", "y"), (-105, 1, "u", long), (-100, 1, "u", long)]
    rows += [(137, 0, "ab", "c"), (138, 0, "a", "bc"), (2**40, 1, "😀", "é😀"), (700, 0, "user", "only"), (701, 0, "user", "only"), (702, 0, "user", "only")]
    rows += [(900, t, "x", str(t)) for t in range(400)] + [(901, t, "x", str(t)) for t in range(401)]
    docs = spark.createDataFrame(rows, TURN_SCHEMA).withColumns({c: F.lit(c) for c in ("id", "size", "base", "path", "part", "kind", "turns")})
    expected = plain_trie(rows)
    assert found(turn_trie.conversation_trie(docs)) == expected
    assert found(turn_trie.conversation_trie(docs, turns=60, conversations=9)) == expected
    assert turn_trie.conversation_trie(docs.filter("1 = 0")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=6), min_size=1, max_size=400))
def test_radix_tree_keeps_every_key_in_order(keys):
    tree = turn_trie.RadixTree()
    for n, key in enumerate(keys):
        tree.insert(key, n, [])
    kept, open_ = [], [tree.root]
    while open_:
        node = open_.pop()
        if isinstance(node, turn_trie.Leaf):
            kept.append((node.key, node.members))
            continue
        open_ += reversed(([node.own] if node.own else []) + node.children())
    expected = defaultdict(list)
    for n, key in enumerate(keys):
        expected[key].append(n)
    assert kept == sorted(expected.items())


def test_radix_nodes_grow():
    tree = turn_trie.RadixTree()
    kinds = []
    for n in range(256):
        tree.insert(bytes([n, 1]), n, [])
        kinds.append((type(tree.root).__name__, getattr(tree.root, "room", None)))
    assert kinds[3] == ("Few", 4) and kinds[15] == ("Few", 16) and kinds[47] == ("Indexed", None) and kinds[48] == ("Direct", None)


def plain_counts(rows, least=5, seen=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    total = Counter()
    for doc, text in rows:
        for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower))).items():
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += n
    return {w: n for w, n in total.items() if len(w) >= least and n >= seen}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(counts):
    near = {w: sorted(o for o in counts if one_edit(w, o)) for w in counts}
    best = {w: min(o, key=lambda x: (-counts[x], x)) if o else None for w, o in near.items()}
    form = {w: b if b and counts[b] >= 2 * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()), key=str)


DOC_SCHEMA = "doc_id long, text string"


def test_spelling_of_documents(spark, documents):
    part = documents.filter("doc_id < 40")
    rows = [tuple(r) for r in part.select("doc_id", "text").collect()]
    expected = plain_variants(plain_counts(rows))
    assert len(expected) > 200
    assert found(spelling.variants(part)) == expected


def test_spelling_of_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found(spelling.variants(odd)) == plain_variants(plain_counts(rows))
    assert spelling.variants(none).count() == 0


@pytest.mark.parametrize("limit", [spelling.CELL, 5])
def test_variants_of_made_up_words(spark, limit):
    rng = np.random.default_rng(11)
    words = {"".join(rng.choice(list("abÿ"), rng.integers(4, 9))) for _ in range(260)} | {"x" * n for n in range(4, 12)} | {"q" * 80 + t for t in ("", "a", "ab")}
    counts = {w: int(rng.integers(1, 30)) for w in sorted(words)}
    text = " ".join(" ".join([w] * n) for w, n in counts.items())
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (None, text.upper()), (3, "pneumonia×÷ß " * 4), (4, None)], DOC_SCHEMA)
    rows = [tuple(r) for r in docs.collect()]
    expected = plain_variants(plain_counts(rows))
    assert any(r[1] for r in expected)
    assert found(spelling.variants(docs, limit=limit)) == expected


def test_long_texts_are_cut_between_words():
    text = "Alpha beta GAMMA " * 9 + "z" * 300 + " tail"
    got = Counter()
    for data, _, owners in spelling.slices([text, None, "", "last Ünit"], list("abcd"), limit=20):
        assert set(owners) <= set("abcd")
        got.update(x.decode("latin-1") for x in data.tobytes().split(b"\0") if x)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert got == Counter(re.findall("[A-Za-zÀ-ÿ]+", (text + " last Ünit").translate(lower)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=65, max_codepoint=255), max_size=90), min_size=1, max_size=30))
def test_hashes_and_tallies_of_runs(texts):
    for data, ends, owners in spelling.slices(texts, [str(i) for i in range(len(texts))]):
        edge = np.flatnonzero(np.diff(data != 0, prepend=False, append=False))
        start, length = edge[::2], edge[1::2] - edge[::2]
        heads = np.array([zlib.crc32(f"{o}:".encode()) ^ 0xFFFFFFFF for o in owners], np.uint32)
        owner = np.searchsorted(ends, start, "right")
        hashed = spelling.run_hashes(data, start, length, heads[owner], spelling.crc_table())
        runs = [data[a : a + n].tobytes() for a, n in zip(start, length, strict=True)]
        assert hashed.tolist() == [zlib.crc32(f"{owners[o]}:{r.decode('latin-1')}".encode()) for o, r in zip(owner, runs, strict=True)]
        counted = Counter()
        for words, counts in spelling.tally(data, start, length):
            counted.update(dict(zip(words, counts, strict=True)))
        assert counted == Counter(runs)
