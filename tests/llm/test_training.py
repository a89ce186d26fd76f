"""Archives, mixing, packing, neighbours and the pipeline."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from rolegrain.llm import mixing, neighbours, packing, queries, warc


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows(frame):
    return sorted([tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()], key=lambda r: [(v is None, str(v)) for v in r])


def sql_rows(duck, name):
    found = duck.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    order = [columns.index(c) for c in sorted(columns)]
    return sorted([tuple(r[i] for i in order) for r in found.fetchall()], key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", ["op6_warc", "op7_mixing", "op11_metric_tree", "op12_turn_trie", "op13_spelling"])
def test_equals_sql(spark, sf_dir, duck, name):
    assert rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(duck, name)


PAGES = [
    (5, "http://a.org/x", "same"), (3, "http://b.org/y\r\nX: 1", "same"), (9, None, "same"), (None, "u", "same"), (1, "http://a.org/x", None),
    (2, "100%0D", ""), (4, "http://A.org:80/z", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1 ünï"), (4, "http://A.org:80/z", "twice"), (4, "http://A.org:80/z", "twice"),
    (7, "http://c.org/", "x" * 300_000),
]


@pytest.mark.parametrize("least", [0, 10])
def test_archives_come_back_whole(spark, least):
    pages = spark.createDataFrame([(*p, "own") for p in PAGES], "page_id long, url string, html string, record string").repartition(3)
    got = warc.archive(pages, least, per_file=3, per_range=4).collect()
    want = []
    for key, url, html in PAGES:
        body = (html or "").encode()
        same = [k for k, _, h in PAGES if (h or "") == (html or "") and k is not None]
        first = min(same, default=None) if len(body) >= least else None
        again = first is not None and key is not None and first != key
        want.append((key, url or "", len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted([(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=order) == sorted(want, key=order)
    history = [(r["key"], r["stamp"], r["page_id"] is not None, r["page_id"] or 0) for r in sorted(got, key=lambda r: (r["range"], r["position"]))]
    assert history == sorted(history) and len({r["range"] for r in got}) > 1
    assert warc.archive(pages.filter("1 = 0")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree(runs):
    sources = [[(v, (v, i)) for v in sorted(run)] for i, run in enumerate(runs)]
    assert list(warc.LoserTree(sources)) == sorted((x for s in sources for x in s), key=lambda x: (x[0], x[1][1]))


def test_mix_targets_and_odd_rows(odd, none):
    done = mixing.mix(odd.select("doc_id", "text", "source")).collect()
    assert len(done) == odd.count()
    by_source = {}
    for r in done:
        assert 0 <= r["mix_taken"] <= 2 * r["mix_size"]
        by_source.setdefault(r["source"], []).append(r)
    for own in by_source.values():
        assert sum(r["mix_size"] for r in own) == own[0]["mix_source_size"] and sum(r["mix_taken"] for r in own) == int(own[0]["mix_target"])
        assert own[0]["mix_target"] <= 2 * own[0]["mix_source_size"]
    copies = mixing.mixed(odd)
    assert copies.columns == odd.columns and {r["mix_size"] for r in copies.collect()} == {"own mix_size"}
    assert mixing.mix(none.select("doc_id", "text", "source")).count() == 0 and mixing.mixed(none).count() == 0


def served_by_events(rows, weights=(5, 2, 1), share=1.5, passes=2):
    """Document ids in the order a scheduler serves them: always the source whose next document finishes first."""
    import heapq
    import re

    queues, names = {}, sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    for r in rows:
        key = hashlib.md5(f"mix:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        queues.setdefault(r["source"], []).append((int(key[:6], 16) % 1024, key, size, r["doc_id"]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(d[2] for d in q) for s, q in queues.items()}
    budget, target, free = share * sum(total.values()), {}, set(names)
    while free:  # water-filling: cap sources one after another
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > passes * total[s]}
        for s in over or free:
            target[s] = passes * total[s] if over else level * weight[s]
        free -= over or free
    heap, order = [], []

    def push(source, n, place):
        queue = sorted(queues[source])
        if place == len(queue):
            n, place = n + 1, 0
        if n < passes and target[source] > 0:
            before = n * total[source] + sum(d[2] for d in queue[:place])
            _, key, size, doc = queue[place]
            heapq.heappush(heap, ((before + size) / target[source], size, key, source or "", source is None, source, n, place, before, doc))

    for s in names:
        push(s, 0, 0)
    while heap:
        _, size, _, _, _, source, n, place, before, doc = heapq.heappop(heap)
        if size and 2 * max(0, min(size, int(target[source]) - before)) > size:
            order.append(doc)
        push(source, n, place + 1)
    return order


def test_order_of_service_against_events(spark, documents):
    for docs in (documents.filter("doc_id < 60"), spark.createDataFrame([(i, "w " * (1 + i % 5), "abc"[i % 3 if i > 8 else 0]) for i in range(40)], "doc_id long, text string, source string")):
        assert [r["doc_id"] for r in mixing.mixed(docs).select("doc_id").collect()] == served_by_events(docs.collect())


def test_mix_shields_clashing_names(odd):
    done = mixing.mix(odd)
    assert done.columns == [c for c in odd.columns if c != "mix_size"] + ["mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_finish"]
    assert {r["mix_size"] for r in done.collect()} >= {0, 60_000} and {r["score"] for r in done.collect()} == {"own score"}


def test_mix_is_native_and_repeatable(spark, documents):
    plan = mixing.mixed(documents)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert rows(mixing.mix(documents.select("doc_id", "text", "source"))) == rows(mixing.mix(documents.repartition(5).select("doc_id", "text", "source")))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


STRANGE = st.text(st.sampled_from(list("ab'sS<|>endoftxt \n\t\r\x0b\x1c\x85 　éÉéİΣς12½²!?#\U0001f600中‍_")), max_size=40)


@settings(max_examples=120, deadline=None)
@given(STRANGE)
def test_tokens_of_words_equal_tokens_of_texts(text):
    tokens = test_tokens_of_words_equal_tokens_of_texts.__dict__.setdefault("tokens", packing.WordTokens(queries.vocabulary()))
    for whole in (text, f"It's {text}<|endoftext|>we'LL {text}"):
        ids = tokens.whole.encode(whole, add_special_tokens=False).ids
        assert np.frombuffer(tokens.text(whole), "<u4").tolist() == ids


def check_pieces(pieces, ids, top=4096):
    """Every id in exactly one piece, gapless sequences; returns the padding."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] > 0 and zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans, total in [(sorted(by_doc[d]), len(ids[d])) for d in ids]:
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) == total
    padding = 0
    for spans in by_sequence.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
        size = sum(n for _, n in spans)
        assert size <= top
        padding += 0 if size & (size - 1) == 0 else top - size
    return padding


def test_packing_query(spark, sf_dir, texts, tokenizer):
    pieces = queries.QUERIES["op8_packing"](spark, sf_dir).collect()
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts.items()}
    assert check_pieces(pieces, ids) <= 4096
    steps = {}
    for p in pieces:
        steps.setdefault(p["step_group"], {})[p["sequence_id"]] = p["window"]
    full = sorted(steps)[:-1]
    assert all(abs(sum(steps[s].values()) - (1 << 20)) <= 4096 for s in full)


def test_packing_of_odd_rows(odd, none, tokenizer):
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in unique.select("doc_id", "text").collect()}
    check_pieces(packing.pack(unique, queries.vocabulary()).collect(), ids)
    assert packing.pack(odd, queries.vocabulary()).agg(F.sum("length")).first()[0] > sum(map(len, ids.values()))
    assert packing.pack(none, queries.vocabulary()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60))
def test_packer_places_every_token(sizes):
    packer = packing.Packer((4, 8, 32), 2, 64, 0)
    packer.WAIT = 50
    ids = {i: list(range(n)) for i, n in enumerate(sizes)}
    for i, own in ids.items():
        packer.add(i, np.array(own, "<u4").tobytes())
    packer.drain(True)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check_pieces([dict(zip(names, r)) for r in packer.rows], ids, 32) <= 31


def exact(vectors, wanted, k):
    out = {}
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in vectors.items()}
    for q in wanted:
        best = sorted((-float(unit[i] @ unit[q]), i) for i in vectors if i != q)[:k]
        out[q] = [i for _, i in best]
    return out


def test_neighbours_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    got = queries.QUERIES["op9_neighbours"](spark, sf_dir).collect()
    want = exact(vectors, [i for i in vectors if i % 50 == 0], 5)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        a, b = vectors[r["query_id"]], vectors[r["vec_id"]]
        assert r["score"] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    assert all(len(v) == 5 for v in found.values()) and set(found) == set(want)
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_neighbours_of_odd_rows(spark):
    bad = [(90, None), (91, []), (92, [0.0, 0.0]), (93, [1.0, None]), (94, [float("nan"), 1.0]), (95, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0]), (5, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([(*r, "own") for r in bad + good], "vec_id long, embedding array<double>, score string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in neighbours.search(table, table.filter("vec_id in (0, 5, 92)"), k=3).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 1.0), (0, 3): (4, 0.707107)}
    assert neighbours.search(table.filter("1 = 0"), table, k=3).count() == 0


def test_neighbours_with_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (50, [1.0, 1.0]), (50, [0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = sorted({(i, tuple(v)) for i, v in rows})
    want = []
    for query in [r for r in unit if r[0] % 50 == 0]:
        scored = sorted((-np.dot(query[1], v) / np.linalg.norm(query[1]) / np.linalg.norm(v), i) for i, v in unit if (i, v) != query)
        want += [(query[0], place + 1, i, round(-c, 6)) for place, (c, i) in enumerate(scored)]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.search(table, table.filter("vec_id % 50 = 0")).collect()]
    assert sorted(got) == sorted(want)


def test_neighbours_of_extreme_vectors():
    rows = np.array([[1e300, 1e300], [1e-300, 0.0], [0.0, 5e-324], [3.0, 4.0]])
    found = dict(zip(*[x.tolist() for x in next(iter(neighbours.nearest(rows, np.arange(4), np.array([[1.0, 0.0]]), np.array([9]), 4, 7)))[1:]], strict=True))
    assert {i: round(c, 6) for i, c in found.items()} == {0: 0.707107, 1: 1.0, 2: 0.0, 3: 0.6}


def test_pipeline_stages(spark, sf_dir, documents, tokenizer):
    """Every stage on what the one before it kept, against a plain model of its decision."""
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == documents.columns, name
        seen[name] = (docs.collect(), out.collect())
        docs = out
    before, after = seen["quality classifier"]
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    assert sum((r["doc_id"] in kept) == (label[r["doc_id"]] == 1) for r in before if r["doc_id"] in label) >= 0.95 * sum(r["doc_id"] in label for r in before)
    before, after = seen["near-duplicates"]
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    kept = {r["doc_id"] for r in after}
    assert kept <= set(first.values()) and len(kept) == len(after)
    before, after = seen["repeated strings"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["mixing"]
    text = {r["doc_id"]: r for r in before}
    assert after and all(r == text[r["doc_id"]] for r in after)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs.dropDuplicates(["doc_id"]), sf_dir).collect()
    check_pieces(pieces, {r["doc_id"]: tokenizer.encode(r["text"], add_special_tokens=False).ids + [2] for r in after})
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_of_odd_and_empty_tables(spark, sf_dir, odd, none):
    for table in (odd, none):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == table.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= 0
