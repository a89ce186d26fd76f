"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, metric_tree, mixing, neighbours, packing, quality, simhash, spelling, suffixes, turn_trie, url_filter, warc, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Url rules of the query, most general first.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(parts: int) -> Column:
    """crc32 of the document id's text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def vocabulary() -> str:
    """Path of the public tokeniser file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, remainder(4) != 2)
    return language.predict(docs.select("doc_id", "text", (remainder(4) == 2).alias("held_out")), model, ["doc_id", "held_out"])


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return quality.score(docs.select("doc_id", "text", "n_chars", (remainder(3) == 1).alias("held_out")), machine, ["doc_id", "held_out"])


@query
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return metric_tree.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query
def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


SQL["op1_url_filter"] = r"""
WITH split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(domain, head, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fitting AS (
  SELECT page_id, max_by(domain || head, length(domain || head)) AS rule, max_by(verdict, length(domain || head)) AS verdict
  FROM split JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, head)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fitting USING (page_id)
"""

_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(digest, {5 * i + 1}, 5))::INT >> {s}) % 32 + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)

SQL["op6_warc"] = f"""
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest,
         min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first
  FROM pages
)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM sized
"""

SQL["op7_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS origin, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS shuffle
  FROM documents
), sources AS (
  SELECT origin, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY origin = '', origin) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY origin
), capped AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / weight AS ratio,
         1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS budget
  FROM sources
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / (sum(weight) OVER (ORDER BY ratio, origin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM capped
), goals AS (
  SELECT origin, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) * weight, cap)) AS target
  FROM levels
), served AS (
  SELECT doc_id, size, source_size, target,
         (sum(size) OVER (PARTITION BY origin ORDER BY ('0x' || substr(shuffle, 1, 6))::INT % 1024, shuffle, size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS start
  FROM sized JOIN goals USING (origin)
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - start)) + greatest(0, least(size, floor(target)::BIGINT - start - source_size)))::BIGINT AS taken
FROM served
"""

SQL["op11_metric_tree"] = r"""
WITH rounded AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM rounded q JOIN rounded c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

# CRC-32 of the bytes of a string expression, from a table of register updates in ``tab``.
_CRC_TABLE = """crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) AS t(i)
)"""


def _crc(text: str) -> str:
    places = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr(hex({text}), (2 * k + 1)::BIGINT, 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {places}), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"


SQL["op12_turn_trie"] = f"""
WITH {_CRC_TABLE}, ids AS (
  SELECT conv_id, length(coalesce(text, '')) AS size, turn,
         substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, size, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS place FROM ids
), convs AS (
  SELECT conv_id, ({_crc("conv_id::VARCHAR")} % 6)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM ids), crc
), turns AS (
  SELECT c.conv_id, place, id, size FROM convs c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 100 AND place <= h
  UNION ALL
  SELECT c.conv_id, place, id, size FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND place > h
), prefixes AS (
  SELECT conv_id, size, row_number() OVER w AS depth, string_agg(id, '') OVER w AS prefix FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT prefix, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(size) AS size,
         CASE WHEN prefix <> '' THEN substr(prefix, 1, length(prefix) - 32) END AS parent
  FROM prefixes GROUP BY prefix
), children AS (
  SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT substr(n.prefix, 1, 32 * d) AS prefix, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN children c ON c.parent = n.prefix, unnest(range(depth + 1)) AS u(d) GROUP BY ALL
), ends AS (
  SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS members
  FROM (SELECT conv_id, max_by(prefix, depth) AS prefix FROM prefixes GROUP BY conv_id) GROUP BY prefix
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(members, '')) AS ends_sha256
FROM nodes n JOIN sums USING (prefix) LEFT JOIN nodes p ON p.prefix = n.parent LEFT JOIN children c ON c.parent = n.prefix LEFT JOIN ends e ON e.prefix = n.prefix
"""

SQL["op13_spelling"] = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc("s")} AS h FROM (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs), crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3
), shorter AS (
  SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(k)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.rest
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.rest
), best AS (
  SELECT word, count(*) AS n_near, arg_max(other, (n, -rank)) AS other, max(n) AS other_n
  FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY encode(other)) AS rank FROM near) GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
