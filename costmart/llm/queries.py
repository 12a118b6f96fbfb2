"""One query per training-data operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from costmart.llm import (alignment, backtrack, collocations, exact_dedup, extract, fertility,
                          hosts, langid, lexicon, minhash, packing, sharding, toxicity)
from costmart.llm.common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, tokeniser fertility and verdict of all documents."""
    return fertility.measure(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents; the largest doc_id of equal texts stays."""
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return minhash.components(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to 24 shuffled shards, read back as digests."""
    return sharding.shard_digest(table(spark, sf_dir, "documents"), 24)


#: The given rules: a host with its subdomains, and a path prefix.
URL_RULES = [hosts.parse_rule(verdict, text) for verdict, text in (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"))]


def op6_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and link-graph verdict of all pages."""
    return hosts.judge(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by the weakly supervised classifier."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, family first."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with the transducer lexicon and decoded again, as digests."""
    return lexicon.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                          outputs=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over all documents."""
    return collocations.top(*collocations.score(table(spark, sf_dir, "documents")), 2000)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between two vocabularies, with corpus-wide link counts."""
    return alignment.links(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                           vocabulary("piece_bpe_32k.model"))


def op13_backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by backtracking and decoded again, as digests."""
    return backtrack.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"),
                            outputs=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fertility": op1_fertility,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_minhash": op3_minhash,
    "op4_extract": op4_extract,
    "op5_sharding": op5_sharding,
    "op6_hosts": op6_hosts,
    "op7_toxicity": op7_toxicity,
    "op8_langid": op8_langid,
    "op9_lexicon_bpe": op9_lexicon_bpe,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_backtrack": op13_backtrack,
}

#: A-Z and a-z for DuckDB's translate().
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE: dict[str, str] = {
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)""",
    # Exact similarities of all pairs that share a shingle, and the transitive closure.
    "op3_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(
    CASE WHEN len(ws) = 0 THEN []
         WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1),
                             lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
      WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id""",
    # All phrases of up to four words, every cut, and the phrases that a longer one explains.
    "op11_collocations": f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), {_AZ}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws
  FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g
  FROM w, range(1, 5) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, g, len(g) AS k, count(*) AS n FROM g GROUP BY lang, g),
totals AS (SELECT lang, sum(n)::BIGINT AS total FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND n >= 30),
explained AS (
  SELECT DISTINCT c.lang, c.g FROM c JOIN (
    SELECT lang, g[1:k - 1] AS part, n FROM c WHERE k > 2
    UNION ALL SELECT lang, g[2:k], n FROM c WHERE k > 2) x
  ON x.lang = c.lang AND x.part = c.g WHERE 100 * x.n >= 80 * c.n),
cuts AS (
  SELECT c.lang, c.g, c.n AS a, j, x.n AS l, y.n AS r,
         (2000000::HUGEINT * c.n // (x.n + y.n))::BIGINT AS score
  FROM c, range(1, 4) t(j)
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:j]
  JOIN f y ON y.lang = c.lang AND y.g = c.g[j + 1:c.k]
  WHERE j < c.k),
best AS (
  SELECT * FROM cuts ANTI JOIN explained USING (lang, g)
  QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC,
                                  encode(array_to_string(g, ' '))) AS rank,
         array_to_string(g, ' ') AS phrase, a, l, r, score FROM best)
SELECT lang, rank, phrase, a, l, r, total AS n, score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
