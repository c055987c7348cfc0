"""The queries of this subpackage, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers
from merchlens.llm import lines, lm, middle, mixing, neardup, packing, phrases, pii, quality, secrets, topk, urls, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_scores(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_urls(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(urls.RULES), "verdict string, rule string")
    return urls.filter_urls(table(spark, folder, "pages"), rules)


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.detect(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def op8_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(table(spark, folder, "documents"))


def op9_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(table(spark, folder, "documents"))


def op10_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op11_middle(spark: SparkSession, folder: str) -> DataFrame:
    return middle.digests(table(spark, folder, "documents"))


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(table(spark, folder, "documents"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_packing, op2_mixing, op3_topk, op4_quality, op5_urls, op6_pii, op7_warc, op8_lines, op9_lm, op10_neardup,
        op11_middle, op12_secrets, op13_phrases,
    )
}

def _finders() -> str:
    """Rows (no, kind, role, pattern, first group is the place, its least length, needs) of the patterns, as SQL values."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    rows = [
        f"({no}, {quoted(f.kind)}, {quoted(f.role)}, {quoted(f.pattern if '(' in f.pattern.replace('(?', '') else f'({f.pattern})')}, "
        f"{f.group}, {f.least}, [{', '.join(map(quoted, f.needs))}]::VARCHAR[])"
        for no, f in enumerate(secrets.FINDERS)
    ]
    return ",\n  ".join([*rows, r"(8, '', 'blank', '(\n[\x20\x09\x0D]*\n)', false, 0, []::VARCHAR[])"])


ORACLES: dict[str, str] = {
    "op12_secrets": r"""
WITH finders(no, kind, role, pattern, grouped, least, needs) AS (VALUES
  """
    + _finders()
    + r"""
), docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
met AS (SELECT row, text, f.* FROM docs JOIN finders f ON regexp_matches(text, pattern)),
both_roles AS (SELECT row FROM met GROUP BY row HAVING bool_or(role = 'identifier') AND bool_or(role = 'secret')),
found AS (
  SELECT row, no, grouped, least, needs, regexp_extract_all(text, pattern, 0) AS whole, regexp_extract_all(text, pattern, 1) AS named,
         string_split_regex(text, pattern) AS gaps
  FROM met WHERE no < 3 OR row IN (SELECT row FROM both_roles)
), each AS (
  SELECT row, no, grouped, least, needs, generate_subscripts(whole, 1) AS i, unnest(whole) AS m, unnest(named) AS v, unnest(gaps[1:len(whole)]) AS gap
  FROM found
), ends AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY row, no ORDER BY i) AS stop FROM each
), spans AS (
  SELECT row, no, stop - length(CASE WHEN grouped THEN v ELSE m END) AS start, stop FROM ends
  WHERE length(v) >= least AND len(list_filter(needs, lambda need: NOT regexp_matches(m, need))) = 0
), marked AS (
  SELECT *, count(*) FILTER (no = 8) OVER (PARTITION BY row ORDER BY start, no) AS scope,
         coalesce(max(stop) FILTER (no BETWEEN 3 AND 7) OVER (PARTITION BY row ORDER BY start, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last
  FROM spans
), parts AS (SELECT m.*, kind, role FROM marked m JOIN finders USING (no) WHERE no < 3 OR (no < 8 AND last <= start)),
near AS (
  SELECT p.row, p.no, p.start, p.stop, p.kind, p.role, bool_or(q.role = 'identifier') AS id, bool_or(q.role = 'secret') AS secret,
         bool_or(q.role = 'endpoint') AS endpoint, bool_or(q.role = 'identifier' AND q.no < 3) AS sure_id, bool_or(q.role = 'secret' AND q.no < 3) AS sure_secret
  FROM parts p JOIN parts q ON p.row = q.row AND p.scope = q.scope AND abs(p.start - q.start) <= 400
  WHERE p.no >= 3 AND NOT EXISTS (SELECT 1 FROM parts b WHERE b.row = p.row AND b.no < 3 AND b.start < p.stop AND p.start < b.stop)
  GROUP BY ALL
), told AS (
  SELECT row, no, kind, start, stop FROM parts WHERE no < 3
  UNION ALL
  SELECT row, CASE kind WHEN 'identifier' THEN 3 WHEN 'secret' THEN 4 ELSE 5 END, kind, start, stop FROM near
  WHERE CASE role WHEN 'identifier' THEN secret AND (sure_secret OR endpoint) WHEN 'secret' THEN id AND (sure_id OR endpoint) ELSE id AND secret END
), said AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM told)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, no) FILTER (no < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, no), '') AS spans, count(*) FILTER (no >= 3) AS n_linked
FROM docs LEFT JOIN said USING (row) GROUP BY row, doc_id
""",
    "op13_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), cut AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), found AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS w FROM cut, range(1, 4) sizes(k)
), counted AS (SELECT lang, k, w, count(*) AS f FROM found GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, w, f AS a FROM counted WHERE k > 1 AND f >= 10),
inside AS (
  SELECT lang, unnest([w[1:2], w[2:3]]) AS w, a FROM candidates WHERE k = 3
), longer AS (SELECT lang, w, max(a) AS longer FROM inside GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, w) WHERE c.k = 3 OR longer IS NULL OR 100 * longer < 50 * a
), cuts AS (
  SELECT lang, w, a, c, w[1:c] AS lw, w[c + 1:] AS rw FROM kept, range(1, 3) places(c) WHERE c < k
), scored AS (
  SELECT cuts.*, l.f AS l, r.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts JOIN counted l ON l.lang = cuts.lang AND l.w = cuts.lw JOIN counted r ON r.lang = cuts.lang AND r.w = cuts.rw
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, c) = 1),
named AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, score FROM worst),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang)
""",
    "op11_middle": r"""
WITH told AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), drawn AS (
  SELECT *, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(digest, 1 + 8 * i, 8) AS BIGINT)) AS h FROM told
), cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS p, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS q,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90
              THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, substr(text, 1, p) AS head, substr(text, p + 1, q - p) AS middle, substr(text, q + 1) AS tail FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle
                        ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
""",
    "op3_topk": r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.v, p.v) AS BIGINT) AS score
  FROM whole q JOIN whole p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
""",
    "op7_warc": r"""
WITH known AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (SELECT digest, min(page_id) AS first FROM known WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, k.digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM known k LEFT JOIN firsts f ON k.digest = f.digest AND k.n >= 100
""",
    "op8_lines": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents
), cut AS (
  SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(line, '[ 	-
]+'), lambda x: x <> '') AS words FROM lines
), firsts AS (
  SELECT words, min((doc_id, line_no)) AS first FROM cut WHERE len(words) > 0 GROUP BY words
), numbered AS (SELECT row_number() OVER (ORDER BY first) AS no, words FROM firsts WHERE len(words) >= 8),
places AS (SELECT no, words, unnest(range(1, len(words) + 2)) AS i FROM numbered),
less AS (SELECT no, i, hash(words[:i - 1], words[i + 1:], i) AS rest FROM places WHERE i <= len(words)),
whole AS (SELECT no, i, hash(words[:i - 1], words[i:], i) AS rest FROM places),
least AS (SELECT rest, min(no) AS no FROM (SELECT * FROM less UNION ALL SELECT * FROM whole) GROUP BY rest),
near AS (
  SELECT DISTINCT v.no FROM (SELECT * FROM less UNION ALL SELECT * FROM whole) v JOIN least l ON v.rest = l.rest AND l.no < v.no
), told AS (
  SELECT c.doc_id, c.line_no, c.line, len(c.words) > 0 AS counted, n.no IS NOT NULL AS near, (c.doc_id, c.line_no) <> f.first AS again
  FROM cut c LEFT JOIN firsts f ON c.words = f.words LEFT JOIN numbered m ON c.words = m.words LEFT JOIN near n ON m.no = n.no
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT (counted AND (near OR again))), '') END AS text,
       count(*) FILTER (counted) AS n_lines, count(*) FILTER (counted AND again AND NOT near) AS n_equal, count(*) FILTER (counted AND near) AS n_near
FROM documents d LEFT JOIN told t ON d.doc_id = t.doc_id GROUP BY d.doc_id, d.text
""",
    "op5_urls": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)
), rules(said, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT DISTINCT page_id, host, path, rule_host || rule_path AS rule, said
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
  FROM fits GROUP BY page_id, host, path
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.said, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
""",
}
