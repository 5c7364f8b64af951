"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations



from . import bpe, chat, decontam, divergence, fingerprint, html, jaccard, langid, licenses, mixing, suffixes, tokens, whitening
from .common import table


def op1_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_main_text(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    return tokens.store_and_read(table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_chat_format(spark, sf_dir):
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_decontamination": op3_decontamination,
    "op4_main_text": op4_main_text,
    "op5_fingerprints": op5_fingerprints,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_files": op7_token_files,
    "op8_license_scan": op8_license_scan,
    "op9_bpe": op9_bpe,
    "op10_chat_format": op10_chat_format,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_divergence": op12_source_divergence,
    "op13_source_mixing": op13_source_mixing,
}

ORACLE_SQL = {
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.c + ny.c - i)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.y FROM r JOIN e ON r.b = e.x
)
SELECT d.doc_id, coalesce(max(n.c), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
""",
    "op10_chat_format": """
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM conversations
), r AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '')
           OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS rendered
  FROM t
), whole AS (
  SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_same, rendered FROM r WHERE pos = n GROUP BY n, rendered
)
SELECT conv_id, CAST(n_turns AS INTEGER) AS n_turns, n_same, CAST(length(rendered) AS BIGINT) AS n_chars, rendered
FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pos < r.n AND r.pos = w.n_turns AND r.rendered = w.rendered)
""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), w AS (
  SELECT lang, source, r, unnest(ws) AS term FROM d
), t AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS k FROM w GROUP BY lang, source, term
), kept AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING sum(k) >= 3
), v AS (
  SELECT lang, count(*) AS v, sum(total) AS nl FROM kept GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, t.n FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term
), s AS (
  SELECT lang, source, sum(n) AS ns FROM c GROUP BY lang, source
), g AS (
  SELECT DISTINCT lang, source FROM d
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(s.ns, 0) + v.v) AS BIGINT) AS p,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (total + 1) // (nl + v.v) AS BIGINT) AS q
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3
), e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
""",
    "op13_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(chr(10), '13', CAST(doc_id AS VARCHAR), text)) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source
), w AS (
  SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s
), c AS (
  SELECT *, sum(cap) OVER o - cap AS caps, sum(weight) OVER o - weight AS weights, sum(weight) OVER () AS w, sum(source_size) OVER () AS words
  FROM w WINDOW o AS (ORDER BY cap / weight, nth ROWS UNBOUNDED PRECEDING)
), r AS (
  SELECT max((150 * words / 100 - caps) / (w - weights)) AS rate, max(words) AS words FROM c
), t AS (
  SELECT source, nth, source_size, least(CAST(cap AS DOUBLE), weight * rate) AS target, r.words FROM c, r
), l AS (
  SELECT d.doc_id, d.size, t.*, sum(d.size) OVER o AS cum, row_number() OVER o AS place
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source WINDOW o AS (PARTITION BY nth ORDER BY h, size ROWS UNBOUNDED PRECEDING)
), k AS (
  SELECT nth, place, size, k, words, (cum + k * source_size) / target AS finish
  FROM l, range(2) AS copies(k) WHERE size > 0 AND cum + k * source_size - size < target
), a AS (
  SELECT *, sum(size) OVER (ORDER BY finish, nth, place, k ROWS UNBOUNDED PRECEDING) AS passed FROM k
), m AS (
  SELECT nth, place, sum(size) AS taken FROM a WHERE passed * 100 <= 150 * words GROUP BY nth, place
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM l LEFT JOIN m ON m.nth = l.nth AND m.place = l.place
""",
}
