"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: query -> module that defines it
_WHERE = {
    "op1_token_counts": "token_counts",
    "op2_decontamination": "decontaminate",
    "op3_jaccard_join": "jaccard_join",
    "op4_quality_classifier": "quality_classifier",
    "op5_warc": "warc",
    "op6_best_fit_packing": "packing",
    "op7_sharding": "sharding",
    "op8_quality_rules": "quality_rules",
    "op9_language_id": "language_id",
    "op10_secret_scan": "secret_scan",
    "op11_fill_in_middle": "fill_in_middle",
    "op12_collocations": "collocations",
    "op13_suffix_dedup": "suffix_dedup",
}


def llm_queries() -> dict:
    return {name: getattr(importlib.import_module(f"lumenweave.llm.{module}"), name) for name, module in _WHERE.items()}


_OP3 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * k + 1 AS INTEGER), 5) AS INTEGER) >> {shift}) & 31 AS INTEGER) + 1, 1)"
_OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda k: {" || ".join(_LETTER.format(shift=n) for n in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""


_OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
e AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e
), g AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM g
"""


_SUB = "array_to_string(list_slice(p.ws, {a}, {b}), ' ')"
_OP12 = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents
), p AS (SELECT lang, list_filter(string_split_regex(t, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM piece
), total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang
), gram AS (
  SELECT p.lang, k, unnest(list_transform(range(1, CAST(len(p.ws) AS BIGINT) - k + 2), lambda i: {_SUB.format(a="i", b="i + k - 1")})) AS phrase
  FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(p.ws) >= k
), f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1
), cut AS (SELECT p.*, u.j FROM c p, (SELECT unnest(range(1, 5)) AS j) u WHERE u.j < p.k
), scored AS (
  SELECT p.lang, p.phrase, p.k, p.a, x.f AS l, y.f AS r, total.n, p.j, CAST((1000::HUGEINT * p.a * total.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut p JOIN f x ON x.lang = p.lang AND x.phrase = {_SUB.format(a="1", b="p.j")} JOIN f y ON y.lang = p.lang AND y.phrase = {_SUB.format(a="p.j + 1", b="p.k")}
  JOIN total ON total.lang = p.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_part AS (
  SELECT p.lang, {_SUB.format(a="i", b="i + s - 1")} AS phrase, max(p.a) AS longer
  FROM c p, (SELECT unnest(range(2, 5)) AS s) z, (SELECT unnest(range(1, 5)) AS i) q WHERE s < p.k AND i + s - 1 <= p.k GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.n, b.score
FROM best b LEFT JOIN inner_part q ON q.lang = b.lang AND q.phrase = b.phrase WHERE q.longer IS NULL OR 100 * q.longer < 100 * b.a
QUALIFY rank <= 2000
"""


_OP13 = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS t FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)
), again AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY md5(t) ORDER BY doc_id, s) > 1
), run AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS opens FROM again
), numbered AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM run
), span AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY ALL
), kept AS (SELECT doc_id, coalesce(lag(b) OVER o, 0) AS a, a AS b FROM span WINDOW o AS (PARTITION BY doc_id ORDER BY k)
), spans AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n, max(b) AS last FROM span GROUP BY doc_id
), parts AS (
  SELECT doc_id, a, b FROM kept UNION ALL SELECT d.doc_id, coalesce(last, 0), d.n FROM d LEFT JOIN spans USING (doc_id)
), text AS (SELECT p.doc_id, string_agg(substr(d.x, 2 * p.a + 1, 2 * (p.b - p.a)), '' ORDER BY p.a) AS x FROM parts p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed, coalesce(s.n, 0) AS n_spans, sha256(unhex(t.x)) AS kept_sha256
FROM d JOIN text t USING (doc_id) LEFT JOIN spans s USING (doc_id)
"""


def llm_oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": _OP3, "op5_warc": _OP5, "op11_fill_in_middle": _OP11, "op12_collocations": _OP12, "op13_suffix_dedup": _OP13}
