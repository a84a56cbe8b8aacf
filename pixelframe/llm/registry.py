"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import collocations, decontamination, embedding_dedup, ngram_join, packing, piece_dropout, quality_classifier, quality_rules, sharding, source_divergence, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_ngram_join": ngram_join.op1,
    "op2_sharding": sharding.op2,
    "op3_url_filter": url_filter.op3,
    "op4_embedding_dedup": embedding_dedup.op4,
    "op5_token_counts": token_counts.op5,
    "op6_piece_dropout": piece_dropout.op6,
    "op7_quality_rules": quality_rules.op7,
    "op8_packing": packing.op8,
    "op9_quality_classifier": quality_classifier.op9,
    "op10_suffix_dedup": suffix_dedup.op10,
    "op11_source_divergence": source_divergence.op11,
    "op12_decontamination": decontamination.op12,
    "op13_collocations": collocations.op13,
}
#: Models, tokenizers, graphs and iterative placement have no SQL; these are checked on whole tables.
ORACLES: dict[str, str] = {
    "op1_ngram_join": r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, (len(ws) - 3)::BIGINT), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT id, min(other) AS m FROM r GROUP BY ALL)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id""",
    "op10_suffix_dedup": r"""
WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
q AS (SELECT doc_id, unnest(range(0, len(h) // 1024 + 1)) AS j, h FROM b WHERE len(h) > 0),
c AS (SELECT doc_id, j, len(h) AS n, substring(h, 1024 * j + 1, 1122) AS c FROM q),
p AS (SELECT doc_id, 512 * j AS o, n, c, unnest(range(0, 512)) AS k FROM c),
s AS (SELECT doc_id, o + k AS i, substring(c, 2 * k + 1, 2) AS y, CASE WHEN 2 * (o + k) + 100 <= n THEN md5_number(substring(c, 2 * k + 1, 100)) END AS g FROM p WHERE 2 * (o + k) < n),
f AS (SELECT g, min(doc_id) AS f FROM s WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT doc_id, i, y, max((f < doc_id)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s LEFT JOIN f USING (g)),
t AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, i, y, coalesce(gone, 0) AS gone FROM m)),
a AS (SELECT doc_id, sum(gone) AS r, count(*) FILTER (gone = 1 AND coalesce(before, 0) = 0) AS k, coalesce(string_agg(y, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM t GROUP BY ALL)
SELECT b.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN a USING (doc_id)""",
    "op11_source_divergence": source_divergence.SQL,
    "op12_decontamination": decontamination.SQL,
    "op13_collocations": collocations.SQL,
}
