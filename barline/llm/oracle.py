"""SQL that gives the rows of the operators that SQL can express, over whole tables; for small ones."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH texts AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
windows AS (SELECT doc_id, i, w[i : i + 12] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
cut AS (SELECT DISTINCT doc_id, i + k AS i FROM repeated, range(13) AS t(k)),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM placed ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)""",
    "op4_jaccard_join": f"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[i : i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * pairs.n >= 80 * (x.n + y.n - pairs.n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reached.doc_id, b FROM reached JOIN sides ON a = other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM texts LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)""",
    "op7_embedding_near_dedup": """
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
valid AS MATERIALIZED (SELECT vec_id, v FROM vectors WHERE len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.9 END),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1),
reached AS (SELECT vec_id, vec_id AS other FROM vectors UNION SELECT reached.vec_id, b FROM reached JOIN links ON a = other),
least AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM vectors LEFT JOIN counted USING (vec_id) JOIN least USING (vec_id)""",
}
