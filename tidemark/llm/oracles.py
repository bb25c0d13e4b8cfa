"""DuckDB SQL for the queries whose results SQL can express, by their definitions."""

from __future__ import annotations

from tidemark.llm import exact_dedup, secrets

#: Words as the operators take them; RE2 reads the escapes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every string of 100 bytes with its place; those that have an earlier one, as islands of covered bytes; what lies between the islands.
SUFFIX_DEDUP = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM t WHERE length(h) >= 200)),
 w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM p),
 s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS opens FROM w WHERE k > 1),
 g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
 r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
 c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM r GROUP BY doc_id),
 e AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 2147483647) AS b FROM r UNION ALL SELECT doc_id, 0, min(a) FROM r GROUP BY doc_id),
 k AS (SELECT e.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM e JOIN t USING (doc_id) GROUP BY e.doc_id)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN k ON k.doc_id = t.doc_id
"""

#: Every window of 13 words with the least document that has it; the words that windows of later documents cover.
PASSAGE_DEDUP = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
 p AS (SELECT doc_id, i, md5_number(array_to_string(ws[i : i + 12], ' ')) AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t WHERE len(ws) >= 13)),
 w AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM p),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM w WHERE first < doc_id),
 l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
 k AS (SELECT t.doc_id, count(*) FILTER (WHERE c.i IS NULL) AS n_kept, string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept
  FROM t JOIN l ON l.doc_id = t.doc_id JOIN (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM t) x ON x.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id AND c.i = x.i GROUP BY t.doc_id)
SELECT t.doc_id, len(ws) AS n_words, CASE WHEN l.doc_id IS NULL THEN 0 ELSE len(gone) END AS n_removed,
 sha256(CASE WHEN l.doc_id IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM t LEFT JOIN l ON l.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id
"""

#: Distinct shingles, all pairs that share some, links by the full sets, and what hangs together.
NEAR_DEDUP = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
 s AS (SELECT doc_id, md5_number(g) AS g FROM (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM t)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM b JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * k >= 85 * (u.n + v.n - k)),
 e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
 r AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
 c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept FROM t JOIN c ON c.x = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
"""


def _kind(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of a pattern: a match ends where the pieces before it and the matches up to it end."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, owner, repo, {number} AS kind, e - length(m) AS a, e AS z, v FROM (
  SELECT doc_id, owner, repo, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY row ORDER BY i) AS e FROM (
   SELECT doc_id, owner, repo, row, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {group})) AS v, unnest(string_split_regex(text, '{p}')[: len(regexp_extract_all(text, '{p}'))]) AS gap,
    unnest(range(len(regexp_extract_all(text, '{p}')))) AS i FROM t WHERE regexp_matches(text, '{p}'))) WHERE length(v) >= {least}"""


#: Matches of the kinds with their places, values counted by owners and repositories, and the verdict over them.
SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(lang, '') AS repo, row_number() OVER () AS row FROM documents),
 m AS ({" UNION ALL ".join(_kind(n, k, *x) for n, (k, x) in enumerate(secrets.KINDS.items()))}),
 o AS (SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT owner || chr(0) || repo) AS n_repos FROM m GROUP BY v),
 j AS (SELECT m.*, len(list_distinct(string_split(v, ''))) >= {secrets.DISTINCT} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND n_owners = 1 AND n_repos < {secrets.SPREAD} AS live,
  n_owners >= {secrets.WIDE} OR (n_owners > 1 AND n_repos >= {secrets.SPREAD}) AS example, [{", ".join(f"'{k}'" for k in secrets.KINDS)}][kind + 1] || ':' || a || ':' || z AS said FROM m JOIN o USING (v)),
 g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(said, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, string_agg(said, ',' ORDER BY a, kind) FILTER (WHERE kind < 3 OR live) AS spans, count(*) FILTER (WHERE kind < 3 AND live) AS n_live, count(*) FILTER (WHERE kind < 3 AND example) AS n_example FROM j GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN g USING (doc_id)
"""

ORACLE = {
    "op3_suffix_dedup": SUFFIX_DEDUP,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_substring_dedup": PASSAGE_DEDUP,
    "op7_secret_scan": SECRETS,
    "op9_minhash_near_dedup": NEAR_DEDUP,
}
