"""DuckDB SQL for the queries that SQL can express."""

from tillbook.llm.license_scan import TEMPLATES, bigrams

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TEMPLATES = ",\n".join(f"({_text(name)}, [{', '.join(map(_text, bigrams(t)))}])" for name, t in TEMPLATES)


def _fill_middle(seed: int = 42, rate: int = 50, spm_rate: int = 80) -> str:
    draws = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT) AS h{i + 1}" for i in range(4))
    return f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('{seed}:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w,
             {draws} FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a,
             greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {rate}
                  THEN 'plain' WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle,
             array_to_string(w[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


def _clusters(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    """Each round's centroids and assignment as tables of the WITH clause."""
    steps = [f"""WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q FROM (
  SELECT q, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h, q LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT row, min(struct_pack(distance := CAST(d AS BIGINT), cluster := cluster)) AS best FROM (
    SELECT row, cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM kept v CROSS JOIN c{i} c) GROUP BY row)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, COALESCE(m.q, c.q) AS q FROM c{i} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS q FROM (
      SELECT a.best.cluster AS cluster, pos, CAST(sum(x) AS BIGINT) AS s, COUNT(*) AS n
      FROM (SELECT row, unnest(q) AS x, unnest(range(len(q))) AS pos FROM kept) v JOIN a{i} a ON v.row = a.row
      GROUP BY 1, 2) GROUP BY cluster) m ON c.cluster = m.cluster)""")
    return ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(a.best.cluster AS INTEGER) AS cluster, a.best.distance AS distance,
       CAST(sum(a.best.distance) OVER (PARTITION BY a.best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept v ON a.row = v.row JOIN c{rounds} c ON a.best.cluster = c.cluster"""


SQL: dict[str, str] = {
    "op12_fill_middle": _fill_middle(),

    "op13_centroid_clustering": _clusters(),

    "op4_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(COALESCE(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, COUNT(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""",

    "op5_license_scan": f"""
WITH templates(license, grams) AS (VALUES
{_TEMPLATES}),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(l))) AS number, unnest(l) AS body
  FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS l FROM documents WHERE text IS NOT NULL)
  UNION ALL
  SELECT * FROM (
    SELECT doc_id, 'paragraph' AS unit, unnest(range(len(l))) AS number, unnest(l) AS body
    FROM (SELECT doc_id, string_split_regex(lower(text), '\\n[ \\t\\r]*\\n') AS l FROM documents WHERE text IS NOT NULL))
  WHERE contains(body, chr(10))),
words AS (SELECT doc_id, unit, number, list_filter(string_split_regex(body, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM units),
grams AS (SELECT doc_id, unit, number, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
          FROM words WHERE len(w) >= 2),
hits AS (SELECT doc_id, unit, number, license, len(list_intersect(g, t.grams)) AS shared, len(g) AS unit_size,
                len(t.grams) AS template_size
         FROM grams JOIN templates t ON len(g) * 80 <= len(t.grams) * 120 AND len(t.grams) * 80 <= len(g) * 120),
found AS (SELECT * FROM hits WHERE shared * 200 >= (unit_size + template_size) * 80),
per_doc AS (SELECT doc_id, COUNT(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
                   string_agg(h, ',' ORDER BY h) AS hits
            FROM (SELECT *, concat_ws(':', unit, number, license, shared, unit_size, template_size) AS h FROM found)
            GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n, 0) AS n_hits, COALESCE(licenses, '') AS licenses, COALESCE(hits, '') AS hits
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id""",

    "op7_ngram_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
sets AS (SELECT DISTINCT doc_id, gram FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3),
         lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END) AS gram
  FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM sets GROUP BY doc_id),
shared_grams AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS n FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id <> b.doc_id
         GROUP BY 1, 2),
links AS (SELECT s.a, s.b FROM shared_grams s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id
          WHERE s.n * 10 >= 8 * (x.n + y.n - s.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, c.class_id, COALESCE(l.n, 0) AS n_links, c.class_size
FROM documents d
JOIN (SELECT a, min(b) AS class_id, COUNT(*) AS class_size FROM reach GROUP BY a) c ON d.doc_id = c.a
LEFT JOIN (SELECT a, COUNT(*) AS n FROM links GROUP BY a) l ON d.doc_id = l.a""",
}
