"""SQL that states the answers of those queries of this folder that SQL can express."""

from __future__ import annotations

import string

_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def _clustering(rounds: int = 10, clusters: int = 8, dims: int = 64) -> str:
    distance = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT {clusters})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT k.r, min(struct_pack(d := {distance}, c := c.c)) AS best FROM kept k, c{n} c GROUP BY k.r)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (
        SELECT a.best.c AS c, unnest(k.v) AS x, unnest(range({dims})) AS i FROM kept k JOIN a{n} a USING (r)) GROUP BY c, i) GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT k.vec_id, CAST(a.best.c AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept k JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.best.c"""


_CONTAMINATION = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
places AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT d.r, d.w, z.n, unnest(range(1, len(d.w) - z.n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows) z WHERE len(d.w) >= z.n)),
met AS MATERIALIZED (SELECT p.r, p.n, p.s, v.item FROM places p JOIN windows v USING (n, words)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM met) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)"""

# crc32 by its table of 256 values, which follow from the polynomial; letters from U+00C0 on have two bytes
_SPELLING = f"""WITH crc AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
                                       FROM range(256) x(b))),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [195::BIGINT, unicode(s)::BIGINT - 64] END)),
    lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT)) AS h FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS MATERIALIZED (
  SELECT word, n, i, left(word, i::INTEGER) || substr(word, i::INTEGER + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -other_n, other := other)) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.b.less >= 10 * w.n THEN b.b.other END AS form, CASE WHEN -b.b.less >= 10 * w.n THEN -b.b.less END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
steps AS (
  WITH RECURSIVE go(word, root) AS (
    SELECT word, word FROM forms
    UNION ALL SELECT go.word, f.form FROM go JOIN forms f ON f.word = go.root WHERE f.form IS NOT NULL)
  SELECT go.word, go.root FROM go JOIN forms f ON f.word = go.root WHERE f.form IS NULL)
SELECT f.word, f.form, s.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM forms f JOIN steps s USING (word)"""

SQL = {"op11_centroids": _clustering(), "op12_contamination": _CONTAMINATION, "op13_spelling": _SPELLING}
