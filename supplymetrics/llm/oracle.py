"""DuckDB SQL of the queries that SQL can express.

The statements compute the results by other means where there are any: the mix ranks every quotient of every
source, decontamination counts shared shingles of every pair that shares one.
"""

from __future__ import annotations

from supplymetrics.llm import audit, centroids, decontam, epsilon_join, linededup, mixing, quality_rules, warc
from supplymetrics.llm.common import SPACE_CHARS, UPPER, WORD

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
assert SPACE_CHARS == " \t\n\x0b\x0c\r"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP1 = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(concat_ws(':', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''))) AS okey
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS s, {mixing.MAX_REPEAT} * sum(size)::BIGINT AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST))::BIGINT AS r,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT ((SELECT sum(s) FROM sources) - coalesce((SELECT sum(b.cap) FROM sources b WHERE b.cap / b.w < a.cap / a.w), 0))
         / (SELECT sum(b.w) FROM sources b WHERE b.cap / b.w >= a.cap / a.w) AS level FROM sources a),
stopped AS (SELECT *, cap <= w * (SELECT max(level) FROM levels) AS is_stopped FROM sources),
rest AS (SELECT sum(s) - coalesce(sum(cap) FILTER (is_stopped), 0) AS words, sum(w) FILTER (NOT is_stopped) AS weight FROM stopped),
target AS (
  SELECT source, s, cap, r, CASE WHEN is_stopped THEN cap::DOUBLE ELSE w::DOUBLE * words::DOUBLE / weight::DOUBLE END AS target
  FROM stopped, rest),
seats AS (SELECT round(sum(target) / {mixing.BLOCK_WORDS})::BIGINT AS n FROM target),
quotients AS (
  SELECT r, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, r, k) AS place
  FROM (SELECT r, target, unnest(range(least(n, ceil(cap / {mixing.BLOCK_WORDS})::BIGINT))) AS k FROM target, seats)),
upto AS (
  SELECT h, r, least(count(*) FILTER (place <= n * h // {mixing.SHARDS}) * {mixing.BLOCK_WORDS}, any_value(cap)) AS word
  FROM quotients JOIN target USING (r), seats, (SELECT unnest(range({mixing.SHARDS + 1})) AS h) GROUP BY h, r),
quota AS (SELECT r, list(word ORDER BY h) AS b FROM upto GROUP BY r),
placed AS (
  SELECT d.doc_id, d.size, t.s, t.target, coalesce(q.b, list_transform(range({mixing.SHARDS + 1}), lambda x: 0)) AS b,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.okey, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_word
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN quota q ON q.r = t.r)
SELECT doc_id, size, s AS source_size, target, list_sum(words)::BIGINT AS taken, array_to_string(words, ',') AS shard_words
FROM (SELECT *, list_transform(range(1, {mixing.SHARDS + 1}), lambda k:
        ({" + ".join(f"greatest(0, least(start_word + {e} * s + size, b[k + 1]) - greatest(start_word + {e} * s, b[k]))" for e in range(mixing.MAX_REPEAT))})::BIGINT) AS words
      FROM placed)
"""

OP3 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, {_SPACES}), '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= {linededup.MIN_CHARS} GROUP BY key
           HAVING count(DISTINCT doc_id) >= {linededup.MIN_DOCS}),
marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5 = f"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM words),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM windows),
repeated AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat FROM seen, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY doc_id),
split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM words),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
own AS (SELECT *, regexp_extract_all(line, '{WORD}') AS ws, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM lines),
judged AS (
  SELECT doc_id, len(ws) AS n, nth,
         2 * len(list_filter(ws, lambda x: regexp_matches(x, {_quoted(quality_rules.NOISY_WORD)}))) > len(ws)
         OR NOT regexp_matches(line, {_quoted(quality_rules.SENTENCE_END)}) OR regexp_matches(line, {_quoted(quality_rules.NAVIGATION)})
         OR regexp_matches(lower(line), {_quoted(quality_rules.BOILERPLATE)}) AS lost
  FROM own WHERE len(ws) > 0),
by_line AS (SELECT doc_id, count(*) FILTER (nth > 1) AS dups, coalesce(sum(n) FILTER (NOT lost), 0) AS kept_words FROM judged GROUP BY doc_id),
stats AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{quality_rules.SYMBOLS.pattern}'))::BIGINT AS n_symbols,
         coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0) AS kept_words
  FROM words w LEFT JOIN repeated USING (doc_id) LEFT JOIN by_line USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words)
       AND kept_words >= {quality_rules.MIN_KEPT_SHARE} * n_words AS kept
FROM stats
"""

OP9 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} AND page_id < last THEN last END AS refers_to
FROM m
"""


def _shingled(table: str, key: str) -> str:
    n = decontam.SHINGLE_WORDS
    return f"""
  SELECT DISTINCT {key}, array_to_string(ws[i:i + least({n}, len(ws)) - 1], ' ') AS shingle
  FROM (SELECT {key}, ws, unnest(range(1, len(ws) - least({n}, len(ws)) + 2)) AS i
        FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {table}) WHERE len(ws) > 0)"""


OP10 = f"""
WITH d AS ({_shingled("documents", "doc_id")}), b AS ({_shingled("benchmark", "item_id")}),
size AS (SELECT item_id, count(*)::BIGINT AS item_shingles FROM b GROUP BY item_id),
met AS (SELECT doc_id, item_id, count(*)::BIGINT AS shared FROM d JOIN b USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM met JOIN size USING (item_id) WHERE shared >= {decontam.THRESHOLD} * item_shingles - 1e-9
"""



def _rounds() -> str:
    """One CTE pair per round: the vectors at their centroid, and the centroids after it."""
    def at(r: int) -> str:
        return f"""
at{r} AS (
  SELECT v.vec_id, v.v, arg_min(c.cluster, d * {centroids.CENTROIDS} + c.cluster) AS cluster, min(d) AS distance
  FROM (SELECT v.vec_id, v.v, c.cluster, list_sum(list_transform(range(1, {centroids.COMPONENTS + 1}), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))::BIGINT AS d
        FROM kept v, c{r} c) x JOIN kept v USING (vec_id) JOIN c{r} c USING (cluster) GROUP BY v.vec_id, v.v)"""

    def after(r: int) -> str:
        return f"""
c{r + 1} AS (
  SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (
    SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT cluster, i, sum(v[i])::BIGINT AS total, count(*)::BIGINT AS n FROM at{r}, (SELECT unnest(range(1, {centroids.COMPONENTS + 1})) AS i) GROUP BY cluster, i)
    GROUP BY cluster) m USING (cluster))"""

    return ",".join(at(r) + "," + after(r) for r in range(centroids.ROUNDS)) + "," + at(centroids.ROUNDS)


OP11 = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {centroids.COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.COMPONENTS}),
c0 AS (SELECT v AS c, row_number() OVER (ORDER BY sha256('{centroids.START_SEED}:' || vec_id::VARCHAR)) - 1 AS cluster FROM kept
       QUALIFY cluster < {centroids.CENTROIDS}),{_rounds()}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM at{centroids.ROUNDS} JOIN c{centroids.ROUNDS} USING (cluster)
"""

_LETTERS = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f)"

OP12 = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
said AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
words AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         list_filter([CASE WHEN len(ws) < {audit.MIN_WORDS} THEN 'A' END,
                      CASE WHEN 100 * len(list_distinct(ws)) < {audit.MIN_DISTINCT_PERCENT} * len(ws) THEN 'B' END,
                      CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {audit.MAX_UPPER_PERCENT} * length(text) THEN 'C' END,
                      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                      CASE WHEN words.doc_id > first THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM words LEFT JOIN said USING (doc_id)),
n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM d GROUP BY part, fails),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM {_LETTERS} a, {_LETTERS} b, {_LETTERS} c, {_LETTERS} d, {_LETTERS} e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS f FROM orders, (SELECT unnest(range(1, 6)) AS step)),
run AS (
  SELECT part, filter_order, step, f, n, g, x, fails, list_contains(fails, f) AS failing,
         len(list_filter(fails, lambda y: position(y IN filter_order) < step)) > 0 AS gone
  FROM steps, n),
counted AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = [f]), 0)::BIGINT AS unique_fails, coalesce(sum(g) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost,
         coalesce(sum(x) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost
  FROM run GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""

OP13 = f"""
WITH RECURSIVE u AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= {epsilon_join.THRESHOLD}),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other),
low AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT x, count(*)::BIGINT AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM low LEFT JOIN degree ON degree.x = low.vec_id
"""

SQL: dict[str, str] = {"op1_mixing": OP1, "op3_line_dedup": OP3, "op5_quality_rules": OP5, "op9_warc": OP9, "op10_decontamination": OP10,
                       "op11_centroid_clustering": OP11, "op12_filter_interaction_audit": OP12,
                       "op13_embedding_near_dedup": OP13}
