"""The queries that SQL can express, for DuckDB over views named like the test tables."""

from __future__ import annotations

from evalspark.llm.mixing import CYCLE, MAX_REPEATS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
# DuckDB's lower() also changes other letters; the contract lowers A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(list_extract([{", ".join(f"{w}.0" for w in CYCLE)}], CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(CYCLE)} + 1 AS BIGINT)) AS DOUBLE) AS weight
  FROM sized GROUP BY source
), limits AS (
  SELECT *, CAST(source_size * {MAX_REPEATS} AS DOUBLE) AS lim, CAST((SELECT sum(source_size) FROM totals) AS DOUBLE) AS everything FROM totals
), shares AS (
  SELECT *, (everything - coalesce(sum(lim) OVER front, 0.0)) / sum(weight) OVER back AS share,
         row_number() OVER (ORDER BY lim / weight, source ASC NULLS LAST) AS place
  FROM limits
  WINDOW front AS (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         back AS (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
  SELECT source, source_size, least(lim, coalesce((SELECT arg_min(share, place) FROM shares WHERE lim >= share * weight) * weight, lim)) AS target
  FROM shares
), placed AS (
  SELECT s.*, t.source_size, t.target,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), queued AS (
  SELECT *, (r.round * source_size + upto) / target AS finish
  FROM placed, (SELECT unnest(range({MAX_REPEATS})) AS round) r
  WHERE size > 0 AND target > 0 AND r.round * source_size + upto - size < target
), served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, key, doc_id, size, round ROWS UNBOUNDED PRECEDING) AS total FROM queued
), taken AS (
  SELECT doc_id, source, size, upto, count(*) AS copies FROM served WHERE total <= (SELECT sum(target) FROM targets) GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(p.size * coalesce(t.copies, 0) AS BIGINT) AS taken, p.source, CAST(coalesce(t.copies, 0) AS INTEGER) AS copies
FROM placed p LEFT JOIN taken t
  ON p.doc_id IS NOT DISTINCT FROM t.doc_id AND p.source IS NOT DISTINCT FROM t.source AND p.size = t.size AND p.upto = t.upto
"""

REPEATS = rf"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h FROM words, unnest(range(1, len(w) - 48)) AS x(s)),
earliest AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
hit AS (SELECT doc_id, list(s) AS starts FROM windows JOIN earliest USING (h) WHERE first < doc_id GROUP BY doc_id),
covered AS (SELECT DISTINCT doc_id, p FROM hit, unnest(starts) AS y(s), unnest(range(s, s + 50)) AS z(p)),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
numbered AS (SELECT doc_id, p, w[p] AS word FROM words, unnest(range(1, len(w) + 1)) AS x(p)),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM numbered ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT a AS node, a AS hub FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.hub),
components AS (SELECT node, min(hub) AS component FROM reached GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN components ON node = vec_id
"""

NEAR = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
reached AS (SELECT a AS node, a AS hub FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.hub),
components AS (SELECT node, min(hub) AS component FROM reached GROUP BY node)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN components ON node = d.doc_id
"""

NEAREST = """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

HARD = """
WITH good AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id % 50 = 0 AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike AND other <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 100 * s.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""

PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
runs AS (SELECT lang, m, array_to_string(w[s : s + m - 1], ' ') AS phrase FROM words, unnest(range(1, 6)) AS a(m), unnest(range(1, len(w) - m + 2)) AS b(s)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.f AS a, k, string_split(c.phrase, ' ') AS w,
         array_to_string(string_split(c.phrase, ' ')[: k], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[k + 1 :], ' ') AS tail
  FROM counts c, unnest(range(1, 5)) AS x(k) WHERE c.m > 1 AND k < c.m
), scored AS (
  SELECT t.lang, t.m, t.phrase, a, h.f AS l, e.f AS r, n, k, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(h.f AS HUGEINT) * e.f) AS BIGINT) AS score
  FROM cuts t JOIN counts h ON h.lang = t.lang AND h.phrase = head JOIN counts e ON e.lang = t.lang AND e.phrase = tail JOIN sizes z ON z.lang = t.lang
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
-- No phrase occurs more often than one inside it, so "as often" is "equally often".
covered AS (
  SELECT DISTINCT p.lang, p.phrase FROM lowest p JOIN lowest q
  ON q.lang = p.lang AND q.a = p.a AND q.m > p.m AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest ANTI JOIN covered USING (lang, phrase)
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

LINES = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
split AS (SELECT rid, doc_id, text, string_split(text, chr(10)) AS l FROM docs WHERE text IS NOT NULL),
raw AS (SELECT rid, doc_id, text, p, l[p] AS line FROM split, unnest(range(1, len(l) + 1)) AS u(p)),
masked AS (
  SELECT rid, doc_id, text, p, regexp_replace(trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM raw
), lines AS (SELECT * FROM masked WHERE m <> ''),
shapes AS (
  SELECT m, string_split(m, ' ') AS w, len(string_split(m, ' ')) AS n, array_to_string(string_split(m, ' ')[1 : 3], ' ') AS lead, count(*) AS weight FROM lines GROUP BY m
), words AS (SELECT m, n, lead, weight, q, w[q] AS word, q > 3 AND w[q] <> '<*>' AS plain FROM shapes, unnest(range(1, n + 1)) AS u(q)),
-- How many lines of a leaf have a word at a place.
common AS (SELECT n, lead, q, word, sum(weight) AS f FROM words WHERE plain GROUP BY ALL),
counted AS (SELECT s.*, coalesce(c.f, 0) AS f FROM words s LEFT JOIN common c ON plain AND c.n = s.n AND c.lead = s.lead AND c.q = s.q AND c.word = s.word),
limits AS (SELECT m, step, 10 * pow(2, step) AS least FROM (SELECT m, max(f) AS top FROM counted GROUP BY m), unnest(range(0, 40)) AS u(step) WHERE step = 0 OR 10 * pow(2, step) <= top),
templates AS (
  SELECT m, step, string_agg(CASE WHEN plain AND f < least THEN '<*>' ELSE word END, ' ' ORDER BY q) AS template,
         count(*) FILTER (WHERE plain) AS k, count(*) FILTER (WHERE plain AND f >= least) AS kept,
         count(*) FILTER (WHERE word = '<*>' OR plain AND f < least) AS fields,
         count(*) FILTER (WHERE (NOT plain OR f >= least) AND regexp_matches(word, '\p{L}')) AS letters
  FROM counted JOIN limits USING (m) GROUP BY m, step
), fitting AS (SELECT m, step, template FROM templates WHERE kept >= 0.75 * k AND letters >= fields),
recurring AS (SELECT template FROM lines JOIN fitting USING (m) GROUP BY template HAVING count(DISTINCT text) >= 10),
chosen AS (SELECT m, arg_min(template, step) AS template FROM fitting JOIN recurring USING (template) GROUP BY m),
placed AS (SELECT rid, doc_id, p, template FROM lines JOIN chosen USING (m)),
earliest AS (SELECT template, min(doc_id) AS first FROM placed GROUP BY template),
gone AS (SELECT rid, p FROM placed JOIN earliest USING (template) WHERE doc_id IS DISTINCT FROM first),
rest AS (SELECT rid, string_agg(line, chr(10) ORDER BY p) AS kept FROM raw ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(length(coalesce(kept, '')) AS INTEGER) AS n_chars_kept, CAST(len(string_split(coalesce(kept, ''), chr(10))) AS INTEGER) AS n_lines_kept, md5(coalesce(kept, '')) AS kept_md5
FROM docs LEFT JOIN rest USING (rid)
"""

ORACLE_SQL = {
    "op3_line_templates": LINES, "op4_fair_mix": MIX, "op7_substring_dedup": REPEATS, "op8_embedding_dedup": VECTORS, "op9_minhash": NEAR, "op11_cross_polytope": NEAREST, "op12_hard_negatives": HARD, "op13_collocations": PHRASES,
}
