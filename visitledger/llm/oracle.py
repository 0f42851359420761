"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

ORACLE = {
    "op2_mixing": r"""
WITH docs AS (
    SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents),
named AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
    FROM docs GROUP BY source),
weighed AS (
    SELECT *, source_size * 3 AS cap, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
           CASE place % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS ramp
    FROM named),
ranked AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, place) AS rank FROM weighed),
levels AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
    FROM ranked WINDOW before AS (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT rank AS free_rank, level AS free_level FROM levels WHERE cap > level * weight ORDER BY rank LIMIT 1),
targets AS (
    SELECT source, source_size, ramp,
           CASE WHEN free_rank IS NULL OR rank < free_rank THEN CAST(cap AS DOUBLE) ELSE free_level * weight END AS target
    FROM levels LEFT JOIN free ON TRUE),
placed AS (
    SELECT doc_id, size, source_size, target, ramp,
           CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key NULLS FIRST, doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (
    SELECT *, k, greatest(least(CAST(floor(target) AS BIGINT) - before - source_size * k, size), 0) AS words,
           (before + source_size * k)::DOUBLE / nullif(target, 0) AS share
    FROM placed CROSS JOIN range(3) r(k)),
timed AS (
    SELECT *, (2.0::DOUBLE * share) / ((1.0::DOUBLE - ramp)
        + sqrt(greatest((1.0::DOUBLE - ramp) * (1.0::DOUBLE - ramp) + 4.0::DOUBLE * ramp * share, 0))) AS position
    FROM passes)
SELECT doc_id, size, source_size, target, CAST(sum(words) AS BIGINT) AS taken,
       min(position) FILTER (WHERE words > 0) AS first_position
FROM timed GROUP BY doc_id, size, source_size, target, before
""",
    "op4_exact_dedup": """
WITH docs AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM docs WINDOW same AS (PARTITION BY t)
""",
    "op5_warc": """
WITH bodies AS (
    SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM bodies)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM grouped
""",
    "op11_spelling": r"""
WITH RECURSIVE
steps AS (
    SELECT list_transform(range(256), lambda k: list_reduce(list_concat([k], range(8)),
               lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
runs AS (
    SELECT doc_id, run, count(*) AS n, CAST(doc_id AS VARCHAR) || ':' || run AS salted
    FROM (SELECT doc_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
          FROM documents)
    GROUP BY ALL),
hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
               list_concat([4294967295], flatten(list_transform(string_split(salted, ''), lambda x:
                   CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))),
               lambda c, b: xor(c >> 8, step[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) AS h
    FROM runs, steps),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
                    ELSE run END AS word FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
    SELECT word, i, left(word, i) AS a, substr(word, i + 2) AS z
    FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
links AS (
    SELECT c.word, d.word AS near FROM cuts c JOIN cuts d USING (i, a, z) WHERE c.word <> d.word
    UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.a || c.z
    UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.a || c.z),
ranked AS (
    SELECT l.word, near, x.n AS near_n, count(*) OVER (PARTITION BY l.word) AS n_near,
           row_number() OVER (PARTITION BY l.word ORDER BY x.n DESC, near) AS place
    FROM links l JOIN words x ON x.word = near),
forms AS (
    SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
           CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
chains AS (
    SELECT word, word AS root FROM forms WHERE form IS NULL
    UNION ALL SELECT f.word, c.root FROM forms f JOIN chains c ON f.form = c.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chains USING (word)
""",
    "op12_search": r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
size AS (
    SELECT CAST(count(*) AS BIGINT) AS total_docs, CAST(sum(len(terms)) AS BIGINT) AS total_terms
    FROM docs WHERE len(terms) > 0),
postings AS (
    SELECT doc_id, n, term, count(*) AS tf
    FROM (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * total_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), size),
asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
    SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf
               + 8 * (100 - 75 + (75 * n * total_docs) // total_terms)))) AS BIGINT) AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term), size GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY rank <= 10
""",
}
