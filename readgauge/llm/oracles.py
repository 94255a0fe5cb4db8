"""SQL twins of the operators that SQL can express, for DuckDB."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES = {
    "op11_benchmark_decontamination": f"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w
    FROM documents),
b AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
found AS (
    SELECT t.row, t.i, t.n, x.item
    FROM (SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
          FROM (SELECT d.row, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i
                FROM d, (SELECT DISTINCT n FROM windows) s WHERE len(d.w) >= s.n)) t
    JOIN windows x ON x.n = t.n AND x.win = t.win),
hits AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM found) GROUP BY row),
items AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN items USING (row)""",
    "op12_ranked_search": f"""
WITH t AS (
    SELECT row, doc_id, {LOWER.format("unnest(regexp_extract_all(text, '" + TERM + "'))")} AS term
    FROM (SELECT *, row_number() OVER () AS row FROM documents)),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
docs AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS len FROM docs),
items AS (
    SELECT DISTINCT item_id, {LOWER.format("unnest(regexp_extract_all(text, '" + TERM + "'))")} AS term FROM benchmark),
w AS (
    SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
scores AS (
    SELECT item_id, row, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // len))))::BIGINT AS score
    FROM items JOIN tf USING (term) JOIN w USING (term) JOIN docs USING (row), total
    GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10""",
    "op13_source_divergence": f"""
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
    FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
tf AS (
    SELECT row, lang, source, term, count(*) AS n
    FROM (SELECT row, lang, source, {LOWER.format("unnest(regexp_extract_all(text, '" + LETTERS + "'))")} AS term FROM d)
    GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM tf GROUP BY lang, term HAVING count(*) >= 30),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0)::BIGINT AS total
    FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, sum(tf.n)::BIGINT AS n FROM tf SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
    SELECT gr.lang, gr.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (gr.total + 5 * l.v) AS p,
        1 + (1000000000 * (k.n + 5)) // (l.total + 5 * l.v) AS q
    FROM groups gr JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM (FROM pair UNION ALL FROM term))
WHERE part = 'pair' OR rank <= 50""",
}
