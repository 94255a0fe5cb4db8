"""The catalog's queries in DuckDB SQL."""

from __future__ import annotations

from ..functions import lexicon
from .catalog import LANGUAGE_CUES, MATRIX, ROUND_WIDE, TEST_CUES, TURN_ROLES
from .feature_table import MEASURES

ORACLES = {}

BLANKS = "' ' || chr(10) || chr(9) || chr(13)"
PAIRS = """pairs AS (
  SELECT u.conv_id || '-' || u.turn AS doc_id, u.text AS abstract, coalesce(a.text, '') AS summary
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""
SECTIONS = PAIRS + """, sections AS (
  SELECT doc_id, 'abstract' AS section, abstract AS text FROM pairs
  UNION ALL SELECT doc_id, 'summary', summary FROM pairs)"""


def sents(t):
    return (f"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?]+)[ \\n\\t\\r]+', '\\1' || chr(1), 'g'), "
            f"chr(1)), lambda s: trim(s, {BLANKS})), lambda s: s <> '')")


def words(t):
    return rf"regexp_extract_all({t}, '[\p{{L}}\p{{N}}]+')"


def n_words(t):
    return f"len({words(t)})"


def n_sents(t):
    return f"len({sents(t)})"


def asl(t):
    return f"coalesce({n_words(t)} / nullif({n_sents(t)}, 0)::DOUBLE, 0)"


def in_list(x, terms):
    return f"{x} IN ({', '.join(repr(w) for w in terms)})"


def clauses(t):
    return (f"coalesce(len(list_filter({words(f'lower({t})')}, lambda w: {in_list('w', lexicon.CLAUSE_MARKERS)}))"
            f" / nullif({n_sents(t)}, 0)::DOUBLE, 0)")


def n_syllables(t):
    runs = "len(regexp_extract_all(w, '[aeiouyAEIOUY]+'))"
    silent = f"CASE WHEN {runs} > 1 AND regexp_matches(w, '[^aeiouyAEIOUYlL][eE]$') THEN 1 ELSE 0 END"
    return f"coalesce(list_sum(list_transform({words(t)}, lambda w: greatest(1, {runs} - {silent}))), 0)::BIGINT"


def fkgl(w, s, y):
    return f"(0.39 * coalesce({w} / nullif({s}, 0)::DOUBLE, 0) + 11.8 * coalesce({y} / nullif({w}, 0)::DOUBLE, 0) - 15.59)"


def fre(w, s, y):
    return f"(206.835 - 1.015 * coalesce({w} / nullif({s}, 0)::DOUBLE, 0) - 84.6 * coalesce({y} / nullif({w}, 0)::DOUBLE, 0))"


def has_word(s, terms):
    alternatives = "|".join(terms)
    return rf"regexp_matches(lower({s}), '(^|[^\p{{L}}\p{{N}}])({alternatives})($|[^\p{{L}}\p{{N}}])')"


def has_part(s, terms):
    return "(" + " OR ".join(f"contains(lower({s}), '{t}')" for t in terms) + ")"


def coverage(t, has):
    return (f"coalesce(len(list_filter({sents(t)}, lambda s: {has('s', lexicon.CONNECTIVES)}))"
            f" / nullif({n_sents(t)}, 0)::DOUBLE, 0)")


def cue(s, cues, default):
    whens = " ".join(f"WHEN {has_word(s, terms)} THEN '{name}'" for name, terms in cues.items())
    return f"CASE {whens} ELSE '{default}' END"


def role_share(t, role):
    return (f"coalesce(len(list_filter({sents(t)}, lambda s: {cue('s', TEST_CUES, 'background')} = '{role}'))"
            f" / nullif({n_sents(t)}, 0)::DOUBLE, 0)")


def both(measures):
    """``measures``: name -> function of the text column."""
    return ", ".join(f"{f(s)} AS {s}_{n}" for s in ("abstract", "summary") for n, f in measures.items())


BASIC = {"length": n_words, "avg_sentence_length": asl, "avg_clauses": clauses}
WIDE = f"{PAIRS}, wide AS (SELECT doc_id, {both(BASIC)} FROM pairs)"
GAPPY = WIDE + """, gappy AS (SELECT doc_id, abstract_length, abstract_avg_sentence_length, abstract_avg_clauses,
  CASE WHEN summary_length <> 0 THEN summary_length END AS summary_length,
  CASE WHEN summary_length <> 0 THEN summary_avg_sentence_length END AS summary_avg_sentence_length,
  CASE WHEN summary_length <> 0 THEN summary_avg_clauses END AS summary_avg_clauses FROM wide)"""


def rounded(*columns):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


ALL_WIDE = "doc_id, abstract_length, summary_length, " + rounded(*ROUND_WIDE)
ONE_LINE = r"trim(regexp_replace({}, '[\t\r\n]+', ' ', 'g'))"

ORACLES["src_json_articles"] = f"WITH {PAIRS} SELECT doc_id, abstract, summary FROM pairs"
ORACLES["src_json_array"] = f"""WITH {PAIRS}
  SELECT doc_id AS file, doc_id, abstract || ' ' || summary AS abstract, summary FROM pairs
  UNION ALL SELECT doc_id, 'doc_2', summary, '' FROM pairs"""
ORACLES["src_csv_pairs"] = ORACLES["src_json_articles"]
ORACLES["src_feature_csv"] = f"WITH {GAPPY} SELECT {ALL_WIDE} FROM gappy"
ORACLES["src_labelled_groups"] = f"""WITH {PAIRS}
  SELECT doc_id AS abstract_id, 0 AS pos, 'QUESTION' AS label, {ONE_LINE.format('abstract')} AS sentence FROM pairs
  UNION ALL SELECT doc_id, 1, 'ANSWER', {ONE_LINE.format('summary')} FROM pairs WHERE summary <> ''"""
ORACLES["src_labelled_flat"] = f"SELECT {ONE_LINE.format('text')} AS text, role AS label FROM conversations WHERE role <> 'system'"
ORACLES["src_labelled_rejects"] = f"""SELECT {ONE_LINE.format('text')} AS line FROM conversations
  WHERE role = 'system' AND text NOT LIKE '###%'"""
ORACLES["extract_after_marker"] = f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
  m AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: contains(x, ', the')), true) AS hit FROM l)
  SELECT doc_id, replace(trim(coalesce(CASE WHEN hit > 0 THEN lines[hit + 1] END, ''), {BLANKS}), 'and', '') AS found FROM m"""
ORACLES["prep_min_length"] = "SELECT doc_id, source, lang, n_chars, text FROM documents WHERE length(text) > 100"
ORACLES["prep_dataset"] = rf"""WITH f AS (SELECT doc_id AS id, source AS "Paper_Journal", lang AS "Eureka_Text_Simplified",
    replace(trim(string_split(text, chr(10))[1], {BLANKS}), '#@NEW_LINE#@#', '') AS "Paper_abstract"
    FROM documents)
  SELECT * FROM f WHERE length("Paper_abstract") > 100"""
JUDGED = f"""judged AS (SELECT doc_id, source, lang AS label, {cue('text', LANGUAGE_CUES, 'es')} AS prediction FROM documents)"""
ORACLES["sink_json_results"] = f"""WITH {JUDGED} SELECT source, count(*) FILTER (label = prediction) AS hit,
  count(*) FILTER (label <> prediction) AS miss, round(avg((label = prediction)::INT), 6) AS accuracy, 'hit,miss' AS labels
  FROM judged GROUP BY source"""

ORACLES["features_wide"] = f"WITH {WIDE} SELECT {ALL_WIDE} FROM wide"
ORACLES["reshape_fixed"] = f"""WITH {SECTIONS} SELECT doc_id, section AS type,
  round({role_share('text', 'background')}, 6) AS background_ratio, round({role_share('text', 'objective')}, 6) AS objective_ratio
  FROM sections"""
TYPED = WIDE + """, typed AS (SELECT * REPLACE (CASE WHEN doc_id LIKE '%-0' THEN 'eLife-' WHEN doc_id LIKE '%-2' THEN 'journal.p-'
  ELSE 'x-' END || doc_id AS doc_id) FROM wide), long AS (
  SELECT doc_id, 'abstract' AS type, abstract_length AS length, abstract_avg_sentence_length AS avg_sentence_length,
    abstract_avg_clauses AS avg_clauses FROM typed
  UNION ALL SELECT doc_id, CASE WHEN contains(lower(doc_id), 'elife') THEN 'summary-elife'
    WHEN contains(lower(doc_id), 'journal') THEN 'summary-plos' ELSE 'summary' END,
    summary_length, summary_avg_sentence_length, summary_avg_clauses FROM typed)"""
ORACLES["reshape_flexible"] = f"""WITH {TYPED} SELECT doc_id, type, length, {rounded('avg_sentence_length', 'avg_clauses')} FROM long"""
ORACLES["schema_profile"] = """SELECT c AS "column", g AS "group", f AS feature, b AS in_both,
  (SELECT count(*) FROM conversations WHERE role = 'user') AS n_rows
  FROM (VALUES ('doc_id', 'other', 'doc_id', false), ('note', 'other', 'note', false),
    ('abstract_length', 'abstract', 'length', true), ('summary_length', 'summary', 'length', true),
    ('abstract_avg_sentence_length', 'abstract', 'avg_sentence_length', true),
    ('summary_avg_sentence_length', 'summary', 'avg_sentence_length', true),
    ('abstract_avg_clauses', 'abstract', 'avg_clauses', false)) t(c, g, f, b)"""
ORACLES["select_by_target"] = f"""WITH {WIDE} SELECT doc_id, summary_length,
  {rounded('summary_avg_sentence_length', 'summary_avg_clauses')} FROM wide"""
ORACLES["label_map"] = f"""WITH {TYPED} SELECT doc_id, type, length,
  CASE type WHEN 'abstract' THEN 0 WHEN 'summary-elife' THEN 1 ELSE 2 END AS label FROM long WHERE type <> 'summary'"""
ORACLES["label_map_complete"] = f"""WITH {TYPED} SELECT doc_id, type, length, CASE type WHEN 'abstract' THEN 0 WHEN 'summary' THEN 1
  WHEN 'summary-elife' THEN 2 ELSE 3 END AS label FROM long"""
ORACLES["complete_cases"] = f"""WITH {GAPPY} SELECT {ALL_WIDE} FROM gappy
  WHERE summary_length IS NOT NULL AND abstract_length IS NOT NULL"""

def n_clauses(t):
    return f"len(list_filter({words(f'lower({t})')}, lambda w: {in_list('w', lexicon.CLAUSE_MARKERS)}))"


MERGED = {
    "length": (lambda t: f"{n_words(t)}::DOUBLE", "summary <> ''"),
    "sentences": (lambda t: f"{n_sents(t)}::DOUBLE", f"{n_sents('abstract')} > 1"),
    "avg_sentence_length": (asl, f"{n_sents('summary')} > 1"),
    "avg_clauses": (clauses, f"{n_clauses('abstract')} > 0"),
    "pdtb_coverage": (lambda t: coverage(t, has_part), f"{n_clauses('summary')} > 0"),
}
ORACLES["merge_features"] = f"WITH {PAIRS}, " + ", ".join(
    f"t{i} AS (SELECT doc_id, round({f('abstract')}, 6) AS abstract_{n}, round({f('summary')}, 6) AS summary_{n} FROM pairs "
    f"WHERE {where})" for i, (n, (f, where)) in enumerate(MERGED.items())
) + " SELECT * FROM t0 FULL JOIN t1 USING (doc_id) FULL JOIN t2 USING (doc_id) FULL JOIN t3 USING (doc_id) FULL JOIN t4 USING (doc_id)"
ORACLES["lookup_companion"] = """SELECT doc_id, coalesce(url, '') AS companion FROM documents LEFT JOIN pages ON page_id = doc_id"""
ORACLES["concat_corpora"] = """SELECT doc_id AS id, source, n_chars, NULL::VARCHAR AS url FROM documents
  UNION ALL SELECT item_id, NULL, length(text), NULL FROM benchmark UNION ALL SELECT page_id, NULL, NULL, url FROM pages"""

ORACLES["duplicate_keys"] = "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1"
ORACLES["null_profile"] = f"""WITH {GAPPY}, n AS (SELECT count(*) FILTER (summary_length IS NULL) AS n FROM gappy)
  SELECT c AS "column", n AS n_null FROM n, (VALUES ('summary_length'), ('summary_avg_sentence_length'), ('summary_avg_clauses')) t(c)
  WHERE n > 0"""


def described(column):
    v = f"{column}::DOUBLE"
    return f"""SELECT '{column}' AS feature, count({column}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std,
      round(min({v}), 6) AS min, round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.5), 6) AS q50,
      round(quantile_cont({v}, 0.75), 6) AS q75, round(max({v}), 6) AS max FROM gappy"""


ORACLES["describe_features"] = f"WITH {GAPPY} " + " UNION ALL ".join(map(described, (
    "abstract_length", "abstract_avg_sentence_length", "summary_length", "summary_avg_sentence_length")))
ORACLES["class_distribution"] = f"WITH {TYPED} SELECT type, count(*) AS n FROM long GROUP BY type"
ORACLES["role_ratios"] = "SELECT conv_id AS abstract_id, " + ", ".join(
    f"round(avg((role = '{r}')::INT), 6) AS {r}_ratio" for r in TURN_ROLES) + " FROM conversations GROUP BY conv_id"
ORACLES["corpus_role_ratio"] = "SELECT round(avg((role = 'user')::INT), 6) AS ratio FROM conversations"
SHARES = f"{SECTIONS}, shares AS (" + " UNION ALL ".join(
    f"SELECT section, '{r}' AS label, avg({role_share('text', r)}) AS m FROM sections GROUP BY section" for r in lexicon.ROLES) + ")"
ORACLES["mean_role_ratio"] = f"WITH {SHARES} SELECT label, round(avg(m), 6) AS mean_ratio FROM shares GROUP BY label"
ORACLES["mean_role_ratio_by_section"] = f"WITH {SHARES} SELECT section, label, round(m, 6) AS mean_ratio FROM shares"
LENGTHS = f"""{SECTIONS}, lengths AS (SELECT section, {n_words('text')}::DOUBLE AS v FROM sections),
  r AS (SELECT min(v) AS low, max(v) AS high FROM lengths),
  counted AS (SELECT section, least(floor((v - low) / ((high - low) / 20.0)), 19)::BIGINT AS bin, count(*) AS n
    FROM lengths, r GROUP BY ALL),
  bins AS (SELECT section, bin, coalesce(n, 0) AS n, high - low AS span FROM (SELECT DISTINCT section FROM lengths)
    CROSS JOIN range(20) t(bin) CROSS JOIN r LEFT JOIN counted USING (section, bin))"""
ORACLES["feature_histogram"] = f"WITH {LENGTHS} SELECT section, bin, n FROM bins"
ORACLES["feature_density"] = f"""WITH {LENGTHS} SELECT section, bin,
  round(n / (sum(n) OVER (PARTITION BY section) * span / 20), 6) AS density FROM bins"""
ORACLES["feature_kde"] = f"""WITH {LENGTHS},
  s AS (SELECT section, min(v) AS low, max(v) AS high, count(*) AS total, count(*) ** (-0.2) * stddev_samp(v) AS h FROM lengths GROUP BY section),
  g AS (SELECT *, low + point * (high - low) / 49 AS x FROM s, range(50) t(point))
  SELECT section, point::INT AS point, round(any_value(x), 6) AS x,
    round(sum(exp(-(((v - x) / h) ** 2) / 2)) / any_value(h * sqrt(2 * pi()) * total), 6) AS density
  FROM lengths JOIN g USING (section) GROUP BY section, point"""
BASICS = f"""{SECTIONS}, wide AS (SELECT section, {n_words('text')}::DOUBLE AS length, {asl('text')} AS avg_sentence_length,
    {clauses('text')} AS avg_clauses FROM sections),
  long AS (UNPIVOT wide ON length, avg_sentence_length, avg_clauses INTO NAME feature VALUE v)"""
ORACLES["density_curves"] = f"""WITH {BASICS},
  s AS (SELECT * FROM (SELECT section, feature, min(v) AS low, max(v) AS high, count(*) AS total, count(*) ** (-0.2) * stddev_samp(v) AS h
    FROM long GROUP BY ALL) WHERE h > 0),
  p AS (SELECT section, feature, (v - low) / ((high - low) / 1024) AS place FROM long JOIN s USING (section, feature)),
  c AS (SELECT section, feature, least(floor(place), 1023) AS cell, place FROM p),
  w AS (SELECT section, feature, cell, sum(weight) AS weight FROM (
    SELECT section, feature, cell, 1 - (place - cell) AS weight FROM c UNION ALL SELECT section, feature, cell + 1, place - cell FROM c) GROUP BY ALL),
  g AS (SELECT *, low + point * ((high - low) / 49) AS x FROM s, range(50) t(point))
  SELECT section, feature, point::INT AS point, round(any_value(x), 6) AS x,
    round(sum(weight * exp(-(((low + cell * ((high - low) / 1024) - x) / h) ** 2) / 2) / (h * sqrt(2 * pi()) * total)), 6) AS density
  FROM w JOIN g USING (section, feature) GROUP BY section, feature, point"""
ORACLES["histograms"] = f"""WITH {BASICS},
  r AS (SELECT feature, min(v) - if(min(v) = max(v), 0.5, 0) AS low, max(v) + if(min(v) = max(v), 0.5, 0) AS high FROM long GROUP BY feature),
  e AS (SELECT section, feature, bin FROM (SELECT DISTINCT section FROM long), (SELECT DISTINCT feature FROM long), range(20) t(bin)),
  c AS (SELECT section, feature, least(floor((v - low) / ((high - low) / 20)), 19) AS bin, count(*) AS n FROM long JOIN r USING (feature) GROUP BY ALL)
  SELECT section, feature, bin, coalesce(n, 0)::BIGINT AS n,
    round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER (PARTITION BY section, feature) * (high - low) / 20), 6) AS density
  FROM e JOIN r USING (feature) LEFT JOIN c USING (section, feature, bin)"""
ORACLES["confusion_matrix"] = f"""WITH {JUDGED}, c AS (SELECT label AS c FROM judged UNION SELECT prediction FROM judged)
  SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM judged WHERE label = a.c AND prediction = b.c) AS n FROM c a, c b"""
ORACLES["accuracy"] = f"WITH {JUDGED} SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM judged"
ORACLES["classification_report"] = f"""WITH {JUDGED}, c AS (SELECT label AS c FROM judged UNION SELECT prediction FROM judged),
  k AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (prediction = c) AS pp,
    count(*) FILTER (label = c) AS support FROM judged, c GROUP BY c),
  r AS (SELECT c AS class, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
    coalesce(2 * tp / nullif(pp + support, 0), 0) AS f1, support FROM k)
  SELECT class, {rounded('precision', 'recall', 'f1')}, support FROM r
  UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT sum(tp) FROM k) / sum(support), 6), sum(support)::BIGINT FROM r
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM r
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
    round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM r"""
ORACLES["class_weights"] = """SELECT quality, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY quality"""
ORACLES["label_encode"] = """SELECT conv_id AS abstract_id, turn AS pos, role, (dense_rank() OVER (ORDER BY role) - 1)::DOUBLE AS label,
  role AS decoded FROM conversations"""

ORACLES["topk_results"] = f"""WITH {JUDGED}, a AS (SELECT source, avg((label = prediction)::INT) AS accuracy FROM judged GROUP BY source)
  SELECT source, round(accuracy, 6) AS accuracy FROM a ORDER BY a.accuracy DESC, source LIMIT 5"""
ORACLES["topk_longest"] = "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10"
ORACLES["bottomk_shortest"] = "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 10"
ORACLES["cumulative_ratio"] = """WITH s AS (SELECT lang, sum(n_chars) AS n FROM documents GROUP BY lang),
  r AS (SELECT lang, n, n / (SELECT sum(n) FROM s) AS ratio FROM s)
  SELECT lang, round(ratio, 6) AS ratio, round(sum(ratio) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM r"""

ORACLES["sentence_split"] = f"""WITH s AS (SELECT doc_id, {sents('text')} AS s FROM documents)
  SELECT doc_id, (unnest(range(len(s))))::INT AS pos, unnest(s) AS sentence FROM s"""
ORACLES["word_tokens"] = f"""WITH s AS (SELECT doc_id, {words('text')} AS s FROM documents)
  SELECT doc_id, (unnest(range(len(s))))::INT AS pos, unnest(s) AS token FROM s"""
PUNCT = r"len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N} \n\t\r]'))"
ORACLES["text_length"] = f"WITH {SECTIONS} SELECT doc_id, section, {n_words('text')} AS length, {PUNCT} AS length_punct FROM sections"
ORACLES["avg_sentence_length"] = f"WITH {SECTIONS} SELECT doc_id, section, round({asl('text')}, 6) AS avg_sentence_length FROM sections"
ORACLES["syllables"] = f"SELECT doc_id, {n_syllables('text')} AS n_syllables FROM documents"
COUNTS = f"counts AS (SELECT doc_id, {n_words('text')} AS w, {n_sents('text')} AS s, {n_syllables('text')} AS y FROM documents)"
ORACLES["fkgl"] = f"WITH {COUNTS} SELECT doc_id, round({fkgl('w', 's', 'y')}, 6) AS fkgl FROM counts"
ORACLES["fre"] = f"WITH {COUNTS} SELECT doc_id, round({fre('w', 's', 'y')}, 6) AS fre FROM counts"
ORACLES["avg_clause_markers"] = f"SELECT doc_id, round({clauses('text')}, 6) AS avg_clauses FROM documents"
ORACLES["connective_coverage_substring"] = f"SELECT doc_id, round({coverage('text', has_part)}, 6) AS coverage FROM documents"
ORACLES["connective_coverage_word"] = f"SELECT doc_id, round({coverage('text', has_word)}, 6) AS coverage FROM documents"
ORACLES["adjacent_cosine_vectors"] = """WITH v AS (SELECT label, embedding::DOUBLE[] AS a,
    lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
  SELECT label, round(coalesce(avg(list_cosine_similarity(a, b)) FILTER (b IS NOT NULL), 1), 6) AS adjacent_cosine FROM v GROUP BY label"""


def bow(table, keys, text):
    """Named subqueries ending in ``bow({keys}, similarity)``."""
    lead_key = keys.split(",")[0]
    using = f"{keys}, pos"
    return f"""bs AS (SELECT {keys}, {sents(text)} AS s FROM {table}),
  bt AS (SELECT {keys}, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM bs),
  bw AS (SELECT {keys}, pos, unnest({words('lower(sentence)')}) AS w FROM bt),
  bc AS (SELECT {keys}, pos, w, count(*) AS n FROM bw GROUP BY ALL),
  bn AS (SELECT {keys}, pos, sqrt(sum(n * n)) AS norm FROM bc GROUP BY ALL),
  bd AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.pos, sum(a.n * b.n) AS dot FROM bc a JOIN bc b
    ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} AND b.pos = a.pos + 1 AND a.w = b.w GROUP BY ALL),
  bq AS (SELECT {keys}, sum(dot / (norm * norm2)) AS total FROM bd JOIN bn USING ({using})
    JOIN (SELECT {keys}, pos - 1 AS pos, norm AS norm2 FROM bn) USING ({using}) GROUP BY ALL),
  bow AS (SELECT {keys}, CASE WHEN len(s) < 2 THEN 1.0 ELSE coalesce(total, 0) / (len(s) - 1) END AS similarity
    FROM bs LEFT JOIN bq USING ({keys}))"""


ORACLES["adjacent_cosine_bow"] = f"WITH {bow('documents', 'doc_id', 'text')} SELECT doc_id, round(similarity, 6) AS similarity FROM bow"


def content(w):
    return f"(length({w}) >= 4 AND NOT {in_list(w, lexicon.STOP_WORDS)})"


def language(train, scored, keys):
    """Named subqueries ending in ``lm({keys}, cwe, ppl)``; both tables have a column text."""
    k = keys
    return f"""ltw AS (SELECT {words('lower(text)')} AS ws FROM {train}),
  ltp AS (SELECT unnest(ws) AS w, unnest(list_concat(ws[2:], [NULL])) AS nxt FROM ltw WHERE len(ws) > 0),
  lw AS (SELECT w, count(*) AS n, count(nxt) AS ctx FROM ltp GROUP BY w),
  lp AS (SELECT w, nxt, count(*) AS n FROM ltp WHERE nxt IS NOT NULL GROUP BY ALL),
  lt AS (SELECT sum(n) AS total, count(*) AS v FROM lw),
  lsw AS (SELECT {k}, {words('lower(text)')} AS ws FROM {scored}),
  lso AS (SELECT {k}, unnest(ws) AS w, unnest(list_concat(ws[2:], [NULL])) AS nxt FROM lsw WHERE len(ws) > 0),
  lsum AS (SELECT {k},
      avg(-ln(lw.n / total)) FILTER (lw.n IS NOT NULL AND {content('o.w')}) AS cwe,
      exp(avg(-ln((coalesce(lp.n, 0) + 1) / (coalesce(lw.ctx, 0) + v))) FILTER (o.nxt IS NOT NULL)) AS ppl
    FROM lso o LEFT JOIN lw ON o.w = lw.w LEFT JOIN lp ON o.w = lp.w AND o.nxt = lp.nxt, lt GROUP BY {k}),
  lm AS (SELECT {k}, cwe, ppl FROM {scored} LEFT JOIN lsum USING ({k}))"""


ORACLES["content_word_entropy"] = f"WITH {language('documents', 'documents', 'doc_id')} SELECT doc_id, round(cwe, 6) AS cwe FROM lm"
ORACLES["bigram_perplexity"] = f"WITH {language('documents', 'documents', 'doc_id')} SELECT doc_id, round(ln(ppl), 6) AS log_ppl FROM lm"
HASH = "('0x' || substr(md5('42|' || {}), 1, 8))::BIGINT"


def is_test(key, fraction):
    return f"({HASH.format(key)} < {int(fraction * 2**32)})"


ORACLES["bigram_perplexity_heldout"] = f"""WITH train AS (SELECT * FROM documents WHERE NOT {is_test('doc_id', 0.1)}),
  held AS (SELECT * FROM documents WHERE {is_test('doc_id', 0.1)}), {language('train', 'held', 'doc_id')}
  SELECT doc_id, round(ln(ppl), 6) AS log_ppl FROM lm"""


def kneser_ney(train, scored, keys):
    """Named subqueries ending in ``kn({keys}, ppl)``; both tables have a column text."""
    def triples(name, table, columns):
        return f"""{name}w AS (SELECT {columns} {words('lower(text)')} AS ws FROM {table}),
  {name} AS (SELECT {columns} unnest(list_concat(['', ' '], ws)[1:len(ws)]) AS u, unnest(list_concat([' '], ws)[1:len(ws)]) AS v,
    unnest(ws) AS w FROM {name}w WHERE len(ws) > 0)"""

    def discounts(name, table):
        n = [f"count(*) FILTER (n = {i})" for i in (1, 2, 3, 4)]
        step = lambda i, before: (
            f"CASE WHEN n{i} > 0 THEN least({i}.0::DOUBLE, greatest(0.1::DOUBLE, {i} - {i + 1} * (n1 / (n1 + 2 * n2)) * (n{i + 1} / n{i}))) ELSE {before} END")
        return f"""{name}0 AS (SELECT {', '.join(f'({x})::DOUBLE AS n{i}' for i, x in enumerate(n, 1))} FROM {table}),
  {name}1 AS (SELECT *, {step(1, '0.5::DOUBLE')} AS d1 FROM {name}0),
  {name}2 AS (SELECT *, {step(2, 'd1')} AS d2 FROM {name}1),
  {name} AS (SELECT d1, d2, {step(3, 'd2')} AS d3 FROM {name}2)"""

    def taken(n, d):
        return f"coalesce({n} - CASE WHEN {n} = 1 THEN {d}.d1 WHEN {n} = 2 THEN {d}.d2 ELSE {d}.d3 END, 0)"

    def kinds(n):
        return (f"sum({n})::DOUBLE AS total, count(*) FILTER ({n} = 1) AS n1, count(*) FILTER ({n} = 2) AS n2, "
                f"count(*) FILTER ({n} >= 3) AS n3")

    def given(t, d):
        return f"(({d}.d1 * {t}.n1 + {d}.d2 * {t}.n2 + {d}.d3 * {t}.n3) / {t}.total)"

    return f"""{triples('ko', train, '')},
  k3 AS (SELECT u, v, w, count(*) AS n FROM ko GROUP BY ALL), k2 AS (SELECT v, w, count(*) AS n FROM k3 GROUP BY ALL),
  k1 AS (SELECT w, count(*) AS n FROM k2 GROUP BY ALL),
  {discounts('kd3', 'k3')}, {discounts('kd2', 'k2')}, {discounts('kd1', 'k1')},
  kc AS (SELECT u, v, {kinds('n')} FROM k3 GROUP BY ALL), kh AS (SELECT v, {kinds('n')} FROM k2 GROUP BY ALL),
  kt AS (SELECT {kinds('n')}, count(*) AS words FROM k1),
  {triples('kq', scored, keys + ',')},
  kp AS (SELECT {', '.join('q.' + k.strip() for k in keys.split(','))},
      CASE WHEN c.total IS NULL THEN p2 ELSE {taken('k3.n', 'kd3')} / c.total + {given('c', 'kd3')} * p2 END AS p
    FROM (SELECT q.*, CASE WHEN h.total IS NULL THEN p1 ELSE {taken('k2.n', 'kd2')} / h.total + {given('h', 'kd2')} * p1 END AS p2
      FROM (SELECT q.*, {taken('k1.n', 'kd1')} / kt.total + {given('kt', 'kd1')} / (kt.words + 1) AS p1
        FROM kq q LEFT JOIN k1 USING (w), kt, kd1) q
      LEFT JOIN k2 USING (v, w) LEFT JOIN kh h USING (v), kd2) q
    LEFT JOIN k3 USING (u, v, w) LEFT JOIN kc c USING (u, v), kd3),
  kn AS (SELECT {keys}, exp(avg(-ln(p))) AS ppl FROM {scored} LEFT JOIN kp USING ({keys}) GROUP BY {keys})"""


ORACLES["kneser_ney_perplexity"] = f"WITH {kneser_ney('documents', 'documents', 'doc_id')} SELECT doc_id, round(ln(ppl), 6) AS log_ppl FROM kn"
ORACLES["kneser_ney_perplexity_heldout"] = f"""WITH train AS (SELECT * FROM documents WHERE NOT {is_test('doc_id', 0.1)}),
  held AS (SELECT * FROM documents WHERE {is_test('doc_id', 0.1)}), {kneser_ney('train', 'held', 'doc_id')}
  SELECT doc_id, round(ln(ppl), 6) AS log_ppl FROM kn"""
ORACLES["word_associations"] = f"""WITH a AS (SELECT row_number() OVER () AS r, {sents('lower(text)')} AS s FROM documents),
  b AS (SELECT r, unnest(range(len(s))) AS p, {words('unnest(s)')} AS ws FROM a),
  c AS (SELECT r, p, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM b),
  whole AS (SELECT unnest({words('lower(text)')}) AS w FROM documents),
  known AS (SELECT w FROM whole GROUP BY w HAVING count(*) >= 5 ORDER BY count(*) DESC, w LIMIT 50000),
  x AS (SELECT c.* FROM c SEMI JOIN known USING (w)),
  one AS (SELECT x.w, y.w AS near FROM x JOIN x y ON x.r = y.r AND x.p = y.p AND y.i > x.i AND y.i <= x.i + 4),
  n AS (SELECT w, near, count(*) AS n FROM (SELECT * FROM one UNION ALL SELECT near, w FROM one) GROUP BY ALL),
  m AS (SELECT w, sum(n) AS n FROM n GROUP BY w), t AS (SELECT sum(n) AS n FROM n)
  SELECT n.w, n.near, n.n, round(ln(n.n::DOUBLE * t.n::DOUBLE / (a.n::DOUBLE * b.n::DOUBLE)), 6) AS ppmi
  FROM n JOIN m a ON a.w = n.w JOIN m b ON b.w = n.near, t WHERE n.n::DOUBLE * t.n::DOUBLE > a.n::DOUBLE * b.n::DOUBLE"""


def token_type(t):
    core = rf"regexp_replace(regexp_replace(lower({t}), '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '')"
    return rf"CASE WHEN regexp_matches({core}, '^\p{{N}}[\p{{N}}.,]*$') THEN '#' ELSE {core} END"


STOPS = r"regexp_matches({}, '[\p{{L}}\p{{N}}]\.$')"
def tokens(listed=""):
    """The types and the abbreviations among them; ``listed``: which of these."""
    return rf"""tl AS (SELECT regexp_extract_all(text, '[^ \n\t\r]+') AS t FROM documents),
  tk AS (SELECT unnest(t) AS token, unnest(list_concat([''], t[:-2])) AS before FROM tl WHERE len(t) > 0),
  ty AS (SELECT {token_type('token')} AS type, {STOPS.format('token')} AS stop, {token_type('before')} AS previous,
    {STOPS.format('before')} AS previous_stop, before = '' OR regexp_matches(before, '[.!?]$') AS after_end FROM tk),
  tc AS (SELECT type, count(*) FILTER (stop) AS n_stop, count(*) FILTER (NOT stop) AS n_plain FROM ty WHERE type <> '' GROUP BY type),
  tt AS (SELECT sum(n_stop)::DOUBLE AS stops, sum(n_stop + n_plain)::DOUBLE AS tokens FROM tc),
  ta AS (SELECT type, n_stop, n_plain, 2 * (n_stop * ln(0.99) + n_plain * ln(0.01)
      - n_stop * ln(stops / tokens) - n_plain * ln(1 - stops / tokens))
      * exp(-(length(type) - dots)::DOUBLE) * (dots + 1) * pow((length(type) - dots)::DOUBLE, -n_plain::DOUBLE) AS score
    FROM (SELECT *, length(type) - length(replace(type, '.', '')) AS dots FROM tc), tt
    WHERE n_stop > 0 AND regexp_matches(type, '\p{{L}}')),
  tb AS (FROM ta WHERE score >= 0.3{listed}),
  tf AS (SELECT CASE WHEN short THEN previous END AS previous, type, count(*)::DOUBLE AS n_both FROM (
      SELECT *, previous = '#' OR regexp_matches(previous, '^\p{{L}}$') OR previous IN (SELECT type FROM tb) AS short FROM ty)
    WHERE type NOT IN ('', '#') AND previous <> '' AND CASE WHEN short THEN previous_stop ELSE after_end END GROUP BY ALL)"""


def ratio_score(both, a, b, n):
    part = lambda k, m, p: (
        f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {m} - {k} > 0 THEN ({m} - {k}) * ln(1 - {p}) ELSE 0 END)")
    x, y = f"({both} / {a})", f"(({b} - {both}) / greatest({n} - {a}, 1.0::DOUBLE))"
    return (f"CASE WHEN {x} > {y} THEN 2 * ({part(both, a, x)} + {part(f'({b} - {both})', f'({n} - {a})', y)}"
            f" - {part(both, a, f'({b} / {n})')} - {part(f'({b} - {both})', f'({n} - {a})', f'({b} / {n})')}) ELSE 0 END")


STARTERS = f"""ts AS (SELECT f.type, f.n_both::BIGINT AS n_both, {ratio_score('f.n_both', 'e.n', '(c.n_stop + c.n_plain)::DOUBLE', 'tt.tokens')} AS score
    FROM tf f JOIN tc c USING (type), (SELECT sum(n_both) AS n FROM tf WHERE previous IS NULL) e, tt WHERE f.previous IS NULL)"""
ORACLES["abbreviations"] = f"WITH {tokens(' ORDER BY score DESC, type LIMIT 5000')} SELECT type, n_stop, n_plain, round(score, 6) AS score FROM ta WHERE score >= 0.3"
ORACLES["sentence_starters"] = f"WITH {tokens()}, {STARTERS} SELECT type, n_both, round(score, 6) AS score FROM ts WHERE score >= 30"
ORACLES["sentence_split_learned"] = rf"""WITH {tokens()}, {STARTERS},
  st AS (SELECT type FROM ts WHERE score >= 30),
  co AS (SELECT previous, type FROM (SELECT f.previous, f.type, {ratio_score('f.n_both', 'p.n', '(c.n_stop + c.n_plain)::DOUBLE', 'tt.tokens')} AS score
      FROM tf f JOIN (SELECT previous, sum(n_both) AS n FROM tf GROUP BY previous) p ON p.previous = f.previous JOIN tc c ON c.type = f.type, tt)
    WHERE score >= 7.88 AND type NOT IN (SELECT type FROM st)),
  pa AS (SELECT row_number() OVER () AS r, doc_id, {sents("translate(text, chr(1), ' ')")} AS s FROM documents),
  pb AS (SELECT r, doc_id, unnest(range(len(s))) AS i, unnest(s) AS part, unnest(list_concat(s[2:], [NULL])) AS following FROM pa),
  pc AS (SELECT *, regexp_extract(part, '[^ \n\t\r]+$') AS token, regexp_extract(following, '^[^ \n\t\r]+') AS after FROM pb),
  pd AS (SELECT *, {token_type('token')} AS before, {token_type('after')} AS next_type FROM pc),
  pe AS (SELECT *, regexp_matches(before, '^\p{{L}}$') OR before IN (SELECT type FROM tb) AS short FROM pd),
  pf AS (SELECT *, following IS NOT NULL AND {STOPS.format('token')} AND (short OR before = '#')
      AND (regexp_matches(after, '^[^\p{{L}}\p{{N}}]*\p{{Ll}}') OR (before, next_type) IN (SELECT (previous, type) FROM co)
        OR (short AND next_type NOT IN (SELECT type FROM st))) AS same FROM pe),
  pg AS (SELECT *, coalesce(sum((NOT same)::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM pf)
  SELECT doc_id, pos::INT AS pos, string_agg(part, ' ' ORDER BY i) AS sentence FROM pg GROUP BY r, doc_id, pos"""
ORACLES["content_words"] = f"""WITH s AS (SELECT doc_id, list_filter({words('lower(text)')}, lambda w: {content('w')}) AS s
    FROM documents)
  SELECT doc_id, (unnest(range(len(s))))::INT AS pos, unnest(s) AS word FROM s"""
ORACLES["truncate_tokens"] = f"""SELECT doc_id, len({words('text')}[1:128])::INT AS n_tokens,
  coalesce(array_to_string({words('text')}[1:128], ' '), '') AS tokens FROM documents"""

SECTION_ROW = f"""f AS (SELECT doc_id, section, w AS length, coalesce(w / nullif(s, 0)::DOUBLE, 0) AS avg_sentence_length,
    {fkgl('w', 's', 'y')} AS "FKGL", {fre('w', 's', 'y')} AS "FRE", avg_clauses, similarity AS sbert_sim, pdtb_coverage,
    {', '.join(f'{r}_ratio' for r in lexicon.ROLES)}, cwe, ppl
  FROM (SELECT doc_id, section, {n_words('text')} AS w, {n_sents('text')} AS s, {n_syllables('text')} AS y,
      {clauses('text')} AS avg_clauses, {coverage('text', has_part)} AS pdtb_coverage,
      {', '.join(f"{role_share('text', r)} AS {r}_ratio" for r in lexicon.ROLES)} FROM sections)
    JOIN bow USING (doc_id, section) JOIN lm USING (doc_id, section))"""
ORACLES["feature_table"] = f"""WITH {SECTIONS}, {bow('sections', 'doc_id, section', 'text')},
  {language('sections', 'sections', 'doc_id, section')}, {SECTION_ROW}
  SELECT a.doc_id, """ + ", ".join(
    {"length": f"{t}.length AS {s}_length", "ppl": f"round(ln({t}.ppl), 6) AS {s}_log_ppl"}.get(
        m, f'round({t}."{m}", 6) AS "{s}_{m}"')
    for t, s in (("a", "abstract"), ("b", "summary")) for m in MEASURES
) + """ FROM (SELECT * FROM f WHERE section = 'abstract') a JOIN (SELECT * FROM f WHERE section = 'summary') b USING (doc_id)"""

ORACLES["impute_mean"] = f"""WITH {GAPPY} SELECT doc_id,
  round(coalesce(summary_length, avg(summary_length) OVER ()), 6) AS summary_length,
  round(coalesce(summary_avg_sentence_length, avg(summary_avg_sentence_length) OVER ()), 6) AS summary_avg_sentence_length FROM gappy"""
DOC_MATRIX = f"""{bow('documents', 'doc_id', 'text')}, {language('documents', 'documents', 'doc_id')},
  m AS MATERIALIZED (SELECT doc_id, w::DOUBLE AS length, coalesce(w / nullif(s, 0)::DOUBLE, 0) AS avg_sentence_length,
    {fkgl('w', 's', 'y')} AS "FKGL", {fre('w', 's', 'y')} AS "FRE", avg_clauses, similarity AS sbert_sim, pdtb_coverage,
    {', '.join(f'{r}_ratio' for r in lexicon.ROLES)}, cwe, ppl
  FROM (SELECT doc_id, {n_words('text')} AS w, {n_sents('text')} AS s, {n_syllables('text')} AS y,
    {clauses('text')} AS avg_clauses, {coverage('text', has_part)} AS pdtb_coverage,
    {', '.join(f"{role_share('text', r)} AS {r}_ratio" for r in lexicon.ROLES)} FROM documents)
  JOIN bow USING (doc_id) JOIN lm USING (doc_id))"""
ORACLES["standardize"] = f"WITH {DOC_MATRIX} SELECT doc_id, " + ", ".join(
    f'round(("{c}" - avg("{c}") OVER ()) / coalesce(nullif(stddev_pop("{c}") OVER (), 0), 1), 6) AS "{c}"' for c in MATRIX) + " FROM m"
ORACLES["feature_correlation"] = f"WITH {DOC_MATRIX} " + " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, round(corr("{a}", "{b}"), 6) AS corr FROM m"""
    for i, a in enumerate(MATRIX) for b in MATRIX[i + 1:])
ORACLES["hash_split"] = f"SELECT doc_id, {HASH.format('doc_id')} AS hash, {is_test('doc_id', 0.3)} AS is_test FROM documents"
ORACLES["stratified_split_exact"] = f"""SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {HASH.format('doc_id')}, doc_id)
  <= round(0.3 * count(*) OVER (PARTITION BY quality)) AS is_test FROM labels"""
SUBSET = ("abstract_length", "abstract_avg_clauses", "summary_length", "summary_avg_clauses")
ORACLES["feature_subsets"] = f"WITH {GAPPY} " + " UNION ALL ".join(
    f"SELECT '{a},{b}' AS features, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n_complete FROM gappy"
    for i, a in enumerate(SUBSET) for b in SUBSET[i + 1:])
ORACLES["custom_scorer"] = f"WITH {SECTIONS} SELECT doc_id, section, {n_words('text')} AS length FROM sections"
