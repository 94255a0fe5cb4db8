"""Every operator as a query over the test tables: ``name -> callable(spark, sf_dir)``."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, measures as ms, text as tx
from ..operators import (
    attribution, boundaries, chains, coherence, joins, learn, metrics, profile, reshape, roles, scorers, stats, sweep, vectors,
    wordclasses,
)
from ..operators.language import CorpusModel
from ..operators.trigrams import KneserNey
from ..session import scratch_path
from ..sources import articles, companion, labelled, results, tables
from . import views
from .feature_table import CORPUS_MEASURES, MEASURES, feature_table, row_measures

# Cue words that occur in the invented prose of the test tables.
TEST_CUES = {
    "objective": ("for", "to"), "conclusions": ("that", "this"), "results": ("are", "was"), "methods": ("by", "with"),
}
# Function words by which the languages of the test tables can be told apart.
LANGUAGE_CUES = {
    "en": ("and", "of", "the"), "de": ("der", "die", "und"), "fr": ("et", "les", "qui"),
}
TURN_ROLES = ("assistant", "system", "user")
MATRIX = MEASURES
QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def logged(df: DataFrame, *columns: str) -> DataFrame:
    """Perplexities as rounded logarithms, ``…log_ppl``: six decimals of a number near 1e5 are beyond its precision."""
    return rounded(df.withColumns({c: F.log(c) for c in columns}), *columns).withColumnsRenamed(
        {c: c.removesuffix("ppl") + "log_ppl" for c in columns})


def basic(text) -> dict:
    return {
        "length": tx.word_count(text), "avg_sentence_length": ms.avg_sentence_length(text),
        "avg_clauses": ms.avg_clauses(text),
    }


def wide(spark, sf, nulls: bool = False) -> DataFrame:
    """Basic features of the pairs; with ``nulls``, those of an empty text are null."""
    df = reshape.per_section(views.pairs(spark, sf), basic)
    if nulls:
        empty = F.col("summary_length") == 0
        df = df.withColumns({
            c: F.when(~empty, F.col(c)) for c in ("summary_length", "summary_avg_sentence_length", "summary_avg_clauses")
        })
    return df


ROUND_WIDE = ("abstract_avg_sentence_length", "abstract_avg_clauses", "summary_avg_sentence_length", "summary_avg_clauses")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written once to shared storage, so that fits and transformations don't compute the texts again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_matrix(spark, sf) -> DataFrame:
    """All measures of the documents, nulls included: ``doc_id, lang`` and the columns of ``MATRIX``."""
    docs = views.documents_once(spark, sf, "doc_id", "lang", "text")
    scores = CorpusModel.fit(docs, "text").score(docs, "text", ["doc_id"], known=True)
    measured = row_measures(docs, "text", ["doc_id", "lang"], cues=TEST_CUES).join(scores, "doc_id", "left")
    return kept(measured.select("doc_id", "lang", *MATRIX), "doc-matrix")


def type_matrix(spark, sf) -> DataFrame:
    """All measures of both texts of every pair as ``doc_id, type, …``, numbered and split evenly by type."""
    long = reshape.long_features(feature_table(views.pairs(spark, sf), cues=TEST_CUES), list(MATRIX))
    numbered = reshape.label_from_map(long, {"abstract": 0, "summary": 1})
    named = kept(numbered.withColumn("text_id", F.concat_ws("/", "doc_id", "type")), "type-matrix")
    return kept(stats.stratified_test_flag(named, "text_id", "label", 0.3), "split-matrix")


def judged(spark, sf) -> DataFrame:
    """Documents with their language as label and the language guessed from cue words as prediction."""
    docs = views.documents(spark, sf)
    guess = ms.cue_role(F.lower("text"), LANGUAGE_CUES, default="es")
    return docs.select("doc_id", "source", F.col("lang").alias("label"), guess.alias("prediction"))


# --- sources and sinks


@query
def src_json_articles(spark, sf):
    path = scratch_path(spark, "articles")
    articles.write_articles(views.pairs(spark, sf), path)
    return articles.read_articles(spark, path)


@query
def src_json_array(spark, sf):
    pair = views.pairs(spark, sf)
    named = F.struct(
        F.col("doc_id").alias("id"), F.array("abstract", "summary").alias("abstract"), F.array("summary").alias("summary")
    )
    unnamed = F.struct(
        F.lit(None).cast("string").alias("id"), F.array("summary").alias("abstract"),
        F.lit(None).cast("array<string>").alias("summary"),
    )
    arrays = pair.select(F.col("doc_id").alias("file"), F.to_json(F.array(named, unnamed)).alias("json"))
    return articles.explode_articles(arrays, "json", "file")


@query
def src_csv_pairs(spark, sf):
    path = scratch_path(spark, "pairs-csv")
    pair = views.pairs(spark, sf).select(
        "doc_id", F.col("abstract").alias("abs_text"), F.nullif("summary", F.lit("")).alias("pls_text")
    )
    tables.write_csv(pair, path)
    return articles.read_pairs_csv(spark, path)


@query
def src_feature_csv(spark, sf):
    path = scratch_path(spark, "features-csv")
    features = rounded(wide(spark, sf, nulls=True), *ROUND_WIDE)
    tables.write_csv(features, path)
    return tables.read_feature_csv(spark, path, features.schema)


@query
def src_labelled_groups(spark, sf):
    path = scratch_path(spark, "groups")
    labelled.write_labelled_groups(
        views.pairs(spark, sf), path, "doc_id", [("QUESTION", "abstract"), ("ANSWER", "summary")]
    )
    return labelled.read_labelled_groups(spark, path)


def _labelled_lines(spark, sf) -> str:
    """Turns as lines; those of the system role lack their label and tab."""
    path = scratch_path(spark, "lines")
    flat = F.trim(F.regexp_replace("sentence", r"[\t\r\n]+", " "))
    line = F.when(F.col("label") == "system", flat).otherwise(F.concat("label", F.lit("\t"), flat))
    views.turns(spark, sf).select(line.alias("value")).write.text(path)
    return path


@query
def src_labelled_flat(spark, sf):
    return labelled.read_labelled_flat(spark, _labelled_lines(spark, sf))


@query
def src_labelled_rejects(spark, sf):
    return labelled.read_labelled_rejects(spark, _labelled_lines(spark, sf))


@query
def extract_after_marker(spark, sf):
    docs = views.documents(spark, sf)
    return docs.select("doc_id", companion.line_after_marker(F.col("text"), marker=", the", drop="and").alias("found"))


@query
def prep_min_length(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return companion.keep_longer_than(docs, "text", 100)


@query
def prep_dataset(spark, sf):
    docs = views.table(spark, sf, "documents")
    named = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("Paper_Journal"), F.col("lang").alias("Eureka_Text_Simplified"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".xml")).alias("Full_Paper_XML"),
    )
    # every document once more with a path that leads to no companion
    gaps = named.withColumn("Full_Paper_XML", F.concat(F.lit("missing/"), "Full_Paper_XML"))
    bodies = docs.select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file"),
        F.concat(F.lit("Abstract\n"), "text").alias("body"),
    )
    return companion.prepare_dataset(named.union(gaps), bodies)


@query
def sink_json_results(spark, sf):
    path = scratch_path(spark, "results")
    hit = F.count_if(F.col("label") == F.col("prediction"))
    per_source = judged(spark, sf).groupBy("source").agg(hit.alias("hit"), F.count("*").alias("n"))
    records = per_source.select(
        F.array("source").alias("feature_combination"),
        F.array(F.array("hit", F.col("n") - F.col("hit"))).alias("confusion_matrix"),
        (F.col("hit") / F.col("n")).alias("accuracy"), F.array(F.lit("hit"), F.lit("miss")).alias("class_labels"),
    )
    results.write_results(records, path)
    back = results.read_results(spark, path)
    return rounded(back.select(
        F.col("feature_combination")[0].alias("source"), F.col("confusion_matrix")[0][0].alias("hit"),
        F.col("confusion_matrix")[0][1].alias("miss"), "accuracy", F.array_join("class_labels", ",").alias("labels"),
    ), "accuracy")


# --- projections, filters, reshape


@query
def features_wide(spark, sf):
    return rounded(wide(spark, sf), *ROUND_WIDE)


@query
def reshape_fixed(spark, sf):
    def ratios(text):
        found = F.transform(tx.lower_sentences(text), lambda s: ms.cue_role(s, TEST_CUES))
        return {f"{r}_ratio": ms.role_ratio(found, r) for r in ("background", "objective")}

    both = reshape.per_section(views.pairs(spark, sf), ratios)
    features = ["background_ratio", "objective_ratio"]
    return rounded(reshape.long_features(both, features, rules=()), *features)


def _typed_wide(spark, sf) -> DataFrame:
    """Ids that name their corpus, so that all kinds of summaries occur."""
    corpus = F.when(F.endswith("doc_id", F.lit("-0")), "eLife-").when(F.endswith("doc_id", F.lit("-2")), "journal.p-")
    return wide(spark, sf).withColumn("doc_id", F.concat(F.coalesce(corpus, F.lit("x-")), "doc_id"))


@query
def reshape_flexible(spark, sf):
    return rounded(reshape.long_features(_typed_wide(spark, sf)), "avg_sentence_length", "avg_clauses")


@query
def schema_profile(spark, sf):
    return reshape.schema_profile(wide(spark, sf).drop("summary_avg_clauses").withColumn("note", F.lit("")))


@query
def select_by_target(spark, sf):
    chosen, found = reshape.select_by_target(wide(spark, sf), "summary")
    return rounded(chosen, *[c for c in found if c in ROUND_WIDE])


@query
def label_map(spark, sf):
    long = reshape.long_features(_typed_wide(spark, sf), ["length"])
    return reshape.label_from_map(long, {"abstract": 0, "summary-elife": 1, "summary-plos": 2}, on_unknown="drop")


@query
def label_map_complete(spark, sf):
    """Every kind of text has a number; one without would be an error."""
    long = reshape.long_features(_typed_wide(spark, sf), ["length"])
    return reshape.label_from_map(long, {"abstract": 0, "summary": 1, "summary-elife": 2, "summary-plos": 3})


@query
def complete_cases(spark, sf):
    return rounded(
        reshape.complete_cases(wide(spark, sf, nulls=True), ["summary_length", "abstract_length"]), *ROUND_WIDE
    )


# --- joins and set operations


@query
def merge_features(spark, sf):
    """Five feature tables, each of the pairs for which its feature tells something."""
    pair = views.pairs(spark, sf)
    question, answer = F.col("abstract"), F.col("summary")

    def part(measure, name, where):
        return reshape.per_section(pair.filter(where), lambda t: {name: F.round(measure(t), 6)})

    frames = [
        part(lambda t: tx.word_count(t).cast("double"), "length", answer != ""),
        part(lambda t: tx.sentence_count(t).cast("double"), "sentences", tx.sentence_count(question) > 1),
        part(ms.avg_sentence_length, "avg_sentence_length", tx.sentence_count(answer) > 1),
        part(ms.avg_clauses, "avg_clauses", ms.clause_markers(question) > 0),
        part(lambda t: ms.connective_coverage(tx.lower_sentences(t)), "pdtb_coverage", ms.clause_markers(answer) > 0),
    ]
    return joins.merge_features(frames)


@query
def lookup_companion(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", F.concat("doc_id", F.lit(".xml")).alias("path"))
    pages = views.table(spark, sf, "pages").select(F.concat("page_id", F.lit(".txt")).alias("file"), F.col("url").alias("body"))
    return companion.lookup_companion(docs, pages, "path").select("doc_id", "companion")


@query
def concat_corpora(spark, sf):
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    items = views.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("n_chars"))
    pages = views.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    return reshape.concat_tables([docs, items, pages])


# --- aggregations and quality statistics


@query
def duplicate_keys(spark, sf):
    return profile.duplicate_keys(views.table(spark, sf, "conversations"), "conv_id")


@query
def null_profile(spark, sf):
    return profile.null_profile(wide(spark, sf, nulls=True))


@query
def describe_features(spark, sf):
    columns = ["abstract_length", "abstract_avg_sentence_length", "summary_length", "summary_avg_sentence_length"]
    found = profile.describe(wide(spark, sf, nulls=True), columns)
    return rounded(found, "mean", "std", "min", "q25", "q50", "q75", "max")


@query
def class_distribution(spark, sf):
    return profile.class_distribution(reshape.long_features(_typed_wide(spark, sf), ["length"]))


@query
def role_ratios(spark, sf):
    found = roles.role_ratios(views.turns(spark, sf), "abstract_id", "label", TURN_ROLES)
    return rounded(found, *[f"{r}_ratio" for r in TURN_ROLES])


@query
def corpus_role_ratio(spark, sf):
    return rounded(roles.corpus_role_ratio(views.turns(spark, sf), "label", "user"), "ratio")


def _role_table(spark, sf) -> DataFrame:
    def ratios(text):
        found = F.transform(tx.lower_sentences(text), lambda s: ms.cue_role(s, TEST_CUES))
        return {f"{r}_ratio": ms.role_ratio(found, r) for r in lexicon.ROLES}

    return reshape.per_section(views.pairs(spark, sf), ratios)


@query
def mean_role_ratio(spark, sf):
    return rounded(roles.mean_role_ratio(_role_table(spark, sf), lexicon.ROLES), "mean_ratio")


@query
def mean_role_ratio_by_section(spark, sf):
    return rounded(roles.mean_role_ratio_by_section(_role_table(spark, sf), lexicon.ROLES), "mean_ratio")


def _section_lengths(spark, sf) -> DataFrame:
    return views.sections(spark, sf).select("section", tx.word_count(F.col("text")).alias("length"))


@query
def feature_histogram(spark, sf):
    return profile.feature_histogram(_section_lengths(spark, sf), "length", "section", 20)


@query
def feature_density(spark, sf):
    return rounded(profile.feature_density(_section_lengths(spark, sf), "length", "section", 20), "density")


@query
def feature_kde(spark, sf):
    return rounded(profile.feature_kde(_section_lengths(spark, sf), "length", "section", 50), "x", "density")


def _section_basics(spark, sf) -> DataFrame:
    sections = views.sections(spark, sf)
    return sections.select("section", *[c.alias(n) for n, c in basic(F.col("text")).items()])


BASICS = ("length", "avg_sentence_length", "avg_clauses")


@query
def density_curves(spark, sf):
    return rounded(profile.density_curves(_section_basics(spark, sf), BASICS, "section"), "x", "density")


@query
def histograms(spark, sf):
    return rounded(profile.histograms(_section_basics(spark, sf), BASICS, "section"), "density")


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(judged(spark, sf))


@query
def accuracy(spark, sf):
    return rounded(metrics.accuracy(judged(spark, sf)), "accuracy")


@query
def classification_report(spark, sf):
    return rounded(metrics.classification_report(judged(spark, sf)), "precision", "recall", "f1")


def _quality(spark, sf) -> DataFrame:
    return views.table(spark, sf, "labels").select("doc_id", "quality")


@query
def class_weights(spark, sf):
    return rounded(metrics.class_weights(_quality(spark, sf), "quality"), "weight")


@query
def label_encode(spark, sf):
    turns = views.turns(spark, sf).select("abstract_id", "pos", F.col("label").alias("role"))
    model = metrics.fit_label_encoder(turns, "role", "label")
    coded = model.transform(turns)
    return metrics.decode_labels(coded, "label", model.labels, "decoded")


# --- ordering


def _source_accuracy(spark, sf) -> DataFrame:
    return judged(spark, sf).groupBy("source").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")
    )


@query
def topk_results(spark, sf):
    return rounded(metrics.top_k(_source_accuracy(spark, sf), "accuracy", 5, "source"), "accuracy")


@query
def topk_longest(spark, sf):
    return metrics.top_k(views.table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 10, "doc_id")


@query
def bottomk_shortest(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "n_chars")
    return metrics.top_k(docs, "n_chars", 10, "doc_id", largest=False)


@query
def cumulative_ratio(spark, sf):
    """Share of each language in all characters, and the running share from the largest down."""
    shares = views.table(spark, sf, "documents").groupBy("lang").agg(F.sum("n_chars").alias("n"))
    total = views.table(spark, sf, "documents").agg(F.sum("n_chars").alias("n")).scalar()
    ordered = shares.select("lang", (F.col("n") / total).alias("ratio"), (-F.col("n")).alias("k"))
    return rounded(metrics.cumulative(ordered, "ratio", "k").drop("k"), "ratio", "cumulative")


# --- text measures


@query
def sentence_split(spark, sf):
    docs = views.documents(spark, sf)
    return docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


@query
def word_tokens(spark, sf):
    docs = views.documents(spark, sf)
    return docs.select("doc_id", F.posexplode(tx.words(F.col("text"))).alias("pos", "token"))


def _per_text(spark, sf, **columns) -> DataFrame:
    return views.sections(spark, sf).select("doc_id", "section", *[c.alias(n) for n, c in columns.items()])


def _per_document(spark, sf, lang=None, **columns) -> DataFrame:
    return views.documents(spark, sf, lang).select("doc_id", *[c.alias(n) for n, c in columns.items()])


@query
def text_length(spark, sf):
    return _per_text(
        spark, sf, length=tx.word_count(F.col("text")), length_punct=tx.word_count(F.col("text"), "words+punct")
    )


@query
def avg_sentence_length(spark, sf):
    return _per_text(spark, sf, avg_sentence_length=F.round(ms.avg_sentence_length(F.col("text")), 6))


@query
def syllables(spark, sf):
    return _per_document(spark, sf, n_syllables=tx.syllable_count(F.col("text")))


def _counts(text):
    return tx.word_count(text), tx.sentence_count(text), tx.syllable_count(text)


@query
def fkgl(spark, sf):
    return _per_document(spark, sf, fkgl=F.round(ms.fkgl(*_counts(F.col("text"))), 6))


@query
def fre(spark, sf):
    return _per_document(spark, sf, fre=F.round(ms.fre(*_counts(F.col("text"))), 6))


@query
def avg_clause_markers(spark, sf):
    return _per_document(spark, sf, avg_clauses=F.round(ms.avg_clauses(F.col("text")), 6))


@query
def connective_coverage_substring(spark, sf):
    found = ms.connective_coverage(tx.lower_sentences(F.col("text")), "substring")
    return _per_document(spark, sf, coverage=F.round(found, 6))


@query
def connective_coverage_word(spark, sf):
    return _per_document(spark, sf, coverage=F.round(ms.connective_coverage(tx.lower_sentences(F.col("text")), "word"), 6))


@query
def adjacent_cosine_vectors(spark, sf):
    vectors = views.table(spark, sf, "embeddings")
    return rounded(coherence.adjacent_cosine(vectors, "label", "vec_id", "embedding"), "adjacent_cosine")


@query
def adjacent_cosine_bow(spark, sf):
    return _per_document(spark, sf, similarity=F.round(ms.adjacent_bow_cosine(tx.lower_sentences(F.col("text"))), 6))


@query
def content_word_entropy(spark, sf):
    docs = views.documents(spark, sf).select("doc_id", "text")
    model = CorpusModel.fit(docs, "text", pairs=False)
    return rounded(model.score(docs, "text", ["doc_id"], ppl=False), "cwe")


@query
def bigram_perplexity(spark, sf):
    docs = views.documents_once(spark, sf, "doc_id", "text")
    model = CorpusModel.fit(docs, "text")
    return logged(model.score(docs, "text", ["doc_id"], cwe=False, known=True), "ppl")


@query
def bigram_perplexity_heldout(spark, sf):
    docs = views.documents(spark, sf).select("doc_id", "text")
    held_out = stats.in_test(F.col("doc_id"), 0.1)
    model = CorpusModel.fit(docs.filter(~held_out), "text")
    return logged(model.score(docs.filter(held_out), "text", ["doc_id"], cwe=False), "ppl")


@query
def kneser_ney_perplexity(spark, sf):
    docs = views.documents(spark, sf).select("doc_id", "text")
    return logged(KneserNey.fit(docs, "text", keys=["doc_id"]).score(docs, "text", ["doc_id"], known=True), "ppl")


@query
def kneser_ney_perplexity_heldout(spark, sf):
    docs = views.documents(spark, sf).select("doc_id", "text")
    held_out = stats.in_test(F.col("doc_id"), 0.1)
    model = KneserNey.fit(docs.filter(~held_out), "text")
    return logged(model.score(docs.filter(held_out), "text", ["doc_id"]), "ppl")


@query
def word_associations(spark, sf):
    return rounded(vectors.word_pairs(views.documents(spark, sf), "text"), "ppmi")


@query
def adjacent_cosine_learned(spark, sf):
    docs = views.documents(spark, sf).select("doc_id", "text")
    model = vectors.SentenceModel.fit(docs, "text")
    return rounded(model.neighbour_similarity(docs, "text", "doc_id"), "similarity")


@query
def abbreviations(spark, sf):
    rows = boundaries.token_rows(views.documents(spark, sf), "text")
    found = boundaries.abbreviation_scores(boundaries.type_counts(rows)).filter(F.col("score") >= boundaries.ABBREVIATION)
    return rounded(found, "score")


@query
def sentence_starters(spark, sf):
    docs = views.documents(spark, sf)
    counted, rows = boundaries.statistics(docs, "text")
    short = boundaries.Boundaries.fit(docs, "text", tables=(counted, rows)).abbreviations
    scores = boundaries.starter_scores(boundaries.follow_counts(rows, short), counted)
    return rounded(scores.filter(F.col("score") >= boundaries.STARTER), "score")


@query
def sentence_split_learned(spark, sf):
    docs = views.documents(spark, sf).select("doc_id", "text")
    return boundaries.split_rows(docs, "text", "doc_id", model=boundaries.Boundaries.fit(docs, "text"))


@query
def word_classes(spark, sf):
    return wordclasses.WordClasses.fit(views.documents(spark, sf), "text", "lang").table(spark)


@query
def content_words_learned(spark, sf):
    docs = views.documents(spark, sf).select("doc_id", "lang", "text")
    model = wordclasses.WordClasses.fit(docs, "text", "lang")
    found = model.content(tx.lower_words(F.col("text")), F.col("lang"))
    return docs.select("doc_id", F.posexplode(found).alias("pos", "word"))


@query
def content_words(spark, sf):
    found = ms.content_words(tx.lower_words(F.col("text")))
    return views.documents(spark, sf).select("doc_id", F.posexplode(found).alias("pos", "word"))


@query
def truncate_tokens(spark, sf):
    first = tx.truncated(tx.words(F.col("text")), 128)
    return _per_document(spark, sf, n_tokens=F.size(first), tokens=F.array_join(first, " "))


@query
def feature_table_pairs(spark, sf):
    table = feature_table(views.pairs(spark, sf), cues=TEST_CUES)
    plain = rounded(table, *[f"{s}_{m}" for s in reshape.SECTIONS for m in MEASURES if m not in ("length", "ppl")])
    return logged(plain, *[f"{s}_ppl" for s in reshape.SECTIONS])


QUERIES["feature_table"] = QUERIES.pop("feature_table_pairs")


# --- statistics and learning


@query
def impute_mean(spark, sf):
    columns = ["summary_length", "summary_avg_sentence_length"]
    gappy = wide(spark, sf, nulls=True).select("doc_id", *columns)
    return rounded(stats.impute_mean(gappy, columns), *columns)


@query
def standardize(spark, sf):
    data = doc_matrix(spark, sf).select("doc_id", *MATRIX)
    scaler = stats.Standardizer.fit(data, MATRIX)
    return rounded(scaler.transform(data), *MATRIX)


def _components(spark, sf):
    data = doc_matrix(spark, sf)
    return data, stats.PrincipalComponents.fit(data, MATRIX)


@query
def pca_scores(spark, sf):
    data, components = _components(spark, sf)
    return components.scores(data, "doc_id")


@query
def pca_loadings(spark, sf):
    return _components(spark, sf)[1].loadings_table(spark)


@query
def pca_variance(spark, sf):
    return _components(spark, sf)[1].variance_table(spark)


@query
def feature_correlation(spark, sf):
    return rounded(stats.correlation(doc_matrix(spark, sf), MATRIX), "corr")


@query
def hash_split(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", stats.hash_number(F.col("doc_id")).alias("hash"), stats.in_test(F.col("doc_id"), 0.3).alias("is_test")
    )


@query
def stratified_split_exact(spark, sf):
    return stats.stratified_test_flag(_quality(spark, sf), "doc_id", "quality", 0.3)


@query
def feature_subsets(spark, sf):
    columns = ["abstract_length", "abstract_avg_clauses", "summary_length", "summary_avg_clauses"]
    return learn.subset_coverage(wide(spark, sf, nulls=True), columns, 2)


CLASSES = ("abstract", "summary")


@contextmanager
def _cached(df: DataFrame):
    """Keep ``df`` while a model is fitted to it; later uses compute it again."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


@query
def logistic_single(spark, sf):
    with _cached(type_matrix(spark, sf)) as matrix:
        return learn.records_table(spark, [learn.logistic_record(matrix, MATRIX, CLASSES)])


@query
def forest_single(spark, sf):
    with _cached(type_matrix(spark, sf)) as matrix:
        return learn.records_table(spark, [learn.forest_record(matrix, MATRIX, CLASSES)])


def _fitted_forest(spark, sf):
    with _cached(type_matrix(spark, sf)) as matrix:
        train, test, _ = learn.train_test(matrix, MATRIX, "label", "is_test")
        return learn.fit_forest(train, "label"), test


@query
def feature_importances(spark, sf):
    model, _ = _fitted_forest(spark, sf)
    rows = list(zip(MATRIX, (float(x) for x in model.featureImportances.toArray())))
    return spark.createDataFrame(rows, "feature string, importance double")


@query
def attribution_mean_abs(spark, sf):
    model, test = _fitted_forest(spark, sf)
    return attribution.attribution_mean_abs(model, test, MATRIX)


@query
def subset_sweep_records(spark, sf):
    return sweep.logistic_sweep(type_matrix(spark, sf), MATRIX, 4, CLASSES)


@query
def subset_sweep(spark, sf):
    return metrics.top_k(subset_sweep_records(spark, sf), "accuracy", 5, "feature_combination")


@query
def forest_sweep(spark, sf):
    swept = sweep.forest_sweep(type_matrix(spark, sf), MATRIX, 4, CLASSES)
    return metrics.top_k(swept, "accuracy", 5, "feature_combination")


@query
def role_classifier(spark, sf):
    turns = views.turns(spark, sf)
    held_out = stats.in_test(F.concat_ws("/", "abstract_id", "pos"), 0.3)
    model = roles.fit_role_classifier(turns.filter(~held_out))
    predicted = roles.predict_roles(model, turns.filter(held_out))
    return metrics.classification_report(predicted, "label", "role")


@query
def role_chain(spark, sf):
    turns = views.turns(spark, sf)
    held_out = stats.in_test(F.col("abstract_id"), 0.3)
    model = chains.RoleChain.fit(turns.filter(~held_out), "abstract_id", "pos", "sentence", "label", passes=30)
    predicted = model.predict(turns.filter(held_out), "abstract_id", "pos", "sentence", "label")
    return metrics.classification_report(predicted, "label", "role")


@query
def feature_table_trained_roles(spark, sf):
    """Roles learned from sentences of the documents that cue words label, then read off the order of the pairs' sentences."""
    parts = views.documents(spark, sf).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    labelled_parts = parts.withColumn("label", ms.cue_role(F.lower("sentence"), TEST_CUES))
    model = chains.RoleChain.fit(labelled_parts, "doc_id", "pos", "sentence", "label", passes=30)
    pairs = views.pairs(spark, sf)
    return feature_table(pairs, roles=chains.section_role_ratios(pairs, model))


@query
def custom_scorer(spark, sf):
    scorers.register_scorer("n_words", lambda texts: texts.str.count(r"[^\W_]+"), "long")
    return views.sections(spark, sf).select("doc_id", "section", scorers.score("n_words", "text").alias("length"))
