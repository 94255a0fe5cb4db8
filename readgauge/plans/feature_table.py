"""The fourteen text measures of paired texts in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, measures as ms, text as tx
from ..operators.language import CorpusModel
from ..operators.reshape import SECTIONS, stack_sections

ROW_MEASURES = (
    "length", "avg_sentence_length", "FKGL", "FRE", "avg_clauses", "sbert_sim", "pdtb_coverage",
    *(f"{r}_ratio" for r in lexicon.ROLES),
)
CORPUS_MEASURES = ("cwe", "ppl")
MEASURES = ROW_MEASURES + CORPUS_MEASURES


def row_measures(df: DataFrame, text: str, keep, prefix: str = "", cues=None, match: str = "substring",
                 tokens: str = "words", names=ROW_MEASURES) -> DataFrame:
    """Add the measures that need no other row. Sentences and counts are made once and used by all."""
    t = F.col(text)
    counted = df.select(
        *keep, tx.lower_sentences(t).alias("_sents"), tx.word_count(t, tokens).alias("_tokens"),
        tx.word_count(t).alias("_words"), tx.sentence_count(t).alias("_n"), tx.syllable_count(t).alias("_syllables"),
        ms.clause_markers(t).alias("_clauses"),
    ).withColumn("_roles", F.transform("_sents", lambda s: ms.cue_role(s, cues)))
    n, sents = F.col("_n"), F.col("_sents")
    columns = {
        "length": F.col("_tokens"),
        "avg_sentence_length": ms.ratio(F.col("_tokens"), n),
        "FKGL": ms.fkgl(F.col("_words"), n, F.col("_syllables")),
        "FRE": ms.fre(F.col("_words"), n, F.col("_syllables")),
        "avg_clauses": ms.ratio(F.col("_clauses"), n),
        "sbert_sim": ms.adjacent_bow_cosine(sents),
        "pdtb_coverage": ms.connective_coverage(sents, match),
        **{f"{r}_ratio": ms.role_ratio(F.col("_roles"), r) for r in lexicon.ROLES},
    }
    return counted.select(*keep, *[columns[c].alias(prefix + c) for c in names])


def _with_matches(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Left join in which a null id meets a null id."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys]
    return left.join(other, same, "left").drop(*[f"_right_{k}" for k in keys])


def _one_per_id(roles: DataFrame) -> DataFrame:
    """``roles`` as given; an id with several rows is an error, for it would multiply its texts."""
    names = [c for c in roles.columns if c != "doc_id"]
    single = roles.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in names], F.count("*").alias("_n"))
    bad = F.raise_error(F.concat(F.lit("several rows of roles for "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return single.filter(F.when(F.col("_n") > 1, bad.cast("boolean")).otherwise(F.lit(True))).drop("_n")


def feature_table(pairs: DataFrame, model: CorpusModel | None = None, cues=None, match: str = "substring",
                  tokens: str = "words", roles: DataFrame | None = None) -> DataFrame:
    """``doc_id`` and every measure of both texts, ``abstract_*`` and ``summary_*``.

    ``model`` gives surprisal and perplexity; without it the texts themselves are
    the training corpus. ``roles``, ``(doc_id, abstract_*_ratio, summary_*_ratio)``
    as from a trained classifier, takes the place of the cue-word roles.

    Row measures stay in the row of the pair. Only the corpus measures leave it;
    they come back by id and a hash of the texts, so rows that share an id keep
    their own values.
    """
    known = model is None
    if known:
        model = CorpusModel.fit(stack_sections(pairs), "text")
    keyed = pairs.withColumn("_v", F.xxhash64(*SECTIONS))
    texts = stack_sections(keyed, "doc_id", "_v")
    scores = model.score(texts, "text", ["doc_id", "_v", "section"], known=known)
    scored = scores.groupBy("doc_id", "_v").agg(*[
        F.max(F.when(F.col("section") == s, F.col(m))).alias(f"{s}_{m}") for s in SECTIONS for m in CORPUS_MEASURES
    ])
    names = ROW_MEASURES if roles is None else tuple(n for n in ROW_MEASURES if not n.endswith("_ratio"))
    table = keyed
    kept = ["doc_id", "_v"]
    for section, other in (SECTIONS, SECTIONS[::-1]):
        waiting = [other] if section == SECTIONS[0] else []
        table = row_measures(table, section, kept + waiting, f"{section}_", cues, match, tokens, names)
        kept += [f"{section}_{n}" for n in names]
    table = _with_matches(table, scored, ["doc_id", "_v"])
    if roles is not None:
        table = _with_matches(table, _one_per_id(roles), ["doc_id"])
    return table.select("doc_id", *[f"{s}_{m}" for s in SECTIONS for m in MEASURES])
