"""Sentence boundaries that know abbreviations, learned from an unlabelled corpus.

A token is a run without blanks. Its type is the lower-cased token without marks around it and without final full stops; types
of digits are all ``#``. Statistics over the whole corpus, after Kiss and Strunk:

* **Abbreviations.** A type is one if the full stop after it is more than chance would have it. With p the share of tokens
  with a final full stop, n occurrences with and m without one, the log-likelihood ratio of "always a full stop" (0.99) to p is
  multiplied by e^-letters, by 1 + full stops inside, and by letters^-m. From ``ABBREVIATION`` on it is an abbreviation.
* **Collocations.** A number, initial or abbreviation with a full stop, and the type after it, that stand together more often than
  chance by a log-likelihood ratio of ``COLLOCATION``, unless the second is a sentence starter: the full stop between them
  ends nothing.
* **Sentence starters.** Types that follow a sure sentence end more often than chance, by ``STARTER``.

A text is first cut after every run of ``.!?`` that blanks follow. A cut is taken back if the token before it ends with one full stop
and the next token begins with a lower-case letter and the token before is a number, initial or abbreviation; or if both are a
collocation; or if the token before is an initial or abbreviation and the next token is no sentence starter. Parts
joined again have one blank between them.

All entries of the three lists count. A list of at most ``LISTED`` entries becomes literals of the column that ``split`` gives, so texts are
split in their rows, without a shuffle; a longer one stays a table, never on the driver, and ``split_rows`` looks the cuts up by
joins. Both give the same sentences. A corpus without tokens gives empty lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import scratch_path

ABBREVIATION = 0.3
COLLOCATION = 7.88
STARTER = 30.0
LISTED = 5_000
NUMBER = "#"
CUT = "\x01"
INITIAL = r"^[\p{L}]$"


def type_of(token: Column) -> Column:
    """``…"Dr.`` becomes ``dr``, ``U.S.`` becomes ``u.s``, ``3.`` becomes ``#``; '' without a letter or digit."""
    core = F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    return F.when(core.rlike(r"^\p{N}[\p{N}.,]*$"), F.lit(NUMBER)).otherwise(core)


def has_stop(token: Column) -> Column:
    """Whether a token ends with exactly one full stop."""
    return token.rlike(r"[\p{L}\p{N}]\.$")


def _tokens(text: str) -> Column:
    return F.filter(F.split(F.col(text), f"[{tx.BLANKS}]+"), lambda t: t != "")


def token_rows(df: DataFrame, text: str) -> DataFrame:
    """One row per distinct token: ``type, stop, n``, so types are found once a token and not once an occurrence."""
    counted = df.select(F.explode(_tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counted.select(type_of(F.col("token")).alias("type"), has_stop(F.col("token")).alias("stop"), "n")


def end_rows(df: DataFrame, text: str) -> DataFrame:
    """One row per distinct token with the one before it, if that ends with ``.!?``: ``type, previous, previous_stop, n``."""
    listed = df.select(_tokens(text).alias("_t")).filter(F.size("_t") > 1)
    n = F.size("_t") - 1
    rows = listed.select(F.inline(F.arrays_zip(F.slice("_t", F.lit(1), n).alias("before"), F.slice("_t", F.lit(2), n).alias("token"))))
    # a look at the last character, which may be one of those that $ passes over, saves most tokens the pattern
    ends = rows.filter(F.substring("before", -1, 1).isin(*".!?\u0085\u2028\u2029")).groupBy("before", "token").agg(F.count("*").alias("n"))
    return ends.filter(F.col("before").rlike(r"[.!?]$")).select(
        type_of(F.col("token")).alias("type"), type_of(F.col("before")).alias("previous"), has_stop(F.col("before")).alias("previous_stop"), "n")


def _part(k: Column, n: Column, p: Column) -> Column:
    """``k ln p + (n - k) ln(1 - p)``, where 0 ln 0 is 0."""
    zero = F.lit(0.0)
    return F.when(k > 0, k * F.log(p)).otherwise(zero) + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(zero)


def likelihood_ratio(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Of "b is as likely after a as elsewhere", for ``both`` of ``a`` with b, ``b`` in all ``n``; 0 if b is less likely after a."""
    both, a, b, n = (c.cast("double") for c in (both, a, b, n))
    with_a, without = both / a, (b - both) / F.greatest(n - a, F.lit(1.0))
    ratio = 2 * (_part(both, a, with_a) + _part(b - both, n - a, without) - _part(both, a, b / n) - _part(b - both, n - a, b / n))
    return F.when(with_a > without, ratio).otherwise(F.lit(0.0))


def abbreviation_scores(counted: DataFrame) -> DataFrame:
    """``type, n_stop, n_plain, score`` of all types with a letter that a full stop follows; ``counted``: ``type, n_stop, n_plain``."""
    totals = counted.agg(F.coalesce(F.sum("n_stop"), F.lit(0)), F.coalesce(F.sum(F.col("n_stop") + F.col("n_plain")), F.lit(0))).first()
    share = F.lit(min(max(totals[0] / max(totals[1], 1), 1e-9), 1 - 1e-9))
    n, m = F.col("n_stop").cast("double"), F.col("n_plain").cast("double")
    stops = F.length("type") - F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    letters = (F.length("type") - stops).cast("double")
    chance = n * F.log(share) + m * F.log(1 - share)
    always = n * F.log(F.lit(0.99)) + m * F.log(F.lit(0.01))
    score = 2 * (always - chance) * F.exp(-letters) * (stops + 1) * F.pow(letters, -m)
    found = counted.filter((F.col("n_stop") > 0) & F.col("type").rlike(r"\p{L}"))
    return found.select("type", "n_stop", "n_plain", score.alias("score"))


@dataclass(frozen=True)
class Boundaries:
    """The fitted lists, best first; those too long for literals are tables: ``type`` or ``previous, type``."""

    abbreviations: tuple[str, ...] | DataFrame
    collocations: tuple[tuple[str, str], ...] | DataFrame
    starters: tuple[str, ...] | DataFrame

    @classmethod
    def fit(cls, df: DataFrame, text: str, listed: int = LISTED, tables: tuple[DataFrame, DataFrame] | None = None) -> Boundaries:
        """Two passes over the texts: types, then what follows full stops; ``tables``: as from ``statistics``, if made before.

        ``listed`` decides how a list is kept, not what is in it.
        """
        def best(scores: DataFrame, least: float, *names: str) -> tuple | DataFrame:
            found = scores.filter(F.col("score") >= least)
            rows = found.orderBy(F.desc("score"), *names).select(*names).limit(listed + 1).collect()
            if len(rows) > listed:
                return _written(found.select(*names), "listed")
            return tuple(tuple(r) if len(names) > 1 else r[0] for r in rows)

        counted, rows = tables or statistics(df, text)
        abbreviations = best(abbreviation_scores(counted), ABBREVIATION, "type")
        after = _written(follow_counts(rows, abbreviations), "after")
        starters = best(starter_scores(after, counted), STARTER, "type")
        scores = collocation_scores(after, counted)
        if isinstance(starters, DataFrame):
            scores = scores.join(starters, "type", "left_anti")
        elif starters:
            scores = scores.filter(~F.col("type").isin(*starters))
        return cls(abbreviations, best(scores, COLLOCATION, "previous", "type"), starters)

    @property
    def in_literals(self) -> bool:
        return not any(isinstance(x, DataFrame) for x in (self.abbreviations, self.collocations, self.starters))

    def split(self, text: Column) -> Column:
        """The sentences of a text as an array. Lists that are tables cannot be looked up in a column: ``split_rows`` joins them."""
        if not self.in_literals:
            raise ValueError("lists kept as tables: split with split_rows")
        parts = _parts(text)

        def joined(parts: Column) -> Column:
            def with_cut(part: Column, i: Column) -> Column:
                following = F.get(parts, i + 1)
                end = F.when(following.isNull(), F.lit("")).when(self._same_sentence(part, following), F.lit(" ")).otherwise(F.lit(CUT))
                return F.concat(part, end)
            return F.array_join(F.transform(parts, with_cut), "")

        whole = F.get(F.transform(F.array(parts), joined), F.lit(0))
        return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.split(whole, CUT))

    def _same_sentence(self, part: Column, following: Column) -> Column:
        """Whether a cut is taken back. Only parts that end with a full stop are looked into, and their last type is found once."""
        def known(before: Column) -> Column:
            short = before.isin(*self.abbreviations) | before.rlike(INITIAL) if self.abbreviations else before.rlike(INITIAL)
            return F.when(before == NUMBER, F.lit(1)).when(short, F.lit(2)).otherwise(F.lit(0))

        def joins(at: Column) -> Column:
            before, kind, after = at["before"], at["kind"], _first_token(following)
            next_type = type_of(after)
            lower = _small_letter(after)
            together = F.concat(before, F.lit(" "), next_type).isin(*[f"{a} {b}" for a, b in self.collocations]) if self.collocations else F.lit(False)
            starts = next_type.isin(*self.starters) if self.starters else F.lit(False)
            return (kind > 0) & (lower | together | ((kind == 2) & ~starts))

        kinds = F.transform(F.array(type_of(_last_token(part))), lambda t: F.struct(t.alias("before"), known(t).alias("kind")))
        # a full stop and what $ passes over after it are the last three characters at most
        return has_stop(F.substring(part, -3, 3)) & F.get(F.transform(kinds, joins), F.lit(0))


def _parts(text: Column) -> Column:
    """A text cut after every run of ``.!?`` that blanks follow."""
    return tx.sentences(F.translate(text, CUT, " "))


def _last_token(part: Column) -> Column:
    return F.regexp_extract(part, rf"(?<![^{tx.BLANKS}])[^{tx.BLANKS}]++$", 0)


def _first_token(part: Column) -> Column:
    return F.regexp_extract(part, rf"^[^{tx.BLANKS}]+", 0)


def _small_letter(token: Column) -> Column:
    return token.rlike(r"^[^\p{L}\p{N}]*\p{Ll}")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def statistics(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """``type_counts`` and ``end_rows`` of a corpus as tables, a pass over the texts each."""
    return _written(type_counts(token_rows(df, text)), "types"), _written(end_rows(df, text), "ends")


def type_counts(rows: DataFrame) -> DataFrame:
    """``type, n_stop, n_plain`` over token rows."""
    counted = rows.filter("type <> ''").groupBy("type")
    n = F.col("n")
    return counted.agg(F.sum(F.when(F.col("stop"), n).otherwise(0)).alias("n_stop"), F.sum(F.when(F.col("stop"), 0).otherwise(n)).alias("n_plain"))


def follow_counts(rows: DataFrame, abbreviations) -> DataFrame:
    """``previous, type, n_both`` from ``end_rows``: types right after a number, initial or abbreviation with a full stop; a null
    ``previous`` stands for all sure sentence ends.
    """
    previous = F.col("previous")
    short = previous.rlike(INITIAL) | (previous == NUMBER)
    after = rows.filter((F.col("type") != "") & (F.col("type") != NUMBER) & (previous != ""))
    after, listed = _looked_up(after, abbreviations, "previous")
    short = short | listed
    after = after.withColumn("_short", short).filter(~F.col("_short") | F.col("previous_stop"))
    return after.groupBy(F.when(F.col("_short"), previous).alias("previous"), "type").agg(F.sum("n").alias("n_both"))


def _looked_up(df: DataFrame, listed: tuple | DataFrame, *names: str) -> tuple[DataFrame, Column]:
    """``df`` and whether what stands under ``names`` is in a list: a condition on literals, or a joined column where the list is a table."""
    if isinstance(listed, DataFrame):
        found = f"_listed_{len(df.columns)}"
        return df.join(listed.toDF(*names).withColumn(found, F.lit(True)), [*names], "left"), F.col(found).isNotNull()
    if not listed:
        return df, F.lit(False)
    return df, (F.col(names[0]) if len(names) == 1 else F.concat_ws(" ", *names)).isin(*[x if len(names) == 1 else " ".join(x) for x in listed])


def _with_totals(found: DataFrame, counted: DataFrame) -> DataFrame:
    total = counted.agg(F.coalesce(F.sum(F.col("n_stop") + F.col("n_plain")), F.lit(0))).first()[0]
    each = counted.select("type", (F.col("n_stop") + F.col("n_plain")).alias("n_type"))
    return found.join(each, "type").withColumn("n", F.lit(max(total, 1)))


def collocation_scores(after: DataFrame, counted: DataFrame) -> DataFrame:
    """``previous, type, n_both, score`` of what follows a number, initial or abbreviation."""
    both = after.filter("previous IS NOT NULL")
    firsts = both.groupBy("previous").agg(F.sum("n_both").alias("n_previous"))
    found = _with_totals(both.join(firsts, "previous"), counted)
    score = likelihood_ratio(F.col("n_both"), F.col("n_previous"), F.col("n_type"), F.col("n"))
    return found.select("previous", "type", "n_both", score.alias("score"))


def starter_scores(after: DataFrame, counted: DataFrame) -> DataFrame:
    """``type, n_both, score`` of what follows sure sentence ends."""
    both = after.filter("previous IS NULL").select("type", "n_both")
    ends = both.agg(F.coalesce(F.sum("n_both"), F.lit(0))).first()[0]
    found = _with_totals(both, counted)
    score = likelihood_ratio(F.col("n_both"), F.lit(max(ends, 1)), F.col("n_type"), F.col("n"))
    return found.select("type", "n_both", score.alias("score"))


def split_rows(df: DataFrame, text: str, *keep: str, model: Boundaries) -> DataFrame:
    """The kept columns and one row per sentence: ``pos`` from 0 and ``sentence``."""
    if model.in_literals:
        return df.select(*keep, F.posexplode(model.split(F.col(text))).alias("pos", "sentence"))
    named = df.select(*[F.col(k).alias(f"_keep{i}") for i, k in enumerate(keep)], _parts(F.col(text)).alias("_parts"))
    # written, so that the numbers of the rows stay what they are
    rows = _written(named.withColumn("_row", F.monotonically_increasing_id()), "parts")
    parts, n = F.col("_parts"), F.size("_parts")
    joined = _joined_cuts(rows, model).groupBy("_row").agg(F.collect_list("_i").alias("_joined"))
    rows = rows.filter(n > 0).join(joined, "_row", "left")
    last = n - 1
    between = F.when(n > 1, F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    ends = F.array_except(between, F.coalesce("_joined", F.array().cast("array<int>")))
    begins = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1))
    sentences = F.zip_with(begins, F.concat(ends, F.array(last)), lambda a, b: F.array_join(F.slice(parts, a + 1, b - a + 1), " "))
    return rows.select(*[F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)], F.posexplode(sentences).alias("pos", "sentence"))


def _joined_cuts(rows: DataFrame, model: Boundaries) -> DataFrame:
    """``_row, _i``: the parts of ``rows(_row, _parts)`` whose sentence goes on in the next part. Only ends with a full stop move, as their types."""
    parts, n = F.col("_parts"), F.greatest(F.size("_parts") - 1, F.lit(0))
    pairs = F.zip_with(F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(2), n), lambda a, b: F.struct(
        F.substring(a, -3, 3).alias("end"), _last_token(a).alias("token"), _first_token(b).alias("after")))
    cuts = rows.select("_row", F.posexplode(pairs).alias("_i", "_x")).filter(has_stop(F.col("_x.end")))
    cuts = cuts.select("_row", "_i", type_of(F.col("_x.token")).alias("before"), type_of(F.col("_x.after")).alias("next"),
                       _small_letter(F.col("_x.after")).alias("lower"))
    cuts, short = _looked_up(cuts, model.abbreviations, "before")
    kind = F.when(F.col("before") == NUMBER, F.lit(1)).when(short | F.col("before").rlike(INITIAL), F.lit(2)).otherwise(F.lit(0))
    cuts = cuts.select("_row", "_i", "before", "next", "lower", kind.alias("kind")).filter("kind > 0")
    cuts, together = _looked_up(cuts, model.collocations, "before", "next")
    cuts, starts = _looked_up(cuts, model.starters, "next")
    return cuts.filter(F.col("lower") | together | ((F.col("kind") == 2) & ~starts)).select("_row", "_i")
