"""Wide and long feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = ("abstract", "summary")


def stack_sections(pairs: DataFrame, *keep: str) -> DataFrame:
    """One row per text of a pairs frame: the kept columns, by default ``doc_id``, ``section`` and ``text``."""
    rows = [F.struct(F.lit(s).alias("section"), F.col(s).alias("text")) for s in SECTIONS]
    return pairs.select(*(keep or ("doc_id",)), F.inline(F.array(*rows)))


def per_section(pairs: DataFrame, measures) -> DataFrame:
    """Apply ``measures(text) -> {name: Column}`` to both texts: ``abstract_*``, ``summary_*``.

    Both texts of a pair are in its row, so nothing is shuffled or pivoted.
    """
    named = [
        column.alias(f"{section}_{name}")
        for section in SECTIONS
        for name, column in measures(F.col(section)).items()
    ]
    return pairs.select("doc_id", *named)


def paired_features(columns) -> list[str]:
    """Sorted features that exist for both sections. Only the leading prefix is cut off."""
    found = [{c[len(s) + 1:] for c in columns if c.startswith(s + "_")} for s in SECTIONS]
    return sorted(found[0] & found[1])


def unprefixed(columns) -> list[str]:
    return [c for c in columns if not c.startswith(tuple(s + "_" for s in SECTIONS))]


# How the kind of summary follows from the document id.
SUMMARY_TYPES = (("elife", "summary-elife"), ("journal", "summary-plos"))


def summary_type(doc_id: Column, rules=SUMMARY_TYPES) -> Column:
    """The type of the first rule whose text the lower-case id contains, else 'summary'."""
    lowered = F.lower(doc_id.cast("string"))
    kind = F.lit("summary")
    for part, name in reversed(list(rules)):
        kind = F.when(F.contains(lowered, F.lit(part)), F.lit(name)).otherwise(kind)
    return kind


def long_features(wide: DataFrame, features=None, rules=SUMMARY_TYPES) -> DataFrame:
    """Two rows per document, one per section: other columns, ``type``, then the features."""
    others = unprefixed(wide.columns)
    features = list(features) if features is not None else paired_features(wide.columns)
    kinds = {"abstract": F.lit("abstract"), "summary": summary_type(F.col("doc_id"), rules)}
    rows = [
        F.struct(kind.alias("type"), *[F.col(f"{section}_{f}").alias(f) for f in features])
        for section, kind in kinds.items()
    ]
    return wide.select(*others, F.inline(F.array(*rows)))


def select_by_target(df: DataFrame, target: str, key: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """The key and every column whose lower-case name contains ``target``.

    Without such a column the frame has only the key and no rows.
    """
    hits = [c for c in df.columns if target in c.lower() and c != key]
    chosen = df.select(key, *hits)
    return (chosen if hits else chosen.limit(0)), hits


def feature_names(df: DataFrame, not_features=("doc_id", "type", "label")) -> list[str]:
    return [c for c in df.columns if c not in not_features]


def concat_tables(frames) -> DataFrame:
    """All rows of all frames by column name; missing columns are null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def label_from_map(df: DataFrame, labels: dict[str, int], type_col: str = "type", out: str = "label",
                   on_unknown: str = "error") -> DataFrame:
    """Number the classes. An unknown class is an error, or with ``'drop'`` left out."""
    if on_unknown not in ("error", "drop"):
        raise ValueError(f"on_unknown must be 'error' or 'drop', not {on_unknown!r}")
    number = F.lit(None).cast("int")
    for name, value in labels.items():
        number = F.when(F.col(type_col) == name, F.lit(value)).otherwise(number)
    if on_unknown == "drop":
        return df.withColumn(out, number).filter(F.col(out).isNotNull())
    unknown = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col(type_col), F.lit("null"))))
    return df.withColumn(out, F.coalesce(number, unknown.cast("int")))


def complete_cases(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns))


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: its group, its feature, whether both sections have it, and the row count.

    Two columns never hold the same name, so this has as many rows as ``df`` has columns.
    """
    both = set(paired_features(df.columns))
    rows = []
    for c in df.columns:
        group = next((s for s in SECTIONS if c.startswith(s + "_")), "other")
        feature = c if group == "other" else c[len(group) + 1:]
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(group).alias("group"), F.lit(feature).alias("feature"),
            F.lit(group != "other" and feature in both).alias("in_both"),
        ))
    return df.agg(F.count("*").alias("n_rows")).select(F.inline(F.array(*rows)), "n_rows")
