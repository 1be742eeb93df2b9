"""Data-quality checks in place of database constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit(name).alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n"
    )


def missing(child: DataFrame, parent: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """Rows of ``child`` whose key is absent from ``parent``; ``on`` maps child to parent columns."""
    p = parent.select(*[F.col(b).alias(a) for a, b in on.items()]).distinct()
    return child.join(p, list(on), "left_anti").groupBy(*on).agg(F.count("*").alias("n")).select(
        F.lit(name).alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in on]).alias("key"), "n"
    )


def violations(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """One row per broken rule; a rule is a predicate that must not be false."""
    items = ", ".join(f"IF(NOT coalesce({p}, true), '{n}', NULL)" for n, p in rules.items())
    return df.select(
        F.expr(f"explode(array_compact(array({items})))").alias("check"), F.col(key).cast("string").alias("key"),
        F.lit(1).cast("long").alias("n"),
    )


COORDS = "(x0 IS NULL) = (y0 IS NULL) AND (y0 IS NULL) = (x1 IS NULL) AND (x1 IS NULL) = (y1 IS NULL)"
EVIDENCE_RULES = {"coords_all_or_none": COORDS, "page_positive": "page_number > 0"}
RELATION_RULES = {"no_self_loop": "source_entity_id <> target_entity_id", "confidence_range": "confidence BETWEEN 0 AND 1"}
ENTITY_RULES = {"title_length": "length(title) BETWEEN 1 AND 256", "stable_id": "stable_id <> ''"}


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that changed or vanished between two runs of an immutable table."""
    cols = [c for c in before.columns if c not in keys]
    h = lambda df, n: df.select(*keys, F.xxhash64(*cols).alias(n))
    j = h(before, "_b").join(h(after, "_a"), keys, "left")
    return j.where("_a IS NULL OR _a <> _b").select(
        *keys, F.expr("IF(_a IS NULL, 'deleted', 'changed')").alias("change")
    )
