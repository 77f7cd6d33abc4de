"""Corpus profiles: word counts, theme counts, overlaps, examples.

Multi-label counting never explodes tags: rows are counted per hit mask first (at most
2^patterns groups, combined map-side), and every figure is read off that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.functions.normalize import length_between
from threadweave.functions.patterns import PatternSet, mask_has, mask_names, names_of, with_hits
from threadweave.functions.tokens import adjacent_pairs, word_tokens
from threadweave.operators.common import top_per_key


def term_counts(df: DataFrame, text: str, pairs: bool = False) -> DataFrame:
    """E11. Frequency of every word, or of every pair of neighbouring words."""
    tokens = word_tokens(F.coalesce(F.col(text), F.lit("")))
    base = df.select(tokens.alias("tokens"))
    terms = base.select(F.explode(adjacent_pairs("tokens") if pairs else F.col("tokens")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(df: DataFrame, text: str, pairs: bool = False, n: int = 40) -> DataFrame:
    """L7. The n most frequent terms; equal counts in term order."""
    return term_counts(df, text, pairs).orderBy(F.desc("n"), "term").limit(n)


def mask_counts(df: DataFrame, text: str, patterns: PatternSet | None) -> DataFrame:
    """How many rows carry each hit mask."""
    hits = with_hits(df.select(text), text, patterns, "hit_mask")
    return hits.groupBy("hit_mask").agg(F.count(F.lit(1)).alias("n"))


def _static(df: DataFrame, rows: Sequence[Column], name: str) -> DataFrame:
    """A literal list beside every row of a mask table."""
    return df.withColumn(name, F.explode(F.array(*rows)))


def theme_counts(
    df: DataFrame, text: str, patterns: PatternSet = tuple(FV.THEME_PATTERNS)
) -> DataFrame:
    """E12. Rows per theme (a row may count for several), rows without any, and shares.

    ``n_primary`` counts rows whose first matching theme it is.
    """
    names = names_of(patterns)
    total = F.sum("n")
    themes = []
    for i, name in enumerate(names):
        bit = F.col("hit_mask").bitwiseAND(F.lit(1 << i)) != 0
        first = F.col("hit_mask").bitwiseAND(F.lit((1 << (i + 1)) - 1)) == (1 << i)
        themes.append(
            F.struct(
                F.lit(name).alias("theme"),
                F.sum(F.when(bit, F.col("n")).otherwise(0)).alias("n"),
                F.sum(F.when(first, F.col("n")).otherwise(0)).alias("n_primary"),
            )
        )
    none = F.sum(F.when(F.col("hit_mask") == 0, F.col("n")).otherwise(0))
    themes.append(F.struct(F.lit("other").alias("theme"), none.alias("n"), none.alias("n_primary")))
    return (
        mask_counts(df, text, patterns)
        .agg(F.coalesce(total, F.lit(0)).alias("total"), F.array(*themes).alias("themes"))
        .select("total", F.explode("themes").alias("t"))
        .select(
            "t.theme", F.coalesce("t.n", F.lit(0)).alias("n"),
            F.coalesce("t.n_primary", F.lit(0)).alias("n_primary"),
            F.coalesce(F.try_divide(F.lit(100.0) * F.col("t.n"), F.col("total")), F.lit(0.0)).alias("pct"),
        )
    )


def match_count_summary(df: DataFrame, text: str, patterns: PatternSet | None) -> DataFrame:
    """E12/E16. Rows matching nothing, one pattern, and two or more."""
    hits = F.bit_count("hit_mask")

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    return mask_counts(df, text, patterns).agg(
        rows(F.lit(True)).alias("n_rows"), rows(hits == 0).alias("n_unmatched"),
        rows(hits == 1).alias("n_single"), rows(hits >= 2).alias("n_multi"),
    )


def response_pattern_counts(df: DataFrame, agent_text: str) -> DataFrame:
    """E13. Overlapping counts and shares of the agent-reply patterns."""
    patterns = [*FV.RESPONSE_PATTERNS, *FV.EXTRA_RESPONSE_PATTERNS]
    return theme_counts(df, agent_text, patterns).filter("theme <> 'other'").select(
        F.col("theme").alias("pattern"), "n", "pct"
    )


def pattern_overlap(df: DataFrame, text: str, patterns: PatternSet | None) -> DataFrame:
    """E14. For every two patterns the number of rows that match both, zeros included."""
    names = names_of(patterns)
    both = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit((1 << i) | (1 << j)).alias("bits"))
        for i, a in enumerate(names) for j, b in enumerate(names) if i < j
    ]
    # An all-zero mask row keeps the list complete when nothing matches at all.
    counts = mask_counts(df, text, patterns)
    none = counts.sparkSession.range(1).select(F.lit(0).alias("hit_mask"), F.lit(0).cast("bigint").alias("n"))
    paired = _static(counts.unionByName(none), both, "p")
    hit = F.col("hit_mask").bitwiseAND(F.col("p.bits")) == F.col("p.bits")
    return paired.groupBy(F.col("p.a").alias("pattern_a"), F.col("p.b").alias("pattern_b")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_both")
    )


def separation_samples(
    df: DataFrame, text: str, key: str, k: int = 5, low: int = 35, high: int = 200,
    patterns: PatternSet = tuple(FV.DISCOVERY_PATTERNS), pairs: Sequence[tuple[str, str]] = tuple(FV.NAMED_OVERLAPS),
    alone: Sequence[str] = tuple(FV.UNPAIRED_SAMPLES),
) -> DataFrame:
    """E15. First k rows in key order that match A and not B, within a length band."""
    names = names_of(patterns)
    tagged = with_hits(df.select(key, text), text, patterns, "hit_mask").filter(
        length_between(text, low, high)
    )
    wanted = [(f"{x} NOT {y}", x, y) for a, b in pairs for x, y in ((a, b), (b, a))]
    samples = [
        F.when(mask_has("hit_mask", names, x) & ~mask_has("hit_mask", names, y), F.lit(title))
        for title, x, y in wanted
    ] + [F.when(mask_has("hit_mask", names, x), F.lit(x)) for x in alone]
    rows = tagged.withColumn("sample", F.explode(F.array_compact(F.array(*samples))))
    return top_per_key(rows, ["sample"], [F.col(key)], k, "position").select("sample", "position", key, text)


def multi_match_examples(
    df: DataFrame, text: str, key: str, patterns: PatternSet | None, n: int = 10
) -> DataFrame:
    """E16. First n rows in key order with two or more matches, and what they matched."""
    return (
        with_hits(df.select(key, text), text, patterns, "hit_mask")
        .filter(F.bit_count("hit_mask") >= 2)
        .select(key, text, mask_names("hit_mask", names_of(patterns)).alias("tags"))
        .orderBy(key).limit(n)
    )


def representative_rows(
    df: DataFrame, text: str, key: str, k: int = 8, low: int = 40, high: int = 220,
    patterns: PatternSet = tuple(FV.THEME_PATTERNS),
) -> DataFrame:
    """L9. First k rows per theme inside the length band; a theme with none takes any rows.

    Rows in the band sort first, so the first k already tell whether the band is empty.
    """
    names = names_of(patterns)
    tags = mask_names("hit_mask", names)
    themed = with_hits(df.select(key, text), text, patterns, "hit_mask").select(
        key, text, length_between(text, low, high).alias("in_band"),
        F.explode(F.when(F.col("hit_mask") == 0, F.array(F.lit("other"))).otherwise(tags)).alias("theme"),
    )
    first = top_per_key(themed, ["theme"], [F.desc("in_band"), F.col(key)], k, "position")
    banded = first.groupBy("theme").agg(F.max("in_band").alias("any_in_band"))
    return (
        first.join(banded, "theme").filter(F.col("in_band") | ~F.col("any_in_band"))
        .select("theme", "position", key, text)
    )
