"""Weak supervision over quality rules: vote or abstain, estimate accuracies, decide by posterior.

Main path: DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.operators.common import bind
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

SPACE = r"[\\x20\\x09-\\x0D]"
GOOD, BAD, ABSTAIN = 1, -1, 0

# Each rule reads counts of a post: SQL for "votes bad", SQL for "votes good"; else it abstains.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 20", "n_words >= 80"),
    "word_length": (
        "word_chars < 2.5 * n_words or word_chars > 13 * n_words",
        "word_chars between 3.2 * n_words and 9 * n_words",
    ),
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.01 * n_words"),
    "capitals": ("n_capital_runs > 0.3 * n_words", "n_capital_runs <= 0.02 * n_words"),
    "shouting": ("n_shouts > 0.1 * n_words", "n_shouts <= 0.01 * n_words"),
    "repetition": (
        "n_repeat_words > 0.4 * n_words or n_dup_lines > 0.5 * n_lines",
        "n_repeat_words <= 0.05 * n_words and n_dup_lines = 0",
    ),
    "sentences": ("n_stops < 0.01 * n_words", "n_stops >= 0.03 * n_words"),
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_capital_runs", "n_shouts", "n_stops",
)


def quality_counts(posts: DataFrame, text_column: str = "text") -> DataFrame:
    """Add the counts the rules read, each from the whole text, computed once per row.

    Words are runs of anything but the six ASCII white-space characters. ``n_repeat_words`` are the
    word positions inside a three-word window that occurs at least twice; windows are compared by a
    64-bit hash, and rows without an equal pair never sort theirs. No shuffle: every count is made
    inside the row. A null text has no words.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    out = bind(posts, _text=text)
    out = bind(
        out,
        _words=F.expr(f"array_remove(split(_text, '{SPACE}+'), '')"),
        _lines=F.expr(f"filter(split(_text, '\\n'), line -> line rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
        n_symbols=F.expr("cast(regexp_count(_text, '[#*$%&|<>]') as bigint)"),
        n_capital_runs=F.expr("cast(regexp_count(_text, '\\\\p{Lu}{2,}') as bigint)"),
        n_shouts=F.expr("cast(regexp_count(_text, '!!') as bigint)"),
        n_stops=F.expr(f"cast(regexp_count(_text, '[.!?;:,](?={SPACE}|$)') as bigint)"),
    )
    out = bind(
        out.drop("_text"),
        n_words=F.expr("cast(size(_words) as bigint)"),
        word_chars=F.expr("cast(length(array_join(_words, '')) as bigint)"),
        n_lines=F.expr("cast(size(_lines) as bigint)"),
        n_dup_lines=F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)"),
        _windows=F.expr(
            "case when size(_words) >= 3 then transform(sequence(0, size(_words) - 3),"
            " i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) else cast(array() as array<bigint>) end"
        ),
    ).drop("_words", "_lines")
    # Only rows with an equal pair of windows go on to sort them with their places.
    out = bind(
        out,
        _placed=F.expr(
            "case when size(array_distinct(_windows)) < size(_windows)"
            " then sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i)))"
            " else cast(array() as array<struct<h:bigint,i:int>>) end"
        ),
    ).drop("_windows")
    return bind(
        out,
        n_repeat_words=F.expr(
            "cast(size(array_distinct(flatten(transform("
            " filter(_placed, (p, k) -> p.h <=> get(_placed, k - 1).h or p.h <=> get(_placed, k + 1).h),"
            " p -> array(p.i, p.i + 1, p.i + 2))))) as bigint)"
        ),
    ).drop("_placed")


def rule_votes(rules: Mapping[str, tuple[str, str]] = RULES) -> Column:
    """The votes as one array: 1 good, -1 bad, 0 abstains, in the order of the rules."""
    return F.array(*[
        F.when(F.expr(bad), F.lit(BAD)).when(F.expr(good), F.lit(GOOD)).otherwise(F.lit(ABSTAIN))
        for bad, good in rules.values()
    ])


def fit_votes(
    patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, smoothing: float = 1.0
) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over counted vote patterns.

    Returns the share of good posts and, by rule, the probability of each vote among good and among
    bad posts. It starts from "bad if any rule says so". Smoothing keeps a vote nobody cast harmless,
    and a rule that would speak against its own vote is taken to say nothing.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    good = [0.02 if BAD in votes else 0.99 for votes, _ in patterns]
    share, tables = 0.5, []
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        mass_good = sum(g * n for g, (_, n) in zip(good, patterns))
        mass_bad = total - mass_good
        share = (mass_good + smoothing) / (total + 2 * smoothing)
        tables = []
        for rule in range(n_rules):
            table = {}
            for vote in (BAD, ABSTAIN, GOOD):
                of_good = sum(g * n for g, (v, n) in zip(good, patterns) if v[rule] == vote)
                of_all = sum(n for v, n in patterns if v[rule] == vote)
                table[vote] = (
                    (of_good + smoothing) / (mass_good + 3 * smoothing),
                    (of_all - of_good + smoothing) / (mass_bad + 3 * smoothing),
                )
            for vote, sign in ((BAD, -1), (GOOD, 1)):
                if sign * (table[vote][0] - table[vote][1]) < 0:  # no better than chance: says nothing
                    table[vote] = (1.0, 1.0)
            tables.append(table)
        good = [1 / (1 + math.exp(-_log_odds(share, tables, votes))) for votes, _ in patterns]
    return share, tables


def _log_odds(share: float, tables: list[dict[int, tuple[float, float]]], votes: tuple[int, ...]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, votes))
    return max(-50.0, min(50.0, odds))


def score_post_quality(
    posts: DataFrame, id_column: str = "tweet_id", text_column: str = "text",
    rules: Mapping[str, tuple[str, str]] = RULES, keep_from: float = 0.5,
) -> DataFrame:
    """One row per post: its counts, votes, posterior quality probability and verdict.

    Rules vote good or bad or abstain on the counts of ``quality_counts``. Expectation-maximisation
    over the votes of all posts estimates how often each rule votes how among good and bad posts; the
    posterior ``quality_probability`` then decides (``keep_from``). ``base_failed`` (under 50 words, or
    over half of them in repeated windows) always rejects, and such posts teach the estimate nothing.

    Columns: the id, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    votes, quality_probability, kept``. Other columns of ``posts`` are not read, whatever their names.
    Null or empty text: all counts 0, rejected. Null ids and repeated rows stay as they are, one row
    each; equal texts get equal results. An empty table gives an empty result.

    The counts are written once as narrow rows to the shared folder. Only the counted vote patterns
    (at most 3 to the power of the number of rules) reach the driver.
    """
    require_columns(posts, [id_column, text_column], "posts")
    narrow = posts.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_post"))
    counted = quality_counts(narrow, "_post").select("_id", *COUNTS)
    counted = cut_lineage(counted.withColumn("votes", rule_votes(rules)))
    rows = counted.filter(f"not ({BASE_FAILED})").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    share, tables = fit_votes(sorted((tuple(r["votes"]), r["n"]) for r in rows))
    if tables:
        odds = F.lit(math.log(share / (1 - share)))
        for k, table in enumerate(tables):
            vote = F.col("votes")[k]
            odds = odds + F.when(vote == GOOD, math.log(table[GOOD][0] / table[GOOD][1])).when(
                vote == BAD, math.log(table[BAD][0] / table[BAD][1])
            ).otherwise(math.log(table[ABSTAIN][0] / table[ABSTAIN][1]))
    else:
        odds = F.lit(0.0)
    return (
        counted.withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("quality_probability", 1 / (1 + F.exp(-odds)))
        .select(
            F.col("_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines",
            "n_repeat_words", "base_failed", "votes", "quality_probability",
            (~F.col("base_failed") & (F.col("quality_probability") >= keep_from)).alias("kept"),
        )
    )
