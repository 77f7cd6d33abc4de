"""Pattern sets as native columns.

A pattern set is an ordered list of ``(name, regex)``.  Every regex is a literal, so it is
compiled once per task, and every operator works on the *hit mask* (bit i set = pattern i
found): one pass over the text, after which all counting is integer work.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.operators.common import bind
from threadweave.session import import_on_workers

PatternSet = Sequence[tuple[str, str]]

# Unicode case folding, Unicode classes, and "\n" as the only line end.
DIALECT = "(?iUd)"
DIALECT_CASED = "(?Ud)"


# For the screen every character becomes an ASCII one of the same kind, so that ASCII classes and boundaries mean what the
# dialect's do. These are known to be letters, blanks or neither, and to equal no ASCII character in any case.
_LETTERS = "[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f\u4e00-\u9fa5]"
_BLANKS = "[\u000b\u0085\u00a0]"
_OTHERS = "[\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u20ac\ufffd]"
SCREEN = "_screen"


def _can_screen(pattern: str) -> bool:
    """Whether the pattern means the same to RE2 on ASCII text: no ends of line, no look-around."""
    if not pattern.isascii() or "$" in pattern or "(?" in pattern.replace("(?:", ""):
        return False
    try:
        pc.match_substring_regex(pa.array([""]), "(?i)" + pattern)
    except pa.ArrowInvalid:
        return False
    return True


def possible_hits(texts: pa.Array, patterns: Sequence[str]) -> pa.Array:
    """Bit i is unset only where pattern i is sure not to occur; a text with characters beyond the known ones keeps all."""
    texts = pc.fill_null(texts, "")
    for kind, ascii_one in ((_LETTERS, "_"), (_BLANKS, " "), (_OTHERS, "\x01")):
        texts = pc.replace_substring_regex(texts, kind, ascii_one)
    unknown = pc.match_substring_regex(texts, r"[^\x00-\x7f]")
    mask = pa.array([0], pa.int64()).take(pa.array([0] * len(texts), pa.int64()))
    for i, pattern in enumerate(patterns):
        hit = pc.or_(unknown, pc.match_substring_regex(texts, "(?i)" + pattern)) if _can_screen(pattern) else pa.scalar(True)
        mask = pc.bit_wise_or(mask, pc.if_else(hit, pa.scalar(1 << i, pa.int64()), pa.scalar(0, pa.int64())))
    return mask


def with_screen(df: DataFrame, text: str, patterns: Sequence[str], out: str = SCREEN) -> DataFrame:
    """Adds a mask of the patterns that may occur: linear-time matching on whole batches rules most of them out.

    The patterns themselves then run on what is left, so hits are exactly theirs.
    """
    import_on_workers(df.sparkSession)
    patterns = list(patterns)

    @F.arrow_udf("bigint")
    def screen(texts: pa.Array) -> pa.Array:
        return possible_hits(texts, patterns)

    return df.withColumn(out, screen(F.col(text)))


def found(
    c: Column | str, pattern: str, ignore_case: bool = True, screened: Sequence[str] = (), screen: str = SCREEN
) -> Column:
    """Does the pattern occur anywhere in the text? Null text counts as empty.

    ``screened`` are the patterns of a mask beside the text; where it rules this one out, the text is not read.
    """
    column = F.col(c) if isinstance(c, str) else c
    prefix = DIALECT if ignore_case else DIALECT_CASED
    exact = F.coalesce(column, F.lit("")).rlike(prefix + pattern)
    if pattern not in screened:
        return exact
    return (F.col(screen).bitwiseAND(F.lit(1 << list(screened).index(pattern))) != 0) & exact


def unclear_message(c: Column | str, screened: Sequence[str] = ()) -> Column:
    """F4. A whole-message courtesy, or a generic complaint that names no product."""
    return found(c, FV.UNCLEAR_WHOLE_MESSAGE, screened=screened) | (
        (found(c, FV.UNCLEAR_FIX_REQUEST, screened=screened) | found(c, FV.UNCLEAR_GENERIC_FAILURE, screened=screened))
        & ~found(c, FV.PRODUCT_WORD_GUARD)
    )


STRONG_SCREENED = [pattern for _, pattern in FV.STRONG_PATTERNS] + [FV.UNCLEAR_GENERIC_FAILURE]


def strong_hits(c: Column | str, screened: Sequence[str] = ()) -> list[tuple[str, Column]]:
    """F3. The thirteen strong label tests in taxonomy order."""
    hits = [(name, found(c, pattern, screened=screened)) for name, pattern in FV.STRONG_PATTERNS]
    return hits + [(FV.UNCLEAR, unclear_message(c, screened))]


def hits_of(c: Column | str, patterns: PatternSet, screened: Sequence[str] = ()) -> list[tuple[str, Column]]:
    return [(name, found(c, pattern, screened=screened)) for name, pattern in patterns]


def hit_mask(hits: Sequence[tuple[str, Column]]) -> Column:
    """Bit i is set when test i holds."""
    mask = F.lit(0)
    for i, (_, hit) in enumerate(hits):
        mask = mask + F.when(hit, F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def mask_has(mask: Column | str, names: Sequence[str], name: str) -> Column:
    mask = F.col(mask) if isinstance(mask, str) else mask
    return mask.bitwiseAND(F.lit(1 << list(names).index(name))) != 0


def mask_names(mask: Column | str, names: Sequence[str]) -> Column:
    """F1. The matched names in set order."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    return F.array_compact(
        F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)])
    )


def with_hits(df: DataFrame, text: str, patterns: PatternSet | None, mask: str = "hit_mask") -> DataFrame:
    """F1/F2. Add the hit mask of a pattern set; ``None`` means the strong label set."""
    screened = STRONG_SCREENED if patterns is None else [pattern for _, pattern in patterns]
    hits = strong_hits(text, screened) if patterns is None else hits_of(text, patterns, screened)
    return bind(with_screen(df, text, screened), **{mask: hit_mask(hits)}).drop(SCREEN)


def names_of(patterns: PatternSet | None) -> list[str]:
    return list(FV.TAXONOMY) if patterns is None else [n for n, _ in patterns]


def with_tags(df: DataFrame, text: str, patterns: PatternSet | None, tags: str = "tags") -> DataFrame:
    """F1. Add the array of matched names."""
    tagged = with_hits(df, text, patterns, "_hits")
    return tagged.withColumn(tags, mask_names("_hits", names_of(patterns))).drop("_hits")


def match_matrix(df: DataFrame, text: str, patterns: PatternSet | None) -> DataFrame:
    """F2. One boolean column per pattern, the match count, and the multi and vague flags."""
    names = names_of(patterns)
    mask = F.col("_hits")
    count = F.bit_count(mask)
    flags = [mask_has(mask, names, n).alias(n) for n in names]
    vague = (
        mask_has(mask, names, FV.UNCLEAR) & (count <= 1) if FV.UNCLEAR in names else F.lit(False)
    )
    return with_hits(df, text, patterns, "_hits").select(
        *df.columns, *flags, count.alias("n_matched"),
        (count >= 2).alias("is_multi"), vague.alias("is_vague"),
    )


def reply_cues(agent_text: Column | str) -> dict[str, Column]:
    """F10."""
    return {
        "has_dm": found(agent_text, FV.DM_CUE),
        "has_link": found(agent_text, FV.LINK_CUE),
        "has_question": found(agent_text, FV.QUESTION_CUE),
        "has_instruction": found(agent_text, FV.INSTRUCTION_CUE),
    }
