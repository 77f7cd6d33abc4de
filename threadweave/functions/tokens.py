"""Tokens and n-grams as native array columns."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadweave import fixed_values as FV


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(c: Column | str) -> Column:
    """P12. Lower-case words without stop words and without words of one or two letters."""
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit(f"({FV.WORD_TOKEN})"), 1)
    stop = F.array(*[F.lit(w) for w in FV.STOPWORDS])
    # array_except would drop repeats, so the test is per word.
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def adjacent_pairs(tokens: Column | str) -> Column:
    """P13. ``["a","b","c"]`` to ``["a b","b c"]``; shorter arrays give none."""
    t = _col(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


HANGUL = ("\uac00", "\ud7a3")  # the composed syllables, which unfold by arithmetic


def _fold_table() -> tuple[str, str, str, str, list[str]]:
    """Characters by what is left of them without accents: one character, nothing, or several.

    Built from the Unicode data by the NFKD rule over all code points; nothing is typed in.
    """
    source, target, dropped, expanding, expanded = [], [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or HANGUL[0] <= ch <= HANGUL[1]:
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if base == ch:
            continue
        if len(base) == 1:
            source.append(ch)
            target.append(base)
        elif base:
            expanding.append(ch)
            expanded.append(base)
        else:
            dropped.append(ch)
    return "".join(source), "".join(target), "".join(dropped), "".join(expanding), expanded


_FOLD_FROM, _FOLD_TO, _FOLD_DROP, _EXPANDING, _EXPANDED = _fold_table()


def _class_of(characters: str) -> str:
    """A pattern for any of the characters, as ranges."""
    codes, ranges = sorted(map(ord, characters)), []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in [*ranges, [ord(HANGUL[0]), ord(HANGUL[1])]]) + "]"


# Most characters are ASCII: those need not be held against each of the ranges.
_EXPANDING_CLASS = r"(?=[^\x00-\x7f])" + _class_of(_EXPANDING)
_LEADS, _VOWELS, _TAILS = ("".join(map(chr, range(a, b))) for a, b in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))


def _expand(ch: Column) -> Column:
    """What an expanding character unfolds to."""
    at = F.call_function("locate", ch, F.lit(_EXPANDING))
    syllable = F.ascii(ch) - F.lit(ord(HANGUL[0]))
    jamo = F.concat(
        F.substring(F.lit(_LEADS), F.floor(syllable / 588).cast("int") + 1, F.lit(1)),
        F.substring(F.lit(_VOWELS), F.floor(syllable % 588 / 28).cast("int") + 1, F.lit(1)),
        F.when(syllable % 28 > 0, F.substring(F.lit(_TAILS), (syllable % 28).cast("int"), F.lit(1))).otherwise(F.lit("")),
    )
    return F.when(ch.between(*HANGUL), jamo).otherwise(F.element_at(F.lit(_EXPANDED), at))


def fold_accents(c: Column | str) -> Column:
    """M4. Accents off, by the NFKD rule for every character, in native functions.

    A character that folds to one is translated; ligatures, fractions, syllable blocks and others that
    unfold to several are cut out and replaced one by one; what lies between them stays in one piece. ASCII
    text skips both.
    """
    text = _col(c)
    single = F.translate(text, _FOLD_FROM + _FOLD_DROP, _FOLD_TO)
    plain = F.split(single, _EXPANDING_CLASS, -1)
    odd = F.transform(F.regexp_extract_all(single, F.lit(f"({_EXPANDING_CLASS})"), 1), _expand)
    joined = F.array_join(F.zip_with(plain, odd, lambda before, ch: F.concat(before, F.coalesce(ch, F.lit("")))), "")
    whole = F.when(single.rlike(_EXPANDING_CLASS), joined).otherwise(single)
    return F.when(text.rlike(r"[^\x00-\x7f]"), whole).otherwise(text)


def tfidf_tokens(c: Column | str) -> Column:
    """M1. Lower-cased, folded words of two or more word characters."""
    return F.regexp_extract_all(fold_accents(F.lower(_col(c))), F.lit(f"({FV.TFIDF_TOKEN})"), 1)


def word_grams(tokens: Column | str, max_n: int = FV.TFIDF_MAX_N) -> Column:
    """M1. All n-grams of the token array for n = 1 .. max_n."""
    t = _col(tokens)
    grams = t
    for n in range(2, max_n + 1):
        count = F.greatest(F.size(t) - (n - 1), F.lit(0))
        longer = F.slice(t, F.lit(1), count)
        for offset in range(1, n):
            longer = F.zip_with(
                longer, F.slice(t, F.lit(1 + offset), count), lambda a, b: F.concat_ws(" ", a, b)
            )
        grams = F.concat(grams, longer)
    return grams


def padded_words(c: Column | str) -> Column:
    """M12. The words of a text, lower-cased and folded, with one blank on either side."""
    words = F.filter(F.split(fold_accents(F.lower(_col(c))), r"(?U)\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def grams_of_padded_word(
    padded: Column | str, low: int = FV.CHAR_NGRAM_RANGE[0], high: int = FV.CHAR_NGRAM_RANGE[1]
) -> Column:
    """M12. Character n-grams of one padded word; one shorter than n yields itself once."""
    word = _col(padded)
    size = F.length(word)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), size))),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))),
                lambda i: F.substring(word, i, n),
            ),
        )
    )


def char_grams(c: Column | str, low: int = FV.CHAR_NGRAM_RANGE[0], high: int = FV.CHAR_NGRAM_RANGE[1]) -> Column:
    """M12. Character n-grams inside the word boundaries of a whole text."""
    return F.flatten(F.transform(padded_words(c), lambda w: grams_of_padded_word(w, low, high)))
