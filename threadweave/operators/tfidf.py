"""TF-IDF as tables: term counts, vocabulary, unit-length weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.functions.tokens import (
    char_grams, padded_words, tfidf_tokens, word_grams,
)
from threadweave.operators.common import bind
from threadweave.session import cut_lineage, import_on_workers

WORDS_HELD = 1 << 17  # words of the texts a task counts at a time, one text apart
GRAMS_HELD = 1 << 20  # character n-grams whose words a task remembers
BROADCAST_TERMS = 500_000
ANALYZERS = ("word", "char", "word+char")


def with_grams(df: DataFrame, text: str, analyzer: str = "word", out: str = "grams") -> DataFrame:
    """M1/M12/M13. The array of terms of every text.

    ``word``: words and word pairs; ``char``: character n-grams inside words;
    ``word+char``: both, told apart by a prefix.
    """
    if analyzer not in ANALYZERS:
        raise ValueError(f"analyzer must be one of {ANALYZERS}")
    body = F.coalesce(F.col(text), F.lit(""))
    if analyzer == "char":
        return df.withColumn(out, char_grams(body))
    words = bind(df, _tokens=tfidf_tokens(body))
    grams: Column = word_grams("_tokens")
    if analyzer == "word+char":
        grams = F.concat(
            F.transform(grams, lambda g: F.concat(F.lit("w:"), g)),
            F.transform(char_grams(body), lambda g: F.concat(F.lit("c:"), g)),
        )
    return words.withColumn(out, grams).drop("_tokens")


def _with_runs(rows: DataFrame, grams: str, out: str) -> DataFrame:
    """Rows with a term array replaced by its distinct terms and their numbers, counted inside each row: no shuffle."""
    kept = [c for c in rows.columns if c != grams]
    ordered = bind(rows.withColumnRenamed(grams, "_unsorted"), _terms=F.sort_array("_unsorted"))
    begins = F.expr("filter(sequence(1, size(_terms)), i -> i = 1 or _terms[i - 1] <> _terms[i - 2])")
    marked = bind(
        ordered.select(*kept, "_terms"),
        _begins=F.when(F.size("_terms") > 0, begins).otherwise(F.expr("cast(array() as array<int>)")),
    )
    runs = F.expr(
        "transform(_begins, (b, k) -> named_struct('term', _terms[b - 1],"
        " 'tf', cast(coalesce(get(_begins, k + 1), size(_terms) + 1) - b as bigint)))"
    )
    return marked.select(*kept, runs.alias(out))


def _sums(doc: np.ndarray, term: np.ndarray, n: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``doc, term`` and the sums of their ``n``."""
    code = doc * n_terms + term
    order = np.argsort(code, kind="stable")
    code = code[order]
    begins = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n[order], begins) if len(code) else np.zeros(0, np.int64)
    return (*np.divmod(code[begins], max(1, n_terms)), sums)


Counts = tuple[np.ndarray, pa.Array, np.ndarray]


def _word_counts(doc: np.ndarray, word: np.ndarray, words: pa.Array, max_n: int = FV.TFIDF_MAX_N) -> Iterator[Counts]:
    """``doc, term, tf`` of words and runs of up to ``max_n`` words."""
    terms, ids, at = words, word, np.arange(len(word))
    for n in range(1, max_n + 1):
        if n > 1:
            inside = at + n - 1 < len(doc)
            at, ids = at[inside], ids[inside]
            inside = doc[at] == doc[at + n - 1]
            at, ids = at[inside], ids[inside]
            pairs, ids = np.unique(ids * len(words) + word[at + n - 1], return_inverse=True)
            left, right = np.divmod(pairs, max(1, len(words)))
            terms = pc.binary_join_element_wise(terms.take(pa.array(left)), words.take(pa.array(right)), " ")
        of, term, sums = _sums(doc[at], ids, np.ones(len(ids), np.int64), len(terms))
        yield of, terms.take(pa.array(term)), sums


def grams_of_word(padded: str, low: int = FV.CHAR_NGRAM_RANGE[0], high: int = FV.CHAR_NGRAM_RANGE[1]) -> list[str]:
    """M12. Character n-grams of one padded word; one shorter than n yields itself once."""
    size = len(padded)
    return [padded[i: i + n] for n in range(low, max(low, min(high, size)) + 1) for i in range(max(size - n + 1, 1))]


class _CharCounts:
    """``doc, term, tf`` of the character n-grams of padded words; a task takes a word apart once while it remembers it."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.of_word: dict[str, np.ndarray] = {}

    def __call__(self, doc: np.ndarray, word: np.ndarray, words: pa.Array) -> Iterator[Counts]:
        if len(self.numbers) > GRAMS_HELD:
            self.forget()
        grams = []
        for w in words.to_pylist():
            known = self.of_word.get(w)
            if known is None:
                number = self.numbers.setdefault
                known = self.of_word[w] = np.array([number(g, len(self.numbers)) for g in grams_of_word(w)], np.int64)
            grams.append(known)
        doc, word, n = _sums(doc, word, np.ones(len(word), np.int64), len(words))
        if not len(doc):
            return
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        each = sizes[word]
        place = np.repeat((np.cumsum(sizes) - sizes)[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        used, gram = np.unique(np.concatenate(grams), return_inverse=True)
        doc, term, sums = _sums(np.repeat(doc, each), gram[place], np.repeat(n, each), len(used))
        names = list(self.numbers)
        yield doc, pa.array([names[k] for k in used], pa.string()).take(pa.array(term)), sums


def _counted(rows: DataFrame, key: str, words: str, counter: Callable[[], Callable[..., Iterator[Counts]]]) -> DataFrame:
    """``(key, term, tf)`` of rows with a word array, counted where the row is: no shuffle."""
    kind = rows.schema[key].dataType.simpleString()
    import_on_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            portion = np.cumsum(sizes) // WORDS_HELD
            ends = [*(np.flatnonzero(portion[1:] != portion[:-1]) + 1).tolist(), batch.num_rows]
            for low, high in zip([0, *ends], ends):
                part = batch.slice(low, high - low)
                coded = part.column(1).flatten().dictionary_encode()
                doc = np.repeat(np.arange(high - low), sizes[low:high])
                for of, term, tf in count(doc, coded.indices.to_numpy().astype(np.int64), coded.dictionary):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), term, pa.array(tf, pa.int64())], ["key", "term", "tf"])

    counted = rows.select(F.col(key).alias("key"), F.col(words)).mapInArrow(run, f"key {kind}, term string, tf bigint")
    return counted.select(F.col("key").alias(key), "term", "tf")


def _word_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    words = bind(df.select(key, text), _words=tfidf_tokens(F.coalesce(F.col(text), F.lit(""))))
    return _counted(words, key, "_words", lambda: _word_counts)


def _char_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    words = bind(df.select(key, text), _words=padded_words(F.coalesce(F.col(text), F.lit(""))))
    return _counted(words, key, "_words", _CharCounts)


def _one_row_a_key(df: DataFrame, key: str, text: str) -> DataFrame:
    """Character n-grams; the counts of rows that share a key are added up, and only they are shuffled."""
    shared = cut_lineage(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_key"))
    if shared.isEmpty():
        return _char_terms(df, key, text)
    same = df[key].eqNullSafe(shared["_key"])
    added = _char_terms(df.join(shared, same, "left_semi"), key, text).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return _char_terms(df.join(shared, same, "left_anti"), key, text).unionByName(added)


def term_frequencies(df: DataFrame, key: str, text: str, analyzer: str = "word") -> DataFrame:
    """``(key, term, tf)``; a key is one row, so its terms are counted where the text is read."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"analyzer must be one of {ANALYZERS}")
    if analyzer == "char":
        return _one_row_a_key(df.select(key, text), key, text)
    if analyzer == "word":
        return _word_terms(df, key, text)
    prefixed = lambda rows, prefix: rows.withColumn("term", F.concat(F.lit(prefix), "term"))
    return prefixed(_word_terms(df, key, text), "w:").unionByName(prefixed(_char_terms(df, key, text), "c:"))


def with_hashed_terms(df: DataFrame, text: str, out: str = "terms", words: str | None = None) -> DataFrame:
    """Adds the array of words and word pairs, repeats included, each named by its 64-bit hash; with ``words`` also
    that of the words themselves.

    For tables that only ever compare terms: no pair is put together as text, and counting, joining and
    storing work on numbers. Two of a million terms share a hash with a chance of some 1 in 40 million.
    """
    read = bind(df, _words=tfidf_tokens(F.coalesce(F.col(text), F.lit(""))))
    pairs = F.expr(
        "case when size(_words) > 1 then transform(sequence(1, size(_words) - 1), i -> xxhash64(_words[i - 1], _words[i]))"
        " else cast(array() as array<bigint>) end"
    )
    singles = F.transform("_words", lambda w: F.xxhash64(w))
    hashed = bind(read.select(*df.columns, "_words"), **{out: F.concat(singles, pairs)})
    return hashed.withColumnRenamed("_words", words) if words else hashed.drop("_words")


def with_hashed_runs(df: DataFrame, text: str, out: str = "runs") -> DataFrame:
    """Adds an array of ``(term, tf)`` of hashed terms."""
    return _with_runs(with_hashed_terms(df, text, "_terms"), "_terms", out)


def hashed_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf)`` of hashed terms."""
    return with_hashed_runs(df.select(key, text), text, "_runs").select(key, F.inline("_runs"))


def vocabulary(
    frequencies: DataFrame, n_documents: Column, min_df: int = FV.TFIDF_MIN_DF, documents: Column | None = None
) -> DataFrame:
    """M2. ``(term, df, idf)`` of the terms found in min_df documents or more.

    idf = ln((1 + n) / (1 + df)) + 1. A row is one document, unless ``documents`` adds up how many.
    """
    return (
        frequencies.groupBy("term").agg((F.count(F.lit(1)) if documents is None else documents).alias("df"))
        .filter(F.col("df") >= min_df)
        .withColumn("_n", n_documents)
        .select("term", "df", (F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    )


def _sent(vocab: DataFrame) -> DataFrame:
    """A vocabulary of checked size goes to the frequencies; a larger one meets them by a shuffle."""
    return F.broadcast(vocab) if vocab.count() <= BROADCAST_TERMS else vocab


def unit_weights(frequencies: DataFrame, vocab: DataFrame, key: str, *carried: str) -> DataFrame:
    """M1/M3. ``(key, term, w)``: tf * idf over in-vocabulary terms, scaled to length one.

    ``carried`` columns of the vocabulary come along.
    """
    raw = frequencies.join(_sent(vocab.select("term", "df", "idf", *carried)), "term").select(
        key, "term", "df", *carried, (F.col("tf") * F.col("idf")).alias("_raw")
    )
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "df", *carried, (F.col("_raw") / length).alias("w"))


class _Fitted(Sequence):
    """Vocabulary and weights, each worked out when it is first asked for."""

    def __init__(self, *parts: Callable[[], DataFrame]) -> None:
        self.parts = [cache(part) for part in parts]

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, k: int) -> DataFrame:
        return self.parts[k]()


def fit_tfidf(
    df: DataFrame, key: str, text: str, analyzer: str = "word", min_df: int = FV.TFIDF_MIN_DF
) -> Sequence[DataFrame]:
    """Vocabulary and weights of a document table."""
    from threadweave.operators.block_weights import text_weights  # which counts as the retrieval index does

    frequencies = term_frequencies(df, key, text, analyzer)
    n_documents = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    vocab = cache(lambda: cut_lineage(vocabulary(frequencies, n_documents, min_df)))
    if analyzer == "word":
        return _Fitted(vocab, lambda: text_weights(df, key, text, min_df))
    return _Fitted(vocab, lambda: unit_weights(frequencies, vocab(), key).drop("df"))
