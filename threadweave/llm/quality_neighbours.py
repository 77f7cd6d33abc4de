"""Quality of posts by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadweave.llm.pretokens import slices
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

# Characters by kind: letters, capitals, digits; other marks stand for themselves.
_KINDS = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
    for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
SHAPE_LENGTH = 8  # of a word's shape; longer shapes are told apart by their first kinds
BLOCK_WEIGHTS = {b"w": 0.5, b"s": 1.0, b"p": 0.7, b"r": 1.0}
SLICE = 1 << 20


def text_terms(text: str) -> dict[bytes, float]:
    """Weighted terms of a whole text in four blocks of unit length times their weight.

    Words; word shapes (kinds of characters, runs shortened); pairs of neighbouring shapes; and the
    shares of words equal to the one before and of distinct words. Within a block a term weighs the
    square root of its share, so texts of any length compare.
    """
    raw = text.encode()
    words = raw.lower().split()
    if not words:
        return {}
    shapes = [s[:SHAPE_LENGTH] for s in _RUN.sub(rb"\1", raw.translate(_KINDS)).split()]
    total = len(words)
    terms: dict[bytes, float] = {}
    blocks = (
        (b"w", Counter(words), total), (b"s", Counter(shapes), total),
        (b"p", Counter(map(b" ".join, zip(shapes, shapes[1:]))), max(1, total - 1)),
        (b"r", {b"same": sum(map(eq, words, words[1:])), b"other": total}, 2 * total),
    )
    for block, counts, size in blocks:
        weight = BLOCK_WEIGHTS[block]
        for term, n in counts.items():
            terms[block + term] = weight * (n / size) ** 0.5
    return terms


@dataclass
class NeighbourModel:
    """Term places, their projection to latent dimensions, and the labelled vectors with labels."""

    places: dict[bytes, int]
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int
    sharpness: float

    def embed(self, texts: list[str]) -> np.ndarray:
        """Unit latent vectors; a text without known terms has the zero vector."""
        at: list[int] = []
        weights: list[float] = []
        sizes = np.zeros(len(texts), np.int64)
        place = self.places.get
        for row, text in enumerate(texts):
            before = len(at)
            for term, weight in text_terms(text).items():
                p = place(term)
                if p is not None:
                    at.append(p)
                    weights.append(weight)
            sizes[row] = len(at) - before
        out = np.zeros((len(texts), self.projection.shape[1]))
        rows = np.flatnonzero(sizes)
        if len(rows):
            starts = np.concatenate(([0], np.cumsum(sizes[rows])[:-1]))
            out[rows] = np.add.reduceat(self.projection[at] * np.array(weights)[:, None], starts, axis=0)
        return _unit(out)

    def balance(self) -> np.ndarray:
        """Weight of each labelled vector that lets both labels weigh the same in all."""
        share = self.labels.mean()
        return np.where(self.labels > 0, 0.5 / share, 0.5 / (1 - share)) if 0 < share < 1 else np.ones(len(self.labels))

    def scores(self, texts: list[str], block: int = 512) -> np.ndarray:
        """Label mean of the k most similar labelled vectors (ties included), weighted by similarity.

        The rarer label's votes weigh more, as far as it is rarer among all labelled vectors.
        """
        out = np.empty(len(texts))
        mean = float(self.labels.mean()) if len(self.labels) else 0.5
        vectors = self.embed(texts)
        k = min(self.k, len(self.labels))
        for low in range(0, len(texts), block):
            part = vectors[low: low + block]
            if not k:
                out[low: low + block] = mean
                continue
            cosines = np.clip(part @ self.vectors.T, 0.0, 1.0)
            nearest = np.partition(cosines, -k, axis=1)[:, -k][:, None]
            votes = np.where(cosines >= nearest, cosines, 0.0) ** self.sharpness * self.balance()
            total = votes.sum(axis=1)
            out[low: low + block] = np.where(total > 0, votes @ self.labels / np.where(total > 0, total, 1), mean)
        return np.clip(out, 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


class _SparseRows:
    """Weights of texts by terms, kept sparse; made dense a few rows at a time for products."""

    STEP = 256

    def __init__(self, texts: list[str], places: dict[bytes, int], idf: np.ndarray):
        self.shape = (len(texts), len(idf))
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low in range(0, len(texts), self.STEP):
            row, place, weight = [], [], []
            for r, text in enumerate(texts[low: low + self.STEP]):
                for term, w in text_terms(text).items():
                    p = places.get(term)
                    if p is not None:
                        row.append(r)
                        place.append(p)
                        weight.append(w * idf[p])
            self.parts.append((np.array(row, np.int16), np.array(place, np.int32), np.array(weight, np.float32)))

    def _dense(self) -> Iterator[np.ndarray]:
        for number, (row, place, weight) in enumerate(self.parts):
            rows = np.zeros((min(self.STEP, self.shape[0] - number * self.STEP), self.shape[1]), np.float32)
            rows[row, place] = weight
            yield rows

    def times(self, base: np.ndarray) -> np.ndarray:
        return np.concatenate([rows @ base for rows in self._dense()])

    def transposed_times_itself_times(self, base: np.ndarray) -> np.ndarray:
        out = np.zeros_like(base)
        for rows in self._dense():
            out += rows.T @ (rows @ base)
        return out


def fit_neighbours(
    texts: list[str], labels: list[int], dimensions: int = 64, vocabulary_size: int = 6000, k: int = 15,
    sharpness: float = 24.0, seed: int = 7,
) -> NeighbourModel:
    """Latent-semantic vectors of labelled texts: inverse document frequencies and a truncated
    singular value decomposition by randomised subspace iteration."""
    frequency: Counter = Counter()
    for text in texts:
        frequency.update(text_terms(text).keys())
    kept = sorted(frequency, key=lambda t: (-frequency[t], t))[:vocabulary_size]
    places = {term: p for p, term in enumerate(kept)}
    idf = np.array([np.log((1 + len(texts)) / (1 + frequency[t])) + 1 for t in kept])
    del frequency
    matrix = _SparseRows(texts, places, idf)
    rank = min(dimensions, *matrix.shape)
    if rank:
        base = np.random.default_rng(seed).standard_normal((len(kept), min(rank + 16, *matrix.shape))).astype(np.float32)
        for _ in range(4):
            base, _ = np.linalg.qr(matrix.transposed_times_itself_times(base))
        _, _, right = np.linalg.svd(matrix.times(base), full_matrices=False)
        projection = idf[:, None] * (base @ right[:rank].T).astype(np.float64)
    else:
        projection = np.zeros((len(kept), 1))
    model = NeighbourModel(places, projection, np.zeros((0, projection.shape[1])), np.array(labels, float), k, sharpness)
    step = 64
    model.vectors = np.concatenate(
        [model.embed(texts[low: low + step]) for low in range(0, len(texts), step)] or [model.vectors]
    )
    return model


def fit_post_quality(
    posts: DataFrame, labels: DataFrame, label_column: str = "quality", most_labelled: int = 4000,
    most_bytes: int = 32 << 20, id_column: str = "tweet_id", text_column: str = "text", **settings,
) -> NeighbourModel:
    """A model from labelled posts: at most ``most_labelled``, chosen by a hash of the id, of ``most_bytes`` of text in all.

    Rows whose label or id is null teach nothing, nor do texts of more than a sixteenth of ``most_bytes``. The choice is
    made on ids before texts are read; of rows that share an id and label the smallest text is taken, before anything
    reaches the driver, so both bounds hold whatever repeats. No labelled posts: a model without votes.
    """
    require_columns(posts, [id_column, text_column], "posts")
    require_columns(labels, [id_column, label_column], "labels")
    chosen = (
        labels.select(F.col(id_column).alias("post"), F.col(label_column).cast("int").alias("label"))
        .filter("post is not null and label is not null").distinct()
        .orderBy(F.xxhash64("post"), "post", "label").limit(most_labelled)
    )
    texts = posts.select(F.col(id_column).alias("post"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    texts = texts.filter(F.octet_length("text") <= most_bytes // 16)
    # The broadcast side has at most most_labelled narrow rows; so has the window.
    found = cut_lineage(texts.join(F.broadcast(chosen), "post").groupBy("post", "label").agg(F.min("text").alias("text")))
    so_far = F.sum(F.octet_length("text").cast("bigint")).over(Window.orderBy(F.xxhash64("post"), "post", "label"))
    within = found.select("post", "label", so_far.alias("bytes")).filter(F.col("bytes") <= most_bytes).select("post", "label")
    rows = found.join(F.broadcast(within), ["post", "label"], "left_semi").collect()
    rows.sort(key=lambda r: (str(r["post"]), r["label"]))
    taught, marks = [r["text"] for r in rows], [r["label"] for r in rows]
    del rows
    return fit_neighbours(taught, marks, **settings)


def score_post_neighbours(
    posts: DataFrame, model: NeighbourModel, score_column: str = "score", text_column: str = "text"
) -> DataFrame:
    """Posts with ``score_column``: the similarity-weighted vote of the nearest labelled posts, 0 to 1.

    Every whole text is projected to the model's latent space and compared with every labelled vector
    in blocks; the model goes out as one broadcast whose size the fit bounds. No shuffle. All columns
    and rows stay as they are, also null ids and repeated rows; a column named like the score is
    replaced. Null or empty text: no neighbour, the score is the labelled mean (0.5 without labels).
    """
    require_columns(posts, [text_column], "posts")
    shared = posts.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = shared.value
        for batch in batches:
            done = [fitted.scores([t or "" for t in part.to_pylist()]) for part in slices(batch, SLICE)]
            yield pa.array(np.concatenate(done) if done else np.zeros(0), pa.float64())

    return posts.withColumn(score_column, score(F.col(text_column).cast("string")))
