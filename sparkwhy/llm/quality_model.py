"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches
from .sampling import by_label, crc_modulo

_RUN = re.compile(r"(.)\1+")
_ECHO = "\0echo"
#: Stands for the row of a shape in several pieces.
_SEVERAL = 0xFFFF


def shape(word: str) -> str:
    """Character classes of a word, runs made one: letters X or x, digits 0, anything else itself."""
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1+", kinds)


def shape_pieces(word: str, length: int = 12) -> list[str]:
    """The whole shape of a word in pieces; few words have more than one."""
    whole = shape(word)
    return [whole[k : k + length] for k in range(0, len(whole), length)]


def index_vector(token: str, size: int, ones: int = 8) -> np.ndarray:
    """The sparse ternary vector of a token, from its hash alone."""
    out, seed = np.zeros(size, np.float32), 0
    while ones:
        h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"), seed)
        seed += 1
        if out[h % size] == 0:
            out[h % size] = 1 if h >> 63 else -1
            ones -= 1
    return out


class Vectors:
    """Word vectors: the index vectors of neighbours summed over a training text, unit length.

    Words that the training texts don't hold often enough have the vector of their shape
    alone; of a shape in several pieces, the mean of theirs. ``rows`` maps word to row; further words are looked up once and kept, up to
    a limit.
    """

    def __init__(self, texts: list[str], size: int = 96, vocabulary: int = 20_000, reach: int = 2):
        self.size = size
        split = [t.split() for t in texts]
        common = [w for w, n in Counter(w for t in split for w in t).most_common(vocabulary) if n > 1]
        known = set(common)
        long = {w for t in split for w in t if len(w) > 64} - known  # without white space, hardly any word is there twice
        shapes = [s for s, _ in Counter(s for w in (*common, *sorted(long)) for s in shape_pieces(w)).most_common(2000)]
        self.word_row = {w: k + 1 for k, w in enumerate(common)}
        self.shape_row = {s: k + 1 for k, s in enumerate([_ECHO, *shapes])}
        context = self._contexts(split, [index_vector(w, size) for w in common], reach)
        self.words = self._unit(context)
        self.shapes = self._unit(np.stack([np.zeros(size, np.float32), *[index_vector("\1" + s, size) for s in self.shape_row]]))
        self._seen: dict[str, int] = {}

    def _contexts(self, split: list[list[str]], own: list[np.ndarray], reach: int) -> np.ndarray:
        """Sum of the neighbours' index vectors for each word; row 0 stands for all others and stays 0."""
        places, signs = np.zeros((len(own) + 1, 8), np.int64), np.zeros((len(own) + 1, 8))
        for k, v in enumerate(own, 1):
            places[k] = np.flatnonzero(v)
            signs[k] = v[places[k]]
        gap = [0] * reach  # between two texts
        at = np.fromiter((r for words in split for r in (*map(self.word_row.get, words, repeat(0)), *gap)), np.int64)
        out = np.zeros(len(places) * self.size)
        for k in range(1, reach + 1):
            for word, neighbour in ((at[k:], at[:-k]), (at[:-k], at[k:])):
                for j in range(places.shape[1]):
                    out += np.bincount(word * self.size + places[neighbour, j], signs[neighbour, j], len(out))
        out = out.reshape(len(places), self.size)
        out[0] = 0
        return out

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def _row(self, word: str) -> int:
        pieces = shape_pieces(word)
        row = self.word_row.get(word, 0) << 16 | (self.shape_row.get(pieces[0], 0) if len(pieces) == 1 else _SEVERAL)
        if len(self._seen) > 150_000:
            self._seen.clear()
        self._seen[word] = row
        return row

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def pool(self, text: str | None) -> np.ndarray:
        """Mean word vector, mean shape vector, share of words equal to the one before, log length; zeros for no words."""
        words = text.split() if text else []
        out = np.zeros(2 * self.size + 2, np.float32)
        if not words:
            return out
        seen, row = self._seen, self._row
        at = np.fromiter((seen[w] if w in seen else row(w) for w in words), np.int64, len(words))
        n = len(words)
        for a in range(0, n, 20_000):  # bounds what is gathered of a very long text at once
            out[: self.size] += self.words[at[a : a + 20_000] >> 16].sum(0)
        shapes = at & 0xFFFF
        several = np.flatnonzero(shapes == _SEVERAL)
        shapes[several] = 0
        weights = np.bincount(shapes, minlength=len(self.shapes)).astype(np.float32)
        for word, times in Counter(words[k] for k in several.tolist()).items():
            pieces = shape_pieces(word)
            for piece, n_piece in Counter(pieces).items():
                weights[self.shape_row.get(piece, 0)] += times * n_piece / len(pieces)
        out[self.size : -2] = weights @ self.shapes
        out[:-2] /= n
        if n > 1:
            echo = sum(map(str.__eq__, words[1:], words[:-1])) / (n - 1)
            out[self.size : -2] += echo * self.shapes[1]
            out[-2] = echo
        out[-1] = np.log1p(n) / 10
        return out


class Network:
    """Two layers: tanh units, then one logit, divided by a temperature.

    A fifth of the rows, in a seeded order, is held back to choose the round and the temperature; of fewer than
    50 rows all are fitted and serve for that too.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 16, rounds: int = 400, seed: int = 9):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        x, y = x[order], y[order]
        split = len(y) - len(y) // 5 if len(y) >= 50 else len(y)
        self.mean = x[:split].mean(0)
        self.scale = x[:split].std(0) + 1e-3
        z = (x - self.mean) / self.scale
        fit, held = slice(0, split), slice(split if split < len(y) else 0, None)
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
        state = [(np.zeros_like(a), np.zeros_like(a)) for a in p]
        share = np.clip(y[fit].mean(), 0.02, 0.98)
        weight = np.where(y[fit] == 1, 0.5 / share, 0.5 / (1 - share)) / split
        best, saved = np.inf, [a.copy() for a in p]
        for step in range(1, rounds + 1):
            h = np.tanh(z[fit] @ p[0] + p[1])
            pull = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[fit]) * weight
            back = np.outer(pull, p[2]) * (1 - h * h)
            grads = [z[fit].T @ back + 1e-3 * p[0], back.sum(0), h.T @ pull + 1e-3 * p[2], pull.sum(keepdims=True)]
            for a, g, (m, v) in zip(p, grads, state, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                a -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            if step % 20 == 0:
                cost = _cost((np.tanh(z[held] @ p[0] + p[1]) @ p[2] + p[3]), y[held])
                if cost < best:
                    best, saved = cost, [a.copy() for a in p]
        self.w, self.b, self.v, self.c = saved
        logit = self.logits(x[held])
        self.temperature = float(min(np.geomspace(0.25, 8, 60), key=lambda t: _cost(logit / t, y[held])))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w + self.b) @ self.v + self.c

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _cost(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -logit, logit))))


class Model:
    """Vectors and network; without labels of both kinds, the share of label 1 as a constant score."""

    def __init__(self, texts: list[str], labels: list[int]):
        y = np.array(labels, np.int64)
        self.constant = float(y.mean()) if len(y) else 1.0
        self.network = None
        if 0 < self.constant < 1:
            self.vectors = Vectors(texts)
            self.network = Network(np.stack([self.vectors.pool(t) for t in texts]), y)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), self.constant)
        return self.network.scores(np.stack([self.vectors.pool(t) for t in texts]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, held: int = 1, most_rows: int = 4000, most_bytes: int = 12_000_000) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out fold of their ids.

    ``most_rows`` and ``most_bytes`` (expected, whole texts) bound what the driver collects;
    each label gives about as many rows as the other, or all it has. Labels other than 0
    and 1, null ids and null texts teach nothing; of several labels of a document the
    largest counts.
    """
    marked = pick(labels, id_col, label_col).where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_modulo(id_col, modulus) != held))
    marked = marked.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    texts = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sized = marked.join(texts.select("id", F.octet_length("text").alias("size")), "id")
    few, _ = by_label(sized, "label", "size", most_rows, most_bytes)
    chosen = few.select("id", "label").distinct().limit(most_rows)
    found = texts.join(F.broadcast(chosen), "id").select("id", "text", "label").collect()
    found = sorted({(r["id"], r["text"], r["label"]) for r in found})
    return Model([t for _, t, _ in found], [y for _, _, y in found])


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of every whole text: id, score (0 to 1), predicted (1 if score >= 0.5), one row per input row.

    A null text scores as an empty one, which the network scores like any other. Null ids
    stay null, repeated rows stay repeated, an empty table gives an empty result, other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.asarray(shared.value.score(batch.column(1).to_pylist()), np.float64)
            made = [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(made, ["id", "score", "predicted"])

    source = pick(docs, id_col, text_col).select(F.col(id_col).cast("long"), text_col)
    return source.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def keep_predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose predicted quality is 1, with all their columns and without a shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.asarray(shared.value.score(batch.column(at).to_pylist())) >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, held: int = 1) -> DataFrame:
    """Learn from labelled rows outside the held-out fold; score all rows and name the fold."""
    model = train(docs, labels, id_col, text_col, label_col, modulus, held)
    return score_quality(docs, model, id_col, text_col).withColumn("held_out", crc_modulo(id_col, modulus) == held)
