"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches
from .sampling import by_label, crc_modulo

_U = np.uint32
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter; signs of numbers such as ``²`` or ``½`` are none."""
    return bool(text) and any(map(str.isalpha, text))


def _symbols(text: str) -> np.ndarray:
    """Lower-cased letters as code points; every run of anything else is one space."""
    data = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = data < 0x250
    data[low] = _TABLE[data[low]]
    space = data == 32
    return data[~(space & np.concatenate([[False], space[:-1]]))]


_TABLE = np.array([c if chr(c).isalpha() else 32 for c in range(0x250)], np.uint32)


def ngrams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of a whole text: the buckets met, and the square roots of their shares."""
    s = np.concatenate([[_U(32)], _symbols(text), [_U(32)]])
    one = s * _U(0x9E3779B1)
    two = (one[:-1] ^ (s[1:] * _U(0x85EBCA77) + _U(1))) * _U(0xC2B2AE3D)
    three = (two[:-1] ^ (s[2:] * _U(0x27D4EB2F) + _U(2))) * _U(0x165667B1)
    shift = _U(32 - buckets.bit_length() + 1)
    counts = np.bincount(np.concatenate([one >> shift, two >> shift, three >> shift]), minlength=buckets)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at] / counts.sum()).astype(np.float32)


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """A row of +1/-1 bits for each class.

    Up to five classes get the exhaustive code of 2^(classes-1) - 1 bits; more get, of 200
    seeded random codes of 8 bits for each doubling of classes, the one whose closest
    rows differ most.
    """
    if classes < 2:
        return np.ones((classes, 0), np.int8)
    if classes <= 5:
        columns = [c for c in product((1, -1), repeat=classes) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    rng, bits, best, gap = np.random.default_rng(seed), 8 * int(np.ceil(np.log2(classes))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.int8), (classes, bits))
        product_of = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(product_of, -bits)
        least = (bits - product_of.max()) // 2
        if least > gap and (np.abs(code.sum(0)) < classes).all():
            best, gap = code, least
    return best


class Model:
    """Binary n-gram classifiers, one per code bit, and how they are decoded."""

    def __init__(self, classes: list[str], buckets: int, code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray, sharp: float):
        self.classes, self.buckets, self.code, self.weights, self.bias, self.trust, self.sharp = classes, buckets, code, weights, bias, trust, sharp

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Logistic loss of each class's codeword, bits weighted by how far they can be trusted."""
        return np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether a second language is nearly as likely."""
        if not self.classes or not has_letter(text):
            return UNKNOWN, 0.0, True
        if len(self.classes) == 1:
            return self.classes[0], 1.0, False
        at, value = ngrams(text, self.buckets)
        loss = self.losses((value @ self.weights[at] + self.bias)[None])[0]
        p = np.exp(-self.sharp * (loss - loss.min()))
        p /= p.sum()
        best = int(np.argmax(p))
        second = float(np.partition(p, -2)[-2])
        return self.classes[best], float(p[best]), bool(p[best] < 2 * second)


def fit(texts: list[str], labels: list[str], buckets: int = 4096, rounds: int = 150, seed: int = 5) -> Model:
    """Logistic regressions for the bits of the codewords of the labels, on at least no rows.

    The last fifth of the rows, in a seeded order, is held back to weigh the bits by their errors and to set how
    sharply losses become probabilities; of fewer than 50 rows all are fitted and serve for that too. Texts that are
    null, empty or without a letter and null labels teach nothing; repeated rows count as often as they are there.
    With one label the model always gives it, with none it gives ``und``.
    """
    kept = [(t, y) for t, y in zip(texts, labels, strict=True) if y is not None and has_letter(t)]
    classes = sorted({y for _, y in kept})
    code = codewords(len(classes))
    if len(classes) < 2:
        return Model(classes, buckets, code, np.zeros((buckets, 0), np.float32), np.zeros(0), np.zeros(0), 1.0)
    order = np.random.default_rng(seed).permutation(len(kept))
    x = np.zeros((len(kept), buckets), np.float32)
    y = np.empty(len(kept), np.int64)
    for row, k in enumerate(order):
        at, value = ngrams(kept[k][0], buckets)
        x[row, at] = value
        y[row] = classes.index(kept[k][1])
    target = code[y].astype(np.float32)
    split = len(y) - len(y) // 5 if len(y) >= 50 else len(y)
    mean = x[:split].mean(0)
    w, b = np.zeros((buckets, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    first, second, m0, v0 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    share = np.bincount(y[:split], minlength=len(classes))
    even = (split / (len(classes) * np.maximum(share, 1)))[y[:split]].astype(np.float32)[:, None]
    for step in range(1, rounds + 1):
        margin = x[:split] @ w + (b - mean @ w)
        pull = -target[:split] * even / (1 + np.exp(np.clip(target[:split] * margin, -30, 30))) / split
        for value, grad, m, v in ((w, x[:split].T @ pull - np.outer(mean, pull.sum(0)) + 1e-5 * w, first, second), (b, pull.sum(0), m0, v0)):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            value -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    b = b - mean @ w
    held = slice(split if split < len(y) else 0, None)
    margins = x[held] @ w + b
    wrong = ((margins * target[held] <= 0).mean(0) * len(margins) + 0.5) / (len(margins) + 1)
    trust = np.maximum(np.log((1 - wrong) / wrong), 0.01)
    made = Model(classes, buckets, code, w, b, trust / trust.sum(), 1.0)
    loss = made.losses(margins)
    rows = np.arange(len(loss))
    cost = []
    for sharp in (grid := np.geomspace(0.3, 60, 30)):
        p = -sharp * loss
        p = p - np.log(np.exp(p - p.max(1, keepdims=True)).sum(1, keepdims=True)) - p.max(1, keepdims=True)
        cost.append(-np.maximum(p[rows, y[held]], -12).mean())
    made.sharp = float(grid[int(np.argmin(cost))])
    return made


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", most_rows: int = 3000, most_bytes: int = 24_000_000, id_col: str | None = None) -> Model:
    """Fit on a bounded sample of labelled rows, about equally many of each label.

    ``most_rows`` and ``most_bytes`` (expected, whole texts) bound what the driver collects.
    Rows are sampled by a hash of their content and of the column ``id_col``, with which copies
    of a text are in the sample or not each by itself. Rows without a label or text teach nothing.
    """
    rows = pick(labelled, text_col, label_col, *([id_col] if id_col else [])).where(F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    sample, _ = by_label(rows.withColumn("size", F.octet_length(text_col)), label_col, "size", most_rows, most_bytes)
    found = sorted((r[0], str(r[1])) for r in sample.select(text_col, label_col).collect())
    return fit([t for t, _ in found], [y for _, y in found])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: id, lang_pred, score (0 to 1), ambiguous, one row per input row.

    A null text, or one without a letter, is ``und`` with score 0 and ambiguous, as is any
    text if the model knows no language. Null ids stay null, repeated rows stay
    repeated, an empty table gives an empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "lang_pred", "score", "ambiguous"])

    source = pick(docs, id_col, text_col).select(F.col(id_col).cast("long"), text_col)
    return source.mapInArrow(run, "id long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", modulus: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows whose id is not in the held-out fold; predict all rows and name the fold."""
    model = train(docs.where(crc_modulo(id_col, modulus) != held), text_col, label_col, id_col=id_col)
    return identify(docs, model, id_col, text_col).withColumn("held_out", crc_modulo(id_col, modulus) == held)
