"""Quality rules: text statistics per document and cross-document line frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, row_hash, small_batches, stored, without
from .shingles import WordHashes, hash_words, windows

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_FEATURES = (
    "key binary, host binary, id long, row_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, line binary, line_words int"
)


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more."""
    found = windows(hashes, width)
    if len(found) < 2:
        return 0
    ordered = np.sort(found)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(np.isin(found, twice))
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_features(text: str | None, cache: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text has none of any."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(hash_words(words, cache))


def _normal(line: str) -> bytes:
    """A-Z lower-cased, white space runs one space, trimmed."""
    return b" ".join(line.encode("utf-8", "surrogatepass").lower().split())


def line_counts(text: str | None) -> dict[bytes, int]:
    """Words under each distinct normalised line."""
    found: dict[bytes, int] = {}
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        words = line.split()
        if words:
            line = b" ".join(words)
            found[line] = found.get(line, 0) + len(words)
    return found


def _digest(*parts: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b"\0".join(parts))


def _where(host: str | None) -> bytes:
    return b"\1" + host.encode("utf-8", "surrogatepass") if host is not None else b"\0"


def _keys(doc: int | None, text: str | None, host: str | None) -> tuple[bytes, bytes]:
    """Digests of the document and of its host; equal rows are one document."""
    where = _where(host)
    return _digest(str(doc).encode(), where, (text or "").encode("utf-8", "surrogatepass")), _digest(where)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with its statistics, then a row per distinct line of it."""
    cache = WordHashes()
    for batch in batches:
        rows: list[tuple] = []
        for doc, text, host, row_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, place = _keys(doc, text, host)
            found = text_features(text, cache)
            rows.append((key, place, doc, row_hash, *found, None, None))
            for line, words in line_counts(text).items():
                rows.append((key, place, None, None, found[0], None, None, None, None, _digest(_where(host), line), words))
        if rows:
            columns = zip(*rows, strict=True)
            kinds = [pa.binary()] * 2 + [pa.int64()] * 7 + [pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _NAMES)


_NAMES = [x.split()[0] for x in _FEATURES.split(", ")]


def _lines_above(rows: DataFrame, min_documents: int, max_share: float, min_own: float) -> tuple[DataFrame, DataFrame]:
    """(key, line, words) of documents with lines that may be above the limit, and the lines that are.

    A line's digest holds its host. Lines are first counted in one aggregate, combined before the shuffle;
    all that follows sees frequent lines alone.
    """
    lines = rows.where("line is not null")
    documents = rows.where("line is null").groupBy("key").agg(F.min("host").alias("host"))
    limit = F.greatest(F.lit(float(min_documents)), F.lit(max_share) * F.count("*")).alias("limit")
    hosts = stored(documents.groupBy("host").agg(limit), "hosts")  # so that Spark can split a large host in the join
    counted = lines.groupBy("line").agg(F.min("host").alias("host"), F.count("*").alias("found")).where(F.col("found") > min_documents)
    frequent = stored(counted.join(hosts, "host").where("found > limit").select("line", "limit"), "frequent-lines")
    held = lines.join(frequent, "line").groupBy("line", "key").agg(F.max("line_words").alias("words"), F.max("n_words").alias("n_words"), F.max("limit").alias("limit"))
    held = stored(held, "held-lines")  # equal rows are one document from here on
    often = stored(held.groupBy("line").agg(F.count("*").alias("found"), F.max("limit").alias("limit")).where("found > limit").select("line"), "often")
    inside = held.join(often, "line", "left_semi")
    own = inside.groupBy("key").agg(F.sum("words").alias("inside"), F.max("n_words").alias("n")).where(F.col("n") - F.col("inside") >= min_own * F.col("n")).select("key")
    above = inside.join(stored(own, "own"), "key", "left_semi").groupBy("line").agg(F.count("*").alias("found"), F.max("limit").alias("limit"))
    return held.select("key", "line", "words"), stored(above.where("found > limit").select("line"), "common-lines")


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, DataFrame]:
    small_batches(docs.sparkSession)
    source = pick(docs, id_col, text_col, host_col).select(F.col(id_col).cast("long"), text_col, host_col)
    return source, stored(source.withColumn("row_hash", row_hash(text_col, host_col)).mapInArrow(_features, _FEATURES), "rules")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_documents: int = 4,
    max_share: float = 0.05,
    min_own: float = 0.5,
    min_left: float = 0.2,
    with_hash: bool = False,
) -> DataFrame:
    """Statistics and verdict for each document.

    A line (A-Z lower-cased, runs of white space made one space, trimmed) is frequent if it occurs in more
    than ``min_documents`` documents of its host and in more than the share ``max_share`` of the host's
    documents. It is above the limit if that many documents hold it beside text of their own: at
    least the share ``min_own`` of their words in lines that are not frequent. So boilerplate is, and
    the text of a page that a host holds in many copies, exact or near, is not, as no copy has text of its own.
    Words of lines above the limit are removed; a document is depleted,
    and rejected, if less than the share ``min_left`` of its words stay. It is also
    rejected if ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` percent of them in repeated 5-word windows.

    Returns one row per input row: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_words_left, kept. A null or empty text has 0 of
    everything and fails the base rules; a null host is a host of its own; a null id
    stays null; repeated rows (equal id, text and host) are all returned, with equal values, and count as one
    document; an empty table gives an empty result. ``with_hash`` adds row_hash, a hash of text and host.
    """
    rows = _rows(docs, id_col, text_col, host_col)[1]
    held, above = _lines_above(rows, min_documents, max_share, min_own)
    removed = held.join(above, "line", "left_semi").groupBy("key").agg(F.sum("words").alias("removed"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        rows.where("line is null")
        .join(removed, "key", "left")
        .select(
            F.col("id").alias(id_col), *(["row_hash"] if with_hash else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"), left.alias("n_words_left"),
            (~failed & (left >= min_left * F.col("n_words"))).alias("kept"),
        )
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows that ``quality_rules`` keeps, whole and with all their columns; rows of one id, null or not, each by its own verdict."""
    judged = quality_rules(docs, id_col, text_col, host_col, **limits, with_hash=True)
    return without(docs, judged.where("not kept").select(F.col(id_col).alias("id"), "row_hash"), id_col, (text_col, host_col))


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_documents: int = 4, max_share: float = 0.05, min_own: float = 0.5) -> DataFrame:
    """Texts without their lines above the limit, as ``quality_rules`` sets it: id and text, one row per input row.

    Other lines stay as they are, joined by a line feed. A null text stays null, a text all of whose lines go is
    empty; nulls, repeated rows and an empty table are as there.
    """
    source, rows = _rows(docs, id_col, text_col, host_col)
    held, above = _lines_above(rows, min_documents, max_share, min_own)
    gone = held.join(above, "line", "left_semi").groupBy("key").agg(F.collect_list("line").alias("lines"))  # at most the lines of a document

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_keys(*row)[0] for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *batch.columns], ["key", "id", "text", "host"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, host, lines in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if lines:
                    lines, where = set(lines), _where(host)
                    text = "\n".join(x for x in text.split("\n") if not _normal(x) or _digest(where, _normal(x)) not in lines)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    wide = source.mapInArrow(keyed, "key binary, id long, text string, host string").join(gone, "key", "left")
    return wide.select("id", "text", "host", "lines").mapInArrow(strip, "id long, text string").withColumnsRenamed({"id": id_col, "text": text_col})
