"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, stored
from .tokenizing import default_path, load

_GEAR = np.random.default_rng(1024).integers(0, 2**32, 256, dtype=np.uint32)
#: Between an ASCII character that is no white space and a space or line feed, a
#: pre-token always ends, whatever stands before or after.
_ANCHOR = re.compile(rb"(?<=[\x21-\x7e])[ \n]")
#: Of a chunk: what lies before its first anchor, the ids up to its last, what follows; and for checking joins, the
#: first and the last stretch between two anchors with the number of ids of each.
Encoded = tuple[bytes, np.ndarray, bytes, bytes, int, bytes, int] | None


def cut(raw: bytes, average: int = 512, least: int = 128, most: int = 4096) -> list[bytes]:
    """Chunks of UTF-8 bytes that end where a rolling hash of 16 bytes is 0 modulo ``average``.

    Equal stretches are cut alike wherever they stand. No chunk is shorter than
    ``least`` bytes, but for the last, or longer than ``most`` bytes and a character.
    """
    if len(raw) <= least:
        return [raw] if raw else []
    data = np.frombuffer(raw, np.uint8)
    rolled = _GEAR[data]
    for shift in (1, 2, 4, 8):  # after each, the hash spans twice as many bytes
        rolled[shift:] += rolled[:-shift] << np.uint32(shift)
    inside = (data & 0xC0) == 0x80
    ends = np.flatnonzero((rolled >> np.uint32(7)) % np.uint32(average) == 0) + 1
    out, at = [], 0
    for end in [*ends.tolist(), len(raw)]:
        while end - at > most:
            stop = at + most
            while stop < len(raw) and inside[stop]:
                stop += 1
            out.append(raw[at:stop])
            at = stop
        if end > at and (end == len(raw) or (end - at >= least and not inside[end])):
            out.append(raw[at:end])
            at = end
    return out


def _anchor_before(raw: bytes, end: int, start: int) -> int:
    """The last anchor before ``end``, or ``start``."""
    space = max(raw.rfind(b" ", start, end), raw.rfind(b"\n", start, end))
    while space > start:
        if 0x21 <= raw[space - 1] <= 0x7E:
            return space
        space = max(raw.rfind(b" ", start, space), raw.rfind(b"\n", start, space))
    return start


def encode_chunk(raw: bytes, encode: Callable[[str], np.ndarray]) -> Encoded:
    """A chunk's ids between its first and last anchor; None if it has no anchor."""
    found = _ANCHOR.search(raw)
    if found is None:
        return None
    start = found.start()
    stop = _anchor_before(raw, len(raw), start)
    if stop == start:
        return raw[:start], np.empty(0, np.uint32), raw[start:], b"", 0, b"", 0
    following = _ANCHOR.search(raw, start + 1, stop)
    first, last = raw[start : following.start() if following else stop], raw[_anchor_before(raw, stop, start) : stop]
    return raw[:start], encode(raw[start:stop].decode()), raw[stop:], first, len(encode(first.decode())), last, len(encode(last.decode()))


class ChunkEncoder:
    """Encodes texts from chunks, each distinct one once, and repairs the joins.

    Ids near a chunk's ends may differ from those in the whole text. So of each chunk
    only the ids between its first and last anchor are reused, and what lies between
    two chunks' anchors is encoded again, wider if a chunk has no anchor, together with the stretch
    before and the stretch after it. The join is repaired if both stretches get the ids there that the
    chunks have for them; if not, the whole text is encoded at once. (At an anchor a pre-token ends in the
    whole text and in the part alike, so they should always agree; ``disagreed`` counts when not.)
    """

    def __init__(self, path: str, shared: dict[bytes, Encoded] | None = None, memory: int = 24_000_000):
        self.encode = load(path).encode
        self.shared = shared or {}
        self.own: dict[bytes, Encoded] = {}
        self.memory, self.used, self.disagreed = memory, 0, 0

    def chunk(self, raw: bytes) -> Encoded:
        if raw in self.shared:
            return self.shared[raw]
        if raw in self.own:
            return self.own[raw]
        made = encode_chunk(raw, self.encode)
        size = 200 + 2 * len(raw) + (4 * len(made[1]) if made else 0)
        if self.used + size > self.memory:
            self.own.clear()
            self.used = 0
        self.own[raw] = made
        self.used += size
        return made

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        raw = text.encode("utf-8")
        parts, pending, last, n_last = [], b"", b"", 0
        for chunk in cut(raw):
            made = self.chunk(chunk)
            if made is None:
                pending += chunk
                continue
            head, ids, tail, first, n_first, own_last, own_n = made
            if not len(ids):  # one anchor alone: it stands in the join
                pending += chunk
                continue
            join = self.encode((last + pending + head + first).decode())
            if (n_last and not np.array_equal(join[:n_last], parts[-1][-n_last:])) or not np.array_equal(join[len(join) - n_first :], ids[:n_first]):
                self.disagreed += 1
                return self.encode(text)
            parts += (join[n_last : len(join) - n_first], ids)
            pending, last, n_last = tail, own_last, own_n
        join = self.encode((last + pending).decode())
        if n_last and not np.array_equal(join[:n_last], parts[-1][-n_last:]):
            self.disagreed += 1
            return self.encode(text)
        parts.append(join[n_last:])
        return np.concatenate(parts)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each distinct chunk of each document."""
    for batch in batches:
        found = [d for text in batch.column(0).to_pylist() if text for d in {xxhash.xxh3_128_digest(c) for c in cut(text.encode())}]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])


def shared_chunks(docs: DataFrame, text_col: str, path: str, most: int) -> dict[bytes, Encoded]:
    """The chunks found in most documents, encoded once on the cluster; at most ``most`` of them.

    Counts are over all documents. The limit bounds what is broadcast; chunks beyond
    it are encoded where they occur, with the same ids.
    """
    texts = pick(docs, text_col)
    counts = stored(texts.mapInArrow(_digests, "digest binary").groupBy("digest").agg(F.count("*").alias("docs")).where("docs > 1"), "chunk-counts")
    least, total = None, 0
    for docs_with, chunks in sorted(counts.groupBy("docs").count().collect(), reverse=True):
        total += chunks
        if total > most:
            break
        least = docs_with
    if least is None:
        return {}
    wanted = {bytes(r[0]) for r in counts.where(F.col("docs") >= least).select("digest").collect()}

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing = set(wanted)
        for batch in batches:
            found = {}
            for text in batch.column(0).to_pylist():
                for chunk in cut(text.encode()) if text and missing else ():
                    if (digest := xxhash.xxh3_128_digest(chunk)) in missing:
                        missing.discard(digest)
                        found[digest] = chunk
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in (found.keys(), found.values())], ["digest", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            made = [encode_chunk(c, load(path).encode) for c in chunks]
            columns = [[m and (m[k].tobytes() if k == 1 else m[k]) for m in made] for k in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((chunks, *columns), kinds, strict=True)], names)

    names = ["chunk", "head", "ids", "tail", "first", "n_first", "last", "n_last"]
    kinds = [pa.int32() if n.startswith("n_") else pa.binary() for n in names]
    unique = texts.mapInArrow(take, "digest binary, chunk binary").groupBy("digest").agg(F.min("chunk").alias("chunk")).select("chunk")
    rows = unique.mapInArrow(encode, ", ".join(f"{n} {'int' if n.startswith('n_') else 'binary'}" for n in names)).collect()
    return {
        bytes(c): None if h is None else (bytes(h), np.frombuffer(bytes(i), np.uint32), bytes(t), bytes(f), nf, bytes(e), ne)
        for c, h, i, t, f, nf, e, ne in rows
    }


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, most_shared: int = 16_384) -> DataFrame:
    """Ids of every whole text, and the text decoded from them again.

    Returns one row per input row: id, ids (binary, little-endian unsigned 32-bit
    integers) and decoded (string). A null text counts as empty: no ids, empty text.
    A null id stays null, repeated rows stay repeated, an empty table gives an empty
    result, other columns are ignored. ``most_shared`` bounds the dictionary of chunks
    that is broadcast, not what is encoded.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or default_path()
    load(path)  # refuses files that it can't read here rather than in the tasks
    shared = spark.sparkContext.broadcast(shared_chunks(docs, text_col, path, most_shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decode = ChunkEncoder(path, shared.value), load(path).decode
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [encoder(t) for t in part.column(1).to_pylist()]
                made = [part.column(0), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([decode(i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(made, ["id", "ids", "decoded"])

    source = pick(docs, id_col, text_col).select(F.col(id_col).cast("long"), text_col)
    return source.mapInArrow(run, "id long, ids binary, decoded string").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Text of each row's ids (binary, as ``bpe_encode`` returns them), one row per input row.

    Null ids give a null text, no ids an empty one. A null id of a row stays null, repeated rows stay
    repeated, an empty table gives an empty result, other columns are ignored; an id that the file lacks is an error.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(path).decode
        for batch in batches:
            texts = [None if i is None else decode(np.frombuffer(i, np.uint32)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    source = pick(encoded, id_col, ids_col).select(F.col(id_col).cast("long"), ids_col)
    return source.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
