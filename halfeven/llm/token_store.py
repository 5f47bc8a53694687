"""Token ids in directly addressable codes.

The ids of a run of documents are cut into levels of a few bits: level 1 holds the lowest bits of every
id, level 2 the next bits of those ids that need them, and so on.  A continuation bitmap per level says
which ids go on, and a rank directory (ones before each block of 512 bits) says where.  Any id is read by
one access per level; no block is decoded.  Widths are chosen per segment for the least bits.

Files: a Parquet folder whose rows are segments, in order of doc_id.  `data` is one such code in bytes:
  b"DAC1", number of ids (u64), number of levels (u8), per level: width (u8), entries (u64);
  then per level: packed chunks, and for all but the last the bitmap and the directory (u64 each block).
All numbers are little-endian; bits are packed from the highest of each byte; parts are whole bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blank_before_space, encode_parts, forget_at_exit, scratch_path, slices, small_batches, table, tidy

MAGIC, BLOCK = b"DAC1", 512
#: Ids of a segment, about; a document is never cut.
SEGMENT = 1 << 20
#: Ids that are read at once, about.
RUN = 1 << 17
#: Parts of text that are encoded as one.
TOGETHER = 64
END = 0


def best_widths(ids: np.ndarray) -> list[int]:
    """Level widths with the fewest bits in all (chunks and continuation bits), by dynamic programming."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    if bits <= 20:
        larger = np.cumsum(np.bincount(ids, minlength=1 << bits)[::-1])[::-1]
        at_least = [len(ids)] + [int(larger[1 << b]) for b in range(1, bits)]  # ids that need more than b bits
    else:
        at_least = [len(ids)] + [int((ids >> np.uint32(b) > 0).sum()) for b in range(1, bits)]
    cost, choice = [0.0] * (bits + 1), [0] * (bits + 1)
    for b in range(bits - 1, -1, -1):
        options = [(at_least[b] * (w + (b + w < bits)) + cost[b + w] + 64 * (at_least[b] // BLOCK if b + w < bits else 0), w) for w in range(1, bits - b + 1)]
        cost[b], choice[b] = min(options)
    out, b = [], 0
    while b < bits:
        out.append(choice[b])
        b += choice[b]
    return out


def _pack(values: np.ndarray, width: int) -> bytes:
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint32)
    out = []
    for at in range(0, len(values), 1 << 18):  # a multiple of 8 values: parts meet at whole bytes
        v = values[at : at + (1 << 18)].astype(np.uint32)
        out.append(np.packbits(((v[:, None] >> shifts) & np.uint32(1)).astype(np.uint8)).tobytes())
    return b"".join(out)


def _unpack(data: np.ndarray, begin: int, end: int, width: int) -> np.ndarray:
    """The values at places begin to end, without reading others (but for 7 before them)."""
    first, parts = begin - begin % 8, []
    for at in range(first, end, 1 << 18):  # a multiple of 8 values: parts begin at whole bytes
        n = min(1 << 18, end - at)
        bits = np.unpackbits(data[at * width // 8 : (at * width + n * width + 7) // 8])[: n * width].reshape(n, width)
        acc = np.zeros(n, dtype=np.uint32)
        for k in range(width):
            acc = (acc << np.uint32(1)) | bits[:, k]
        parts.append(acc)
    return np.concatenate(parts)[begin - first :] if parts else np.zeros(0, dtype=np.uint32)


def dac_encode(ids: np.ndarray, widths: list[int] | None = None) -> bytes:
    """The code of an array of non-negative ids below 2^32."""
    left = np.asarray(ids, dtype=np.uint32)
    widths = widths or best_widths(left)
    head, body, entries = [], [], left
    for k, w in enumerate(widths):
        head.append(struct.pack("<BQ", w, len(entries)))
        body.append(_pack(entries & np.uint32((1 << w) - 1), w))
        rest = entries >> np.uint32(w)
        if k < len(widths) - 1:
            more = rest > 0
            padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, dtype=np.uint8)
            padded[: len(more)] = more
            ones = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
            body += [np.packbits(padded).tobytes(), (np.cumsum(ones, dtype=np.uint64) - ones).astype("<u8").tobytes()]
            entries = rest[more]
    return b"".join([MAGIC, struct.pack("<QB", len(left), len(widths)), *head, *body])


class Dac:
    """Reads a code: `dac[i]` is any id, `decode()` all of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 code")
        self.count, n = struct.unpack_from("<QB", data, 4)
        raw, at = np.frombuffer(data, dtype=np.uint8), 13 + 9 * n
        self.levels = []
        for k in range(n):
            w, entries = struct.unpack_from("<BQ", data, 13 + 9 * k)
            chunks = raw[at : (at := at + (entries * w + 7) // 8)]
            bitmap = directory = None
            if k < n - 1:
                blocks = -(-entries // BLOCK)
                bitmap = raw[at : (at := at + blocks * BLOCK // 8)]
                directory = raw[at : (at := at + 8 * blocks)].view("<u8") if at % 8 == 0 else np.frombuffer(raw[at : (at := at + 8 * blocks)].tobytes(), dtype="<u8")
            self.levels.append((w, entries, chunks, bitmap, directory))

    def __len__(self) -> int:
        return self.count

    @staticmethod
    def _ones(bitmap: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Continuation bits before place i: from the directory, and those of its block."""
        block = i // BLOCK
        if block == len(directory):
            block -= 1
        inside = int.from_bytes(bitmap[block * BLOCK // 8 : i // 8 + 1].tobytes(), "big")
        spare = 8 * (min(i // 8 + 1, len(bitmap)) - block * BLOCK // 8) - (i - block * BLOCK)
        return int(directory[block]) + (inside >> spare).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = shift = 0
        for w, _, chunks, bitmap, directory in self.levels:
            first, last = i * w // 8, (i * w + w + 7) // 8
            window = int.from_bytes(chunks[first:last].tobytes(), "big")
            value |= (window >> (8 * (last - first) - (i * w - 8 * first) - w) & (1 << w) - 1) << shift
            if bitmap is None or not bitmap[i // 8] >> (7 - i % 8) & 1:
                break
            i, shift = self._ones(bitmap, directory, i), shift + w
        return value

    def read(self, begin: int, end: int) -> np.ndarray:
        """The ids at places begin to end; the directories say where they go on in each level, so no other id is decoded."""
        out = np.zeros(end - begin, dtype=np.uint32)
        places, shift = None, 0
        for w, _, chunks, bitmap, directory in self.levels:
            if begin >= end:
                break
            values = _unpack(chunks, begin, end, w) << np.uint32(shift)
            if places is None:
                out |= values
            else:
                out[places] |= values
            shift += w
            if bitmap is not None:
                more = np.flatnonzero(np.unpackbits(bitmap[begin // 8 : (end + 7) // 8])[begin % 8 : begin % 8 + end - begin])
                places = more if places is None else places[more]
                begin = self._ones(bitmap, directory, begin)
                end = begin + len(more)
        return out

    def decode(self) -> np.ndarray:
        return self.read(0, self.count)


class _Encoder:
    """Ids of texts from the tokenizers library; equal parts of the texts given at once are encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)  # a character stands for a byte

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after another, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(lengths.sum())), lengths

    def parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each part, and how many each has.

        Some parts at a time are one text, whose ids are cut again by the tokens' widths in bytes.
        """
        sizes = pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        edges = np.append(np.arange(0, len(parts), TOGETHER), len(parts))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), parts.cast(pa.string())), " ")
        ids, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]

        def cut_again(got: np.ndarray, a: int, b: int) -> bool:
            """Whether the ids of parts a to b could be told apart; they are then put with the others."""
            after = np.cumsum(sizes[a:b])
            ends = np.cumsum(self.width[got])
            places = np.searchsorted(ends, after) + 1
            if places[-1] != len(got) or (ends[places - 1] != after).any():
                return False
            ids.append(got)
            lengths.append(np.diff(places, prepend=0))
            return True

        for at in range(0, len(joined), 64):
            texts = [f" {t}" for t in joined[at : at + 64].to_pylist()]
            clear = [blank_before_space(t + " ") is None for t in texts]
            if all(clear) and cut_again(self.each(texts)[0], edges[at], edges[at + len(texts)]):
                continue
            for k, text in enumerate(texts, at):  # blank parts, or parts that end in a blank
                if not clear[k - at] or not cut_again(self.each([text])[0], edges[k], edges[k + 1]):
                    got, n = self.each([f" {p}" for p in parts[edges[k] : edges[k + 1]].to_pylist()])
                    ids.append(got)
                    lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian u32."""
        return encode_parts(texts, self.parts, self.each)


_ENCODERS: dict[str, _Encoder] = {}


def _ids(path: str, texts: list[str]) -> list[bytes]:
    """Each text's ids; a worker, which is used again, builds its encoder once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path].encode(texts)


#: first_doc and last_doc (null: no id) let readers of one document skip files by their statistics.
SEGMENTS = "part int, seq int, first_token long, n_tokens long, first_doc long, last_doc long, doc_ids array<long>, lengths array<long>, data binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, segment: int = SEGMENT) -> None:
    """Encodes every text (null: empty), ends each document with id 0 and writes the ids in order of doc_id to `path`.

    Documents are dealt by ranges of doc_id and sorted (null ids first); rows with one id stay, one after another.  Special
    tokens that a text spells out take their own ids, as the library does.  A long text is one document of one segment; an
    empty table writes no segment; columns besides doc_id and text are ignored, whatever their names.
    """
    end = struct.pack("<I", END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, done = TaskContext.get().partitionId(), 0, 0
        doc_ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, done, doc_ids, held, size
            have = [d for d in doc_ids if d is not None]
            row = {"part": part, "seq": seq, "first_token": done, "n_tokens": size, "first_doc": min(have, default=None), "last_doc": max(have, default=None), "doc_ids": doc_ids, "lengths": [len(h) // 4 for h in held], "data": dac_encode(np.frombuffer(b"".join(held), dtype="<u4"))}
            seq, done, doc_ids, held, size = seq + 1, done + size, [], [], 0
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for a, b in slices(batch.column("text"), 24 << 20):
                ids = _ids(tokenizer_path, [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
                for doc, x in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), ids, strict=True):
                    doc_ids.append(doc)
                    held.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= segment:
                        yield flush()
        if doc_ids:
            yield flush()

    small_batches(docs.sparkSession, 32 << 20)
    read = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    read.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(tidy(run), SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32, one row per document."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # a row per written part: as many as the writing job had tasks
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, lengths, first, data in zip(*(batch.column(c) for c in ("doc_ids", "lengths", "first", "data")), strict=True):
                dac, crc = Dac(data.as_py()), []
                n = lengths.values.to_numpy().astype(np.int64)
                ends = np.cumsum(n)
                for run in np.split(np.arange(len(n)), np.flatnonzero(np.diff(ends // RUN)) + 1):  # some documents at a time
                    base = int(ends[run[0]] - n[run[0]])
                    ids = dac.read(base, int(ends[run[-1]])).astype("<u4")
                    crc += [zlib.crc32(ids[e - k - base : e - base]) for e, k in zip(ends[run].tolist(), n[run].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first.as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = segments.join(F.broadcast(starts), "part").select("doc_ids", "lengths", (F.col("first_token") + F.col("offset")).alias("first"), "data")
    return placed.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_token(spark: SparkSession, path: str, doc_id: int, k: int) -> int | None:
    """The k-th id of a document; None if there is no such id.  Of rows with one doc_id the first in the files counts.

    Only segments whose range of ids has the document are read, and the id is found where they are, without decoding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = row["doc_ids"].index(doc_id)
                n = row["lengths"][at]
                found = Dac(row["data"])[sum(row["lengths"][:at]) + k] if 0 <= k < n else None
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((row["part"], pa.int32()), (row["seq"], pa.int32()), (found, pa.int64()))], ["part", "seq", "id"])

    near = spark.read.schema(SEGMENTS).parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id) & F.array_contains("doc_ids", doc_id))
    rows = near.select("part", "seq", "doc_ids", "lengths", "data").mapInArrow(tidy(run), "part int, seq int, id long").collect()  # one for each segment with the document
    return min(rows)["id"] if rows else None


def op2_token_store(spark, sf_dir):
    import public_tokenizers

    path = forget_at_exit(spark, scratch_path(spark, "tokens"))
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
