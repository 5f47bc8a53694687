"""Byte-level BPE in DuckDB: recursive queries contract, an ordered aggregation decodes.

Each partition keeps its own DuckDB.  A piece of the pattern that is itself a token takes its id; every
other piece becomes one row per byte (piece, position, token, next position, next token).  A recursive
query joins the rows to the merge table and, in each step, contracts the leftmost pair of least rank of
every piece, until no row has a merge.  Only distinct pieces are contracted; texts are put together from
them.  Decoding maps ids to byte strings and concatenates them by an ordered aggregation over each list.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import encode_parts, slices, small_batches, table, tidy

#: Bytes, about, of the texts, pieces and ids that a task remembers; twice as many with those of the time before.  They go with the task.
REMEMBERED = 48 << 20
#: What a remembered text takes besides its bytes and those of its ids.
ENTRY = 180
#: Bytes of text that are encoded at once.
SLICE = 1 << 20
#: Pieces with more bytes contract all equal pairs of a step at once (see LONG).
LONG_BYTES = 128
#: Squared lengths of the pieces of one recursive query, summed: its rows, over all steps, are no more than half of that.
SQUARES = 2_000_000
DUCKDB_MEMORY = "64MB"

SHORT = """
WITH RECURSIVE s(step, w, pos, tok, np, nx) AS (
  SELECT 0, w, pos, tok, np, nx FROM pieces
  UNION ALL
  (WITH least AS (SELECT w, min(m * 4294967296 + pos) AS k, arg_min(np, m * 4294967296 + pos) AS gone FROM s JOIN merges ON tok = l AND nx = r GROUP BY w),
        pair AS (SELECT s.w, k & 4294967295 AS place, (k >> 32)::INTEGER AS m, gone, s.np AS after, s.nx AS following FROM least JOIN s ON s.w = least.w AND s.pos = gone)
   SELECT step + 1, s.w, pos, CASE WHEN pos = place THEN m ELSE tok END, CASE WHEN pos = place THEN after ELSE np END,
          CASE WHEN pos = place THEN following WHEN np = place THEN m ELSE nx END
   FROM s JOIN pair ON s.w = pair.w WHERE pos <> gone)
)
SELECT s.w, tok FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) AS done ON s.w = done.w AND s.step = done.step ORDER BY s.w, pos
"""

#: One step for long pieces.  All pairs of the least rank are contracted from left to right, unless one of the pairs
#: that this makes has a smaller rank: then only the leftmost is, so that the result is that of single contractions.
LONG = """
CREATE OR REPLACE TEMP TABLE state AS
WITH p AS (SELECT w, pos, tok, row_number() OVER o AS i, lead(tok) OVER o AS nx, lead(tok, 2) OVER o AS after, lag(tok) OVER o AS before
           FROM state WINDOW o AS (PARTITION BY w ORDER BY pos)),
     c AS (SELECT p.*, m, min(m) OVER (PARTITION BY w) AS least FROM p JOIN merges ON tok = l AND nx = r),
     e AS (SELECT *, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM c WHERE m = least),
     f AS (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY i) AS place, row_number() OVER (PARTITION BY w ORDER BY i) AS nth FROM e),
     u AS (SELECT DISTINCT f.w FROM f JOIN merges x ON (x.l = f.before AND x.r = f.m) WHERE x.m < f.m
           UNION SELECT DISTINCT f.w FROM f JOIN merges x ON (x.l = f.m AND x.r = f.after) WHERE x.m < f.m
           UNION SELECT DISTINCT f.w FROM f JOIN merges x ON (x.l = f.m AND x.r = f.m) WHERE x.m < f.m),
     g AS (SELECT w, i, m FROM f WHERE place % 2 = 1 AND (nth = 1 OR w NOT IN (SELECT w FROM u)))
SELECT p.w, p.pos, coalesce(g.m, p.tok)::INTEGER AS tok FROM p LEFT JOIN g ON p.w = g.w AND p.i = g.i
WHERE NOT EXISTS (SELECT 1 FROM g AS q WHERE q.w = p.w AND q.i + 1 = p.i)
"""

DECODE = """
WITH v AS (SELECT list(s ORDER BY id) AS s FROM vocabulary)
SELECT d, coalesce(list_aggregate(list_select((SELECT s FROM v), list_transform(ids, lambda i: i + 1)), 'string_agg', ''), '') AS s FROM documents_ids ORDER BY d
"""


class ByteBpe:
    """A tokenizer from a file of ranks (base64 token and rank a line) and a pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks[bytes([k])] for k in range(256)], dtype=np.int32)
        self.opened = None
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], m) for t, m in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True))
        self.merges = pa.table({"l": left, "r": right, "m": rank.cast(pa.int64())})
        # bytes stand as the characters U+0000 to U+00FF; ids that no token has are empty
        tokens = {i: t.decode("latin-1") for t, i in self.ranks.items()}
        size = max(tokens) + 1
        self.vocabulary = (pa.table({"id": pa.array(range(size), pa.int32()), "s": pa.array([tokens.get(i, "") for i in range(size)])}))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of `known`

    @property
    def con(self):
        """The task's DuckDB, in memory only; close() gives its memory back."""
        import duckdb

        if self.opened is None:
            self.opened = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
            self._put("merges", self.merges)
            self._put("vocabulary", self.vocabulary)
        return self.opened

    def close(self) -> None:
        """Ends a task: workers live on between operators, so only the tables of the tokenizer stay."""
        self.forget()
        if self.opened is not None:
            self.opened.close()
            self.opened = None

    def _put(self, name: str, rows: pa.Table) -> None:
        self.con.register("arriving", rows)
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arriving")
        self.con.unregister("arriving")

    def _rows(self, pieces: list[bytes]) -> pa.Table:
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths)
        tok = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        pos = np.arange(len(tok)) - np.repeat(ends - lengths, lengths)
        following = np.append(tok[1:], -1)
        following[ends - 1] = -1
        return pa.table({"w": pa.array(np.repeat(np.arange(len(pieces)), lengths), pa.int32()), "pos": pa.array(pos), "tok": pa.array(tok), "np": pa.array(pos + 1), "nx": pa.array(following, pa.int32())})

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, as little-endian u32, of distinct pieces that are not tokens themselves."""
        out: list = [None] * len(pieces)
        short = np.array([k for k, p in enumerate(pieces) if len(p) <= LONG_BYTES], dtype=np.int64)
        squares = np.cumsum([len(pieces[k]) ** 2 for k in short.tolist()])
        for part in np.split(short, np.flatnonzero(np.diff(squares // SQUARES)) + 1) if len(short) else ():
            part = part.tolist()
            self._put("pieces", self._rows([pieces[k] for k in part]))
            self._split(out, part, self.con.sql(SHORT).to_arrow_table())
        long = [k for k, p in enumerate(pieces) if len(p) > LONG_BYTES]
        if long:
            self._put("state", self._rows([pieces[k] for k in long]).select(["w", "pos", "tok"]))
            size = lambda: self.con.sql("SELECT count(*) FROM state").fetchall()[0][0]
            before = None
            while before != (now := size()):
                before = now
                self.con.execute(LONG)
            self._split(out, long, self.con.sql("SELECT w, tok FROM state ORDER BY w, pos").to_arrow_table())
        return out

    @staticmethod
    def _split(out: list, places: list[int], rows: pa.Table) -> None:
        w, tok = rows.column("w").to_numpy(), rows.column("tok").to_numpy().astype("<i4")
        raw, begin = tok.tobytes(), 0
        for k, end in zip(places, [*(np.flatnonzero(np.diff(w)) * 4 + 4).tolist(), len(raw)], strict=True):
            out[k] = raw[begin:end]
            begin = end

    def _recall(self, texts: list[str]) -> list[str]:
        """Those of the texts whose ids the worker doesn't remember."""
        new = []
        for t in texts:
            if t not in self.known:
                if (i := self.older.pop(t, None)) is not None:
                    self.known[t] = i
                    self.held += len(t) + len(i) + ENTRY
                else:
                    new.append(t)
        return new

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct short texts one after another, and how many each has.

        A text is remembered with its ids, and so is each of its pieces; only pieces that are not are contracted.
        """
        if self.held > REMEMBERED:  # two generations: what was met in the older one stays
            self.known, self.older, self.held = {}, self.known, 0
        known, ranks = self.known, self.ranks
        new = self._recall(texts)
        # letters, with or without a space before them, are one piece
        single, several = [], []
        for t in new:
            (single if (t[1:] if t[:1] == " " else t).isalpha() else several).append(t)
        pieces = list(map(self.pieces, several))
        todo = []
        for p in chain(single, self._recall(list(set(chain.from_iterable(pieces)).difference(single)))):
            raw = p.encode()
            if (i := ranks.get(raw)) is not None:
                known[p] = i.to_bytes(4, "little")
            else:
                todo.append((p, raw))
        if todo:
            known.update(zip([p for p, _ in todo], self.contract([raw for _, raw in todo]), strict=True))
        for t, ps in zip(several, pieces, strict=True):
            if len(ps) != 1:
                known[t] = b"".join([known[p] for p in ps])
        self.held += sum(map(len, new)) * 2 + sum(len(raw) * 2 for _, raw in todo) + ENTRY * (len(new) + len(todo))
        found = [known[t] for t in texts]
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.frombuffer(raw, dtype="<i4") for raw in encode_parts(texts, lambda parts: self._ids([f" {p}" for p in parts.to_numpy(zero_copy_only=False)]), self._ids)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        ends = np.cumsum([0, *[len(x) for x in ids]])
        flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
        self.con.register("documents_ids", pa.table({"d": pa.array(range(len(ids)), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}))
        rows = self.con.sql(DECODE).to_arrow_table()
        self.con.unregister("documents_ids")
        return [s.encode("latin-1") for s in rows.column("s").to_pylist()]


_MADE: dict[tuple[str, str], ByteBpe] = {}


def worker_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    """The worker's tokenizer; workers are used again, so it is built once."""
    if (ranks_path, pattern) not in _MADE:
        _MADE[ranks_path, pattern] = ByteBpe(ranks_path, pattern)
    return _MADE[ranks_path, pattern]


def encode_decode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, ids_sha256, decoded_sha256.

    Null is the empty text: no ids, and the digests of nothing.  Repeated rows and null ids each give a row, an
    empty table gives none.  A long text is encoded part by part, cut where no piece of the pattern goes on.  Columns
    besides doc_id and text are ignored, whatever their names.
    """
    import public_tokenizers

    ranks_path, pattern = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(ranks_path, pattern)
        number = [str(i) for i in range(max(bpe.ranks.values()) + 1)]
        try:
            for batch in batches:
                for a, b in slices(batch.column("text"), SLICE):
                    ids = bpe.encode([t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
                    joined = [hashlib.sha256(",".join([number[i] for i in x.tolist()]).encode()).hexdigest() for x in ids]
                    back = [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids)]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x) for x in ids]]), pa.int32()), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), lists, pa.array(joined), pa.array(back)],
                        ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                    )
        finally:
            bpe.close()

    small_batches(docs.sparkSession)
    read = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return read.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents")).drop("ids")
