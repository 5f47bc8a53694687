"""Removal of repeated byte strings by longest-previous-factor arrays.

A string of L bytes that starts at two places is found in three steps.

1.  Buckets.  Of the k-grams in every L-byte window the one with the least hash is the window's anchor
    (the leftmost of equals), so equal windows have equal anchors at equal offsets.  About 2 in L-k+2
    places are anchors; only their hashes are counted over the corpus.
2.  Suffix order.  Anchors that occur twice or more send their surroundings to the bucket of their hash.
    There the starts of all windows are put in suffix order by the bytes of their suffixes, cut off at L
    bytes (prefix doubling; equal surroundings are ordered once): suffixes that share their first L bytes
    are neighbours.  In that order the previous and the next smaller position of
    each start are its nearest earlier occurrences, and the longest previous factor reaches L where one
    of them shares L bytes.  Starts whose factor reaches L are later copies: with keep="first" only they
    go.  With keep="none" the same is done towards larger positions too, and every copy goes.
3.  Removal.  Marked windows come back to their text, and the bytes that any of them covers go.

Equal texts are one text in steps 1 and 2; a text of L or more bytes that has an equal is repeated as a
whole.  Copies of texts that very many rows have (found by a frequent-items sketch, counted exactly and
broadcast) never leave the task that reads them.  A bucket with more than `hot` anchors is not gathered: its windows are counted one by one by
their digest, with partial aggregation, so no task gets a bucket that grows with the corpus.

A text is named by a hash of 64 bits.  Names that different texts share are found over the whole corpus,
by 60 bits of the texts' SHA-256, and those texts are named by these bits instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, table, tidy

LENGTH = 200
GRAM = 32
#: Anchors of one hash that are compared in one task, at most (each brings some 300 bytes).
HOT = 20_000
#: Texts that are settled where they are read, at most: any that more than 1/4096 of the rows have.
HEAVY = 4096
#: Tasks that one window's occurrences are dealt to.
SALTS = 16
#: Bytes of text or surroundings that numpy holds at once, about.
PIECE = 1 << 18

_RNG = np.random.default_rng(7)
_BYTES = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; the worker keeps the longest it needed."""
    if len(_POWERS[0]) < n:
        size = max(n, 4 * PIECE)
        _POWERS[:] = (np.cumprod(np.full(size, b, dtype=np.uint64)) for b in (_BASE, pow(_BASE, -1, 2**64)))
    return _POWERS[0], _POWERS[1]


_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _prefixes(data: np.ndarray, salt: int = 0) -> np.ndarray:
    """Sums from which the hash of any substring follows."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[salt][data] * _powers(len(data))[0][: len(data)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """The hash of the substring of this length at every place."""
    n = len(sums) - length
    x = (sums[length:] - sums[:n]) * _powers(n)[1][:n]
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts that stand one after another: text, anchor's place, first and last window, hash.  Places are in `data`."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    hashes = _hashes(_prefixes(data), gram)
    packed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    place = (_least(packed, length - gram + 1) & _PLACE).astype(np.int64)
    windows = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(starts[:-1], starts[1:], strict=True)])
    if not len(windows):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    place = place[windows]
    # one anchor serves neighbouring windows; windows of the next text start a new one (its anchor lies in it)
    edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    first, last, place = windows[edge], windows[np.append(edge[1:] - 1, len(windows) - 1)], place[edge]
    return np.searchsorted(starts, first, side="right") - 1, place, first, last, hashes[place]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side, a bounded number of bytes at a time: data, starts, row of each, offset of each in its text.

    A long text is cut; its parts overlap by length - 1 bytes, so that each window is in one part.
    """
    held, rows, offsets, size = [], [], [], 0

    def out():
        starts = np.zeros(len(held) + 1, dtype=np.int64)
        np.cumsum([len(h) for h in held], out=starts[1:])
        return np.frombuffer(b"".join(held), dtype=np.uint8), starts, np.array(rows), np.array(offsets)

    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            held.append(part)
            rows.append(row)
            offsets.append(at)
            size += len(part)
            if size >= PIECE:
                yield out()
                held, rows, offsets, size = [], [], [], 0
    if held:
        yield out()


def _name(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def _second_name(text: Column) -> Column:
    """The first 60 bits of the text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _renamed(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """`rows` with the second name where different texts share the first; few names are shared, so Spark broadcasts them."""
    marked = rows.join(shared.withColumn("is_shared", F.lit(True)), "text_key", "left")
    return marked.withColumn("text_key", F.when(F.col("is_shared"), F.col("second")).otherwise(F.col("text_key"))).drop("is_shared")


def _texts(column: pa.Array) -> list[bytes]:
    return pc.cast(column, pa.binary()).fill_null(b"").to_pylist()


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For every place the nearest earlier place with a smaller value, or -1: pointers jump until they find it."""
    at = np.arange(-1, len(x) - 1)
    left = np.arange(len(x))
    while len(left := left[(at[left] >= 0) & (x[at[left]] > x[left])]):
        at[left] = at[at[left]]
    return at


def long_previous_factor(order: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which suffixes have a longest previous factor of L or more.

    `order` lists positions in suffix order; `run` numbers the stretches of that order in which neighbours share L bytes.
    """
    earlier = previous_smaller(order)
    later = len(order) - 1 - previous_smaller(order[::-1])[::-1]
    found = (earlier >= 0) & (run[earlier] == run)
    inside = later < len(order)
    found |= inside & (run[np.where(inside, later, 0)] == run)
    out = np.zeros(len(order), dtype=bool)
    out[order] = found
    return out


def _ranked(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return out


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of every suffix of `data` by its first `length` bytes, exactly; zeros stand after the end.

    Prefix doubling: the ranks for 2 h bytes follow from those for h bytes at a place and h bytes later.
    """
    n, h = len(data), 1
    padded = np.concatenate([data, np.zeros(length + 8, dtype=np.uint8)])
    while h * 2 <= min(length, 8):
        h *= 2
    keys = np.zeros(n + length, dtype=np.uint64)
    for k in range(h):  # h bytes as one number, the first byte highest
        keys = keys << np.uint64(8) | padded[k : k + n + length]
    rank = _ranked(keys)
    while h < length:
        step = min(h, length - h)
        later = np.concatenate([rank[step:], np.full(step, rank[-1])])  # past the end there are zeros only
        rank = _ranked(rank * (int(rank.max()) + 1) + later)
        h += step
    return rank[:n]


def _mark(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int, keep: str) -> np.ndarray:
    """Which windows are copies: of each surrounding its first counts[i] starts are windows; they stand in order of position."""
    windows = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    rank = suffix_ranks(data, length)[windows]
    order = np.argsort(rank, kind="stable")  # suffixes that share all L bytes follow each other by position
    run = rank[order]
    marked = long_previous_factor(order, run)
    if keep == "none":
        marked |= long_previous_factor(len(order) - 1 - order, run)[::-1]
    return marked


class Repeats:
    """The operator's settings."""

    def __init__(self, length: int = LENGTH, keep: str = "first", gram: int = GRAM, hot: int = HOT):
        if keep not in ("first", "none"):
            raise ValueError("keep: first or none")
        self.length, self.keep, self.gram, self.hot = length, keep, min(gram, length), hot

    def _anchors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("text_key").to_numpy()
            for data, starts, rows, offsets in _pieces(_texts(batch.column("text")), self.length):
                doc, place, _, _, h = anchors(data, starts, self.length, self.gram)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[rows[doc]]), pa.array(place - starts[doc] + offsets[doc])], ["h", "text_key", "place"])

    def _found(self, batches: Iterator[pa.RecordBatch], column: str):
        """Anchors of the texts whose places are listed: key and first id of the text, data, and per anchor its text's row, place, first and last window, and the base of its text in data."""
        for batch in batches:
            batch = batch.filter(batch.column("stands"))
            keys = batch.column("text_key").to_numpy()
            lists = batch.column(column).to_pylist()
            for data, starts, rows, offsets in _pieces(_texts(batch.column("text")), self.length):
                doc, place, first, last, h = anchors(data, starts, self.length, self.gram)
                wanted = np.concatenate([np.asarray(lists[r] or (), dtype=np.int64) - o + s for r, o, s in zip(rows, offsets, starts[:-1], strict=True)])
                inside = np.concatenate([np.full(len(lists[r] or ()), k) for k, r in enumerate(rows)]).astype(np.int64)
                wanted = wanted[(wanted >= starts[inside]) & (wanted < starts[inside + 1])]
                hit = np.isin(place, wanted)
                texts = pa.array(rows[doc[hit]])
                yield keys[texts], batch.column("first_id").take(texts), data, (offsets - starts[:-1])[doc[hit]], first[hit], last[hit], h[hit]

    def _surroundings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, data, base, first, last, h in self._found(batches, "places"):
            raw = data.tobytes()
            around = [raw[a : b + self.length] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array(keys), pa.array(first + base), pa.array(around, pa.binary())], ["h", "first_id", "text_key", "first", "around"])

    def _windows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, data, base, first, last, _ in self._found(batches, "hot_places"):
            if not len(keys):
                continue
            n = last - first + 1
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            one, two = (_hashes(_prefixes(data, salt), self.length)[at].view(np.int64) for salt in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(one), pa.array(two), ids.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.repeat(keys, n)), pa.array(at + np.repeat(base, n))], ["one", "two", "first_id", "text_key", "start"]
            )

    def _copies(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marked stretches of the buckets; rows come sorted by (h, first_id, text_key, first)."""

        def judge(t: pa.Table) -> pa.RecordBatch:
            h, key, first = (t.column(c).to_numpy() for c in ("h", "text_key", "first"))
            own = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (first[1:] != first[:-1])])  # equal texts send equal rows
            key, first = key[own], first[own]
            coded = t.column("around").filter(pa.array(own)).combine_chunks().dictionary_encode()  # copies have equal surroundings
            around, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            sizes = np.array([len(a) for a in around])
            counts, starts = (sizes - self.length + 1)[which], (np.cumsum(sizes) - sizes)[which]
            marked = _mark(np.frombuffer(b"".join(around), dtype=np.uint8), starts, counts, self.length, self.keep)
            row = np.repeat(np.arange(len(counts)), counts)
            begin = np.flatnonzero(marked & np.concatenate([[True], ~marked[:-1] | (row[1:] != row[:-1])]))
            end = np.flatnonzero(marked & np.concatenate([~marked[1:] | (row[1:] != row[:-1]), [True]]))
            shift = first - np.cumsum(counts) + counts
            return pa.RecordBatch.from_arrays([pa.array(key[row[begin]]), pa.array(begin + shift[row[begin]]), pa.array(end + shift[row[end]] + self.length)], ["text_key", "start", "end"])

        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(at, 1024)])
                held.append(part)
                size += part.column("around").nbytes
                if size >= PIECE:  # hold back the last bucket, which may go on
                    t = pa.concat_tables(held).combine_chunks()
                    h = t.column("h").to_numpy()
                    cut = int(np.searchsorted(h, h[-1]))
                    if cut:
                        yield from self._parts(t.slice(0, cut), judge)
                    held = [t.slice(cut)]
                    size = held[0].column("around").nbytes if cut else size
        if held:
            yield from self._parts(pa.concat_tables(held).combine_chunks(), judge)

    @staticmethod
    def _parts(t: pa.Table, judge) -> Iterator[pa.RecordBatch]:
        """Judges whole buckets, some together as long as they stay small."""
        h = t.column("h").to_numpy()
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        sizes = np.cumsum(pc.binary_length(t.column("around")).to_numpy())
        begin = 0
        while begin < len(h):
            base = sizes[begin - 1] if begin else 0
            fit = ends[(ends > begin) & (sizes[ends - 1] - base <= PIECE)]
            stop = int(fit[-1]) if len(fit) else int(ends[ends > begin][0])
            yield judge(t.slice(begin, stop - begin))
            begin = stop

    def _cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, kept = [], [], [], []
            for text, starts, ends, whole in zip(_texts(batch.column("text")), *(batch.column(c).to_pylist() for c in ("starts", "ends", "whole")), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted(zip(starts or (), ends or (), strict=True)) if not whole else [(0, len(text))]:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                left, at = [], 0
                for a, b in merged:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                n.append(len(text))
                removed.append(sum(b - a for a, b in merged))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    def apply(self, docs: DataFrame) -> DataFrame:
        """One row per row of `docs`: doc_id, n_bytes, n_removed, spans (removed runs), kept (remaining bytes).

        Texts are UTF-8 bytes; null is the empty text.  "Earlier" follows the least doc_id that a text has (null first),
        then the place in the text.  Repeated rows are copies of each other (with keep="first" of rows with one id all
        stay); null ids are ordinary.  A long text is worked on in parts that overlap.  An empty table gives no rows.
        Columns besides doc_id and text are ignored, whatever their names.
        """
        small_batches(docs.sparkSession)
        text = F.coalesce(F.col("text"), F.lit(""))
        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        read = read.withColumns({"text_key": _name(F.col("text")), "second": _second_name(F.col("text"))})
        digests = materialise(read.where(F.octet_length("text") >= self.length).select("doc_id", "text_key", "second"), "digests")
        shared = digests.groupBy("text_key").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo != hi")
        shared = materialise(shared.select("text_key"), "shared_names")
        if shared.take(1):
            read, digests = _renamed(read, shared), _renamed(digests, shared)
        copies_of = lambda rows: rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("texts"))
        groups = copies_of(digests)
        # texts that very many rows have are settled where they are read: at most HEAVY keys, broadcast
        listed = digests.agg(F.expr(f"approx_top_k(text_key, {HEAVY}, {HEAVY})").alias("top")).select(F.explode("top.item").alias("text_key"))
        heavy = materialise(copies_of(digests.join(F.broadcast(listed), "text_key")).where("texts > 1").select("text_key", F.col("first_id").alias("heavy_id"), F.lit(True).alias("heavy")), "heavy")
        tagged = read.join(F.broadcast(heavy), "text_key", "left").withColumn("copy", F.col("heavy").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("heavy_id")))
        short = F.octet_length("text") < self.length
        settled = tagged.where(short | F.col("copy"))
        rest = tagged.where(~(short | F.col("copy"))).select("doc_id", "text_key", "text")

        places = rest.select("text_key", "text").mapInArrow(tidy(self._anchors), "h long, text_key long, place long")
        name = F.xxhash64("text_key", "place")
        counted = places.withColumn("name", name).groupBy("h").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.count(F.lit(1)).alias("n"))
        repeated = materialise(counted.where("lo != hi").select("h", (F.col("n") > self.hot).alias("hot")), "anchors")
        where = places.join(repeated, "h").groupBy("text_key").agg(
            F.collect_set(F.when(~F.col("hot"), F.col("place"))).alias("places"), F.collect_set(F.when(F.col("hot"), F.col("place"))).alias("hot_places")
        )
        # of equal texts one stands for all
        chosen = where.join(groups.select("text_key", "first_id"), "text_key")
        # (told apart in Python: as a condition it would join the key, and the texts would be shuffled once more for the last join)
        found = rest.join(chosen, "text_key").select("doc_id", "text_key", "text", "places", "hot_places", "first_id", F.col("doc_id").eqNullSafe(F.col("first_id")).alias("stands"))
        copies = (
            found.mapInArrow(tidy(self._surroundings), "h long, first_id long, text_key long, first long, around binary")
            .repartition("h")
            .sortWithinPartitions("h", "first_id", "text_key", "first")
            .mapInArrow(tidy(self._copies), "text_key long, start long, end long")
        )
        if repeated.where("hot").take(1):
            copies = copies.unionByName(self._hot_copies(found))
        marks = copies.groupBy("text_key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
        equal = groups.where("texts > 1").select("text_key", "first_id", F.lit(True).alias("equal"))
        marks = marks.join(equal, "text_key", "full")
        whole = F.col("equal") if self.keep == "none" else F.col("equal") & ~F.col("doc_id").eqNullSafe(F.col("first_id"))
        joined = rest.join(marks, "text_key", "left").select("doc_id", "text_key", "text", "starts", "ends", F.coalesce(whole, F.lit(False)).alias("whole"))
        none = F.lit(None).cast("array<long>")
        settled = settled.select("doc_id", "text_key", "text", none.alias("starts"), none.alias("ends"), F.col("copy").alias("whole"))
        shape = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
        return joined.mapInArrow(tidy(self._cut), shape).unionByName(settled.mapInArrow(tidy(self._cut), shape))

    def _hot_copies(self, found: DataFrame) -> DataFrame:
        """Windows of hot anchors, one row each: of a digest with several windows all but the first are later copies."""
        windows = found.mapInArrow(tidy(self._windows), "one long, two long, first_id long, text_key long, start long")
        at = F.struct("first_id", "text_key", "start")
        sets = windows.groupBy("one", "two").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo != hi")
        # a window that very many texts share is dealt to several tasks
        salted = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = windows.withColumn("salt", F.pmod(F.xxhash64("text_key", "start"), F.lit(SALTS)).cast("int")).join(salted, ["one", "two", "salt"])
        if self.keep == "first":
            marked = marked.where(at != F.col("lo"))
        return marked.select("text_key", "start", (F.col("start") + self.length).alias("end"))


def op3_repeats(spark, sf_dir):
    found = Repeats(keep="none").apply(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
