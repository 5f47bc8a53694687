"""MinHash near-duplicates with sequential Bayesian verification.

1.  Every document's set of word shingles is hashed once; from it come a digest of the set and a
    signature of 128 minima.  Documents with equal sets are one node (the smallest doc_id).
2.  Signatures are cut into 32 bands of 4.  Two nodes that share a band are candidates; a pair at the
    limit of 0.75 shares none with a probability of (1 - 0.75^4)^32 = 5e-6.
3.  Candidates are compared in batches of 16 signature places.  After each batch the posterior
    probability that the similarity reaches the limit, given the matches so far (uniform prior), is
    held against `MISS`; below it the pair goes.  What survives is verified on the full sets.
4.  First every node is compared with the smallest node of each of its buckets (a star, linear in the
    bucket) and linked to the likeliest one.  A pair within one component needs no more comparison, since
    its link would not change the result.  In a bucket that still holds several components, the largest
    one there is its main component, and the other nodes are outsiders.  Outsiders are compared with each
    other inside the bucket, and with the main component once, whatever number of buckets they share with
    it: its nodes are dealt to blocks by their ids, each node to one block, and an outsider goes to those
    blocks that hold a node of one of its buckets.
    Pairs live only inside a block's task: a first pass returns the nodes that are in a surviving pair, a
    second one gets their texts, verifies and returns enough links to connect the block.  No link between
    components is lost, no bucket is capped, and no pair becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, table, tidy
from .components import components

SHINGLE = 5
#: The limit: NUM / DEN.
NUM, DEN = 75, 100
HASHES, ROWS = 128, 4  # a band: 4 minima of 16 bits, one long
BATCH = 16
#: Probability with which a batch comparison may drop a pair that reaches the limit.
MISS = 1e-6
#: Rows of a bucket that are compared in one block; larger buckets are cut into blocks of this size.
BLOCK = 1024
#: Rows of ids (of 8 to 32 bytes) that are broadcast to pick texts, at most.
MAX_BROADCAST = 500_000

_RNG = np.random.default_rng(20240229)
_C = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of a shorter text, of its whole sequence of words."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the blanks 0x20, 0x09-0x0D
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    width = min(n, SHINGLE)
    s = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        s += h[k : k + len(s)] * _C[k]
        s ^= s >> np.uint64(31)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of each of the minima under 128 permutations of the shingles' hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        part = np.multiply.outer(_A, x[at : at + 1024])
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least.astype(np.uint16)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        count, digest, sig = [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py())
            count.append(len(s))
            digest.append(xxh3_128_digest(s.tobytes()))
            sig.append(signature(s).view("<i8") if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "sig"])


def least_matches(miss: float = MISS) -> list[int]:
    """After each batch of n places, the fewest matches m with P(similarity >= limit | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its tail above t is the chance of at most m in
    a binomial of n + 1 and t.
    """
    t, out = NUM / DEN, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (left[a], right[b]) pass all batches, and their matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for k, least in enumerate(need):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[a[alive], cut] == right[b[alive], cut]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive, matches


def sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the limit."""
    return np.minimum(n, m) * DEN >= NUM * np.maximum(n, m)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Signatures as rows of 16-bit minima; a column holds each as 32 bands of 64 bits."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.ascontiguousarray(column.flatten().to_numpy()).view(np.uint16).reshape(-1, HASHES)


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    need = least_matches()
    for x in batches:
        if not x.num_rows:
            continue
        fit = np.flatnonzero(sizes_fit(x.column("na").to_numpy(), x.column("nb").to_numpy()))
        alive, matches = survivors(_matrix(x.column("sa")), _matrix(x.column("sb")), fit, fit, need)
        at = pa.array(fit[alive])
        yield pa.RecordBatch.from_arrays([x.column("a").take(at), x.column("b").take(at), pa.array(matches, pa.int32())], ["a", "b", "matches"])


def _pairs_of(sizes: np.ndarray, starts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each group, a bounded number at a time."""
    for m in np.unique(sizes):
        if m < 2:
            continue
        base, rows = starts[sizes == m], max(1, int(most // m))
        for lo in range(0, m - 1, rows):
            i = np.arange(lo, min(m - 1, lo + rows))
            per = m - 1 - i
            first = np.repeat(i, per)
            second = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + first + 1
            many = max(1, most // len(first))
            for at in range(0, len(base), many):
                s = base[at : at + many, None]
                yield (s + first).ravel(), (s + second).ravel()


def _across(starts: np.ndarray, left: np.ndarray, right: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a block's first `left` places with the `right` ones after them, a bounded number at a time."""
    for m, n in np.unique(np.stack([left, right], axis=1), axis=0):
        if not (m and n):
            continue
        base, rows = starts[(left == m) & (right == n)], max(1, int(most // n))
        for lo in range(0, m, rows):
            first = np.repeat(np.arange(lo, min(m, lo + rows)), n)
            second = np.tile(np.arange(m, m + n), len(first) // n)
            many = max(1, most // len(first))
            for at in range(0, len(base), many):
                s = base[at : at + many, None]
                yield (s + first).ravel(), (s + second).ravel()


def _block_pairs(x: dict[str, np.ndarray], sig: np.ndarray, edge: np.ndarray, sizes: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of places, of different components; those of a bucket in the first band that their two nodes share."""
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    whole = x["p"][edge] == x["q"][edge]
    right = np.add.reduceat(x["side"], edge)
    pairs = chain(_pairs_of(sizes[whole], edge[whole]), _across(edge[~whole], (sizes - right)[~whole], right[~whole]))
    for a, b in pairs:
        ok = (x["comp"][a] != x["comp"][b]) & sizes_fit(x["n"][a], x["n"][b])
        a, b = a[ok], b[ok]
        alive, _ = survivors(sig, sig, a, b, need)
        a, b = a[alive], b[alive]
        for at in range(0, len(a), 1 << 16):
            i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            shared = (sig[i] == sig[j]).reshape(-1, HASHES // ROWS, ROWS).all(axis=2).argmax(axis=1)
            mine = (shared == x["band"][i]) | (x["band"][i] < 0)
            first.append(i[mine])
            second.append(j[mine])
    return np.concatenate(first), np.concatenate(second)


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sets."""
    if len(i) < 512:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    # many pairs of few sets: count all at once, some thousand shingles at a time
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)  # counts are exact below 2^24, and each part's are below 2^12
    exact = np.zeros((len(sets), len(sets)), dtype=np.int32)
    for lo in range(0, int(column[-1]) + 1, 4096):
        part = slice(*np.searchsorted(column, [lo, lo + 4096]))
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[row[part], column[part] - lo] = 1
        np.matmul(m, m.T, out=total)
        exact += total.astype(np.int32)
    return exact[i, j].astype(np.int64)


def _block_links(ids: np.ndarray, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs that reach the limit on full sets, enough to connect what they connect."""
    common, n = _common(sets, i, j), np.array([len(s) for s in sets])
    linked = (common > 0) & (common * DEN >= NUM * (n[i] + n[j] - common))
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    out = []
    for a, b in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((int(ids[a]), int(ids[b])))
    return out


def _blocks(verify: bool):
    """Compares the nodes of each block: (band, bucket, p, q), of the whole block if p = q, else across its two sides.

    Rows come sorted by block and side.  Band -1 stands for a main component, whose id is then the bucket.

    Without `verify` it returns the nodes that are in a surviving pair; with it, when rows carry the texts, the links.
    However many pairs a block has, it returns no more rows than it has nodes.
    """
    key = ["band", "bucket", "p", "q"]

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        x = {c: t.column(c).to_numpy() for c in (*key, "side", "id", "n", "comp")}
        edge = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[c][1:] != x[c][:-1] for c in key])]))
        sizes = np.diff(np.append(edge, t.num_rows))
        i, j = _block_pairs(x, _matrix(t.column("sig")), edge, sizes, least_matches())
        if not verify:
            have = np.unique(np.concatenate([i, j]))
            if len(have):
                yield t.select([*key, "side", "id", "comp"]).take(pa.array(have)).combine_chunks().to_batches()[0]
            return
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        texts, links = t.column("text"), []
        for lo, hi in zip(edge, edge + sizes, strict=True):
            part = slice(*np.searchsorted(i, [lo, hi]))
            if part.start < part.stop:
                sets = [shingle_set(v) for v in texts.slice(lo, hi - lo).to_pylist()]
                links += _block_links(x["id"][lo:hi], sets, i[part] - lo, j[part] - lo)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([min(k) for k in links], pa.int64()), pa.array([max(k) for k in links], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:  # rows come sorted by block: hold back the last, unfinished one
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows and (rows >= 4 * BLOCK or size >= 1 << 24):
                t = pa.Table.from_batches(held)
                same = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in key])
                cut = t.num_rows - (int(np.argmin(same[::-1])) or t.num_rows) if not same.all() else 0
                if cut:
                    yield from compare(t.slice(0, cut))
                    t = t.slice(cut)
                held, rows, size = t.to_batches(), t.num_rows, 0
        if rows:
            yield from compare(pa.Table.from_batches(held))

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) whose full sets reach the limit; rows come sorted by (a, b)."""
    kept: dict[tuple[int, int], np.ndarray] = {}

    def shingles(doc: int, text: str | None) -> np.ndarray:
        key = (doc, hash(text))
        if key not in kept:
            if len(kept) > 64:
                kept.clear()
            kept[key] = shingle_set(text)
        return kept[key]

    def linked(sides: tuple[list, list]) -> bool:
        for x in sides[0]:
            for y in sides[1]:
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and common * DEN >= NUM * (len(x) + len(y) - common):
                    return True
        return False

    now, sides = None, ([], [])
    for batch in batches:
        out = []
        for a, b, side, text in zip(*(batch.column(c) for c in ("a", "b", "side", "text")), strict=True):
            pair = (a.as_py(), b.as_py())
            if pair != now:
                if now and linked(sides):
                    out.append(now)
                now, sides = pair, ([], [])
            side = side.as_py()
            sides[side].append(shingles(pair[side], text.as_py()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
    if now and linked(sides):
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64())], ["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets reach the limit, from the documents' whole texts.

    Few pairs are broadcast, so that only the texts they need are shuffled; beyond MAX_BROADCAST rows the join shuffles.
    """
    ends = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(0).alias("side")), F.struct(F.col("b").alias("id"), F.lit(1).alias("side")))).alias("e"))
    ends = ends.select("a", "b", F.col("e.id").alias("id"), F.col("e.side").alias("side"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    if pairs.count() <= MAX_BROADCAST // 2:
        ends = F.broadcast(ends)
    dealt = texts.join(ends, "id").select("a", "b", "side", "text").repartition("a", "b").sortWithinPartitions("a", "b", "side")
    return dealt.mapInArrow(tidy(_verify), "a long, b long")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Texts without words have no shingles and are linked with nothing.  Rows that share a doc_id count as one
    document; rows with a null doc_id stay alone, with a null component_id, and are kept.  An empty table gives no rows.
    A long text is one set of shingles, taken in one row of its task.  Columns besides doc_id and text are ignored,
    whatever their names.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = materialise(read.mapInArrow(tidy(_signatures), "doc_id long, n long, digest binary, sig array<long>"), "signatures")
    # what is joined back to rows of a hot key is written first: adaptive execution splits such a join only if both sides are plain rows
    sets = materialise(every.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "sets")
    members = materialise(every.select("doc_id", "n", "digest").join(sets, "digest", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    nodes = materialise(
        every.join(sets, (every["digest"] == sets["digest"]) & (F.col("doc_id") == F.col("rep")))
        .select(F.col("doc_id").alias("id"), "n", "sig", every["digest"])
        .dropDuplicates(["id", "digest"])  # an id has a node for each of its sets
        .drop("digest"),
        "nodes",
    )
    bands = nodes.select("id", F.posexplode("sig").alias("band", "bucket"))
    buckets = bands.groupBy("band", "bucket").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialise(bands.join(materialise(buckets, "centers"), ["band", "bucket"]), "buckets")

    # a star in every bucket: each node and the smallest one; of a node's stars the likeliest is verified
    star = shared.where("id != center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    likely = star.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(_star), "a long, b long, matches int")
    best = likely.groupBy("b").agg(F.max(F.struct("matches", F.negative("a").alias("x"))).alias("m")).select(F.negative("m.x").alias("a"), "b")
    first = materialise(verified(materialise(best, "likely"), docs), "links")
    label = components(first)

    # then pairs of different components that share a bucket
    labelled = shared.join(label, "id", "left").select("id", "band", "bucket", F.coalesce("component_id", "id").alias("comp"))
    parts = labelled.groupBy("band", "bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    largest = parts.groupBy("band", "bucket").agg(F.max(F.struct("c", F.negative("comp").alias("x"))).alias("m"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("parts"))
    mixed = materialise(largest.where("parts > 1").select("band", "bucket", F.negative("m.x").alias("main"), (F.col("size") - F.col("m.c")).alias("others")), "mixed")
    met = materialise(labelled.join(mixed, ["band", "bucket"]), "met")
    outside = met.where("comp != main")
    # outsiders of a bucket among themselves, in blocks of it
    blocks = F.ceil(F.col("others") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    among = (
        outside.where("others > 1")
        .select("id", "band", "bucket", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("id", "band", "bucket", "comp", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )
    # outsiders with main components: a member is in one block, an outsider goes where a member of its buckets is
    many = lambda rows, n: rows.groupBy("main").agg(F.ceil(F.count_distinct("id") / block).cast("int").alias(n))
    deals = materialise(many(met.where("comp = main"), "ps").join(many(outside, "qs"), "main"), "deals")
    member = met.where("comp = main").join(deals, "main").select("main", "band", "bucket", "id", "qs", F.pmod(F.xxhash64("id"), F.col("ps")).cast("int").alias("p"))
    line = lambda q: F.negative(q + 1)
    inner = member.select("main", "p", "id", "qs").distinct().select(
        "id", F.lit(-1).alias("band"), F.col("main").alias("bucket"), F.col("main").alias("comp"), "p", F.explode(F.transform(F.sequence(F.lit(0), F.col("qs") - 1), line)).alias("q"), F.lit(0).alias("side")
    )
    places = materialise(member.groupBy("band", "bucket").agg(F.collect_set("p").alias("at")), "places")
    to = outside.join(places, ["band", "bucket"]).groupBy("main", "id", "comp").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("at")).join(deals, "main")
    outer = to.select(
        "id", F.lit(-1).alias("band"), F.col("main").alias("bucket"), "comp", F.explode("at").alias("p"), line(F.pmod(F.xxhash64("id"), F.col("qs")).cast("int")).alias("q"), F.lit(1).alias("side")
    )
    met = materialise(among.unionByName(inner).unionByName(outer), "dealt").join(nodes, "id")
    block_key = ["band", "bucket", "p", "q"]
    deal = lambda rows, *more: rows.select(*block_key, "side", "id", "n", "comp", "sig", *more).repartition(*block_key).sortWithinPartitions(*block_key, "side")
    alive = deal(met).mapInArrow(tidy(_blocks(False)), "band int, bucket long, p int, q int, side int, id long, comp long")
    alive = materialise(alive.distinct(), "alive")  # an id with several nodes may come more than once
    wanted = alive.select("id").distinct()
    if alive.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")
    crossing = deal(alive.join(nodes, "id").join(texts, "id"), "text").mapInArrow(tidy(_blocks(True)), "a long, b long")
    links = first.unionByName(materialise(crossing.distinct(), "links"))
    # an id connects the nodes that its texts are in
    least = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    ties = members.join(least, "doc_id").where("rep > a").select("a", F.col("rep").alias("b")).distinct()
    links = links.unionByName(materialise(ties, "ties"))
    final = components(links).withColumnRenamed("id", "rep")
    return (
        members.join(final, "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group of near-duplicates (the smallest doc_id), its columns as they were."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
