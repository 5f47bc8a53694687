"""Byte-level BPE, the token store and the removal of repeats."""

import base64
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from halfeven.llm import byte_bpe, repeats, token_store
from halfeven.llm.common import forget_at_exit, scratch_path

from . import brute

P = pytest.importorskip("public_tokenizers")
RNG = random.Random(3)
TEXTS = [
    None, "", " ", "Hello world, it's we'll  see\n\n  x ", "a" * 3000, "ab" * 700, "東京" * 200, "\x85 \xa0 q \x1c z", "<|endoftext|> x", "é" * 200, "\n \n a",
    "".join(RNG.choice("abcdeé漢字 ") for _ in range(3000)), "word " * 20_000, "tab\t tab", "🌊🌊 ‍👩‍👩‍👧",
]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string")


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode_decode(frame(spark, TEXTS)).collect()}
    for k, t in enumerate(TEXTS):
        want = enc.encode_ordinary(t or "")
        assert got[k].ids == want and got[k].n_tokens == len(want)
        assert got[k].ids_sha256 == brute.sha(",".join(map(str, want)).encode())
        assert got[k].decoded_sha256 == brute.sha((t or "").encode())
    assert byte_bpe.encode_decode(frame(spark, TEXTS).limit(0)).count() == 0


def test_equal_pairs_of_a_step_contract_as_single_ones_would():
    """Long pieces take all pairs of a step at once; a small merge table where that is not always allowed."""
    bpe = byte_bpe.worker_bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(1)
    pieces = list({"".join(rng.choice("aeioubcd") for _ in range(n)).encode() for n in range(2, 60)})
    short = bpe.contract(pieces)
    before, byte_bpe.LONG_BYTES = byte_bpe.LONG_BYTES, 0
    try:
        assert bpe.contract(pieces) == short
    finally:
        byte_bpe.LONG_BYTES = before
        bpe.close()


def contracted(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One pair after another: the leftmost of least rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("seed", range(12))
def test_contractions_on_random_merge_tables(tmp_path, seed):
    """Tables whose ranks follow no order of merging, so that a new pair often has a smaller rank than the one it came from."""
    rng = random.Random(seed)
    made = {bytes([k]): k for k in range(256)}
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(120)}
    made.update(zip(sorted(words, key=lambda _: rng.random()), range(256, 256 + len(words)), strict=True))
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for t, k in made.items()))
    bpe = byte_bpe.ByteBpe(str(path), P.PATTERN)
    pieces = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 40))) for _ in range(40)} - made.keys())
    want = [contracted(p, made) for p in pieces]
    for most in (128, 0):  # the recursive query, then the steps for long pieces
        before, byte_bpe.LONG_BYTES = byte_bpe.LONG_BYTES, most
        try:
            assert [np.frombuffer(x, "<i4").tolist() for x in bpe.contract(pieces)] == want
        finally:
            byte_bpe.LONG_BYTES = before
    bpe.close()


def test_store_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [*TEXTS, "same", "same", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y <|endoftext|>", " " + "<|endoftext|> " * 50]
    path = forget_at_exit(spark, scratch_path(spark, "test"))
    token_store.write_tokens(frame(spark, texts), path, P.path("byte_bpe_50k.json"), segment=500)
    got = {r.doc_id: r for r in token_store.read_tokens(spark, path).collect()}
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start = 0
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        if k in (3, 6):
            assert [token_store.read_token(spark, path, k, i) for i in (0, len(ids) - 2, len(ids) - 1, len(ids))] == [ids[0], ids[-2], 0, None]
        start += len(ids)
    assert token_store.read_token(spark, path, 999, 0) is None


def test_store_edges(spark):
    docs = spark.createDataFrame([(None, "b"), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    path = forget_at_exit(spark, scratch_path(spark, "test"))
    token_store.write_tokens(docs, path, P.path("byte_bpe_50k.json"))
    assert sorted((str(r.doc_id), r.start) for r in token_store.read_tokens(spark, path).collect())[0][0] == "1"
    path = forget_at_exit(spark, scratch_path(spark, "test"))
    token_store.write_tokens(docs.limit(0), path, P.path("byte_bpe_50k.json"))
    assert token_store.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [5] * 1000, list(range(3000)), [2**31, 1, 0, 70000] * 300])
@pytest.mark.parametrize("widths", [None, [4, 12, 16]])
def test_dac(ids, widths):
    dac = token_store.Dac(token_store.dac_encode(np.array(ids, dtype=np.uint32), widths))
    assert len(dac) == len(ids) and dac.decode().tolist() == ids
    for a, b in [(0, 0), (0, 1), (5, 9), (511, 514), (512, 1024), (700, 3000), (len(ids), len(ids))]:
        assert dac.read(min(a, len(ids)), min(b, len(ids))).tolist() == ids[a:b]
    assert [dac[i] for i in range(0, len(ids), 7)] == ids[::7]
    with pytest.raises(IndexError):
        dac[len(ids)]


def repeat_texts():
    passage = "".join(RNG.choice("abcd ") for _ in range(120))
    rows = ["".join(RNG.choice("abcdefgh ") for _ in range(RNG.randrange(0, 200))) for _ in range(40)]
    rows = [r[: len(r) // 2] + (passage[RNG.randrange(30) : RNG.randrange(60, 120)] if k % 3 else "") + r[len(r) // 2 :] for k, r in enumerate(rows)]
    return [*rows, "x" * 90, "xy" * 60, passage, passage, "é" * 80, None, "", rows[0] + rows[0], "short"]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_all_copies(spark, hot):
    rows = list(enumerate(repeat_texts()))
    docs = frame(spark, [t for _, t in rows])
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in repeats.Repeats(40, "none", 16, hot).apply(docs).collect()}
    assert got == brute.repeats(rows, 40)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_keep_the_first(spark, hot):
    """Of every repeated string exactly one occurrence stays, at least in part uncovered by its own windows; nothing unrepeated goes."""
    rows = list(enumerate(repeat_texts()))
    every = brute.repeats(rows, 40)
    got = {r.doc_id: r for r in repeats.Repeats(40, "first", 16, hot).apply(frame(spark, [t for _, t in rows])).collect()}
    assert all(got[d].n_removed <= every[d][1] for d, _ in rows)
    assert sum(r.n_removed for r in got.values()) < sum(v[1] for v in every.values())
    left = [(d, bytes(got[d].kept)) for d, _ in rows]
    strings = {t.encode()[i : i + 40] for _, t in rows if t for i in range(len(t.encode()) - 39)}
    assert {t[i : i + 40] for t in (b for d, b in left if not got[d].spans) for i in range(len(t) - 39)} <= strings
    first = {}
    for d, t in rows:  # the first occurrence, by document and place, of every string
        for i in range(len((t or "").encode()) - 39):
            first.setdefault(t.encode()[i : i + 40], (d, i))
    for d, t in rows:
        gone = bytearray(len((t or "").encode()))
        for i in range(len(gone) - 39):
            if first[t.encode()[i : i + 40]] != (d, i):
                gone[i : i + 40] = b"\1" * 40
        assert bytes(got[d].kept) == bytes(b for b, g in zip((t or "").encode(), gone, strict=True) if not g)
    copies = [d for d, t in rows if t == rows[42][1]]
    assert len(copies) == 2 and got[copies[1]].kept == b""


@pytest.mark.parametrize("keep", ["none", "first"])
def test_texts_whose_names_collide_are_told_apart(spark, monkeypatch, keep):
    docs = frame(spark, repeat_texts())
    rows = lambda: {r.doc_id: (r.n_removed, bytes(r.kept)) for r in repeats.Repeats(40, keep, 16).apply(docs).collect()}
    want = rows()
    monkeypatch.setattr(repeats, "_name", lambda text: F.pmod(F.octet_length(text), F.lit(5)).cast("long"))
    assert rows() == want


def test_repeats_edges(spark):
    docs = spark.createDataFrame([(1, "a" * 300), (1, "a" * 300), (None, "b" * 10), (2, None)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in repeats.Repeats(keep="none").apply(docs).collect())
    assert got == [(0, 0), (10, 0), (300, 300), (300, 300)]
    assert repeats.Repeats().apply(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.Repeats(keep="last")


def test_long_texts_are_cut_and_joined(spark):
    before, repeats.PIECE = repeats.PIECE, 64
    try:
        data = "".join(RNG.choice("ab") for _ in range(500))
        docs = [data[:300], data[100:400] + "zz", "q" + data[50:90]]
        assert sum(len(p[1]) - 1 for p in repeats._pieces([d.encode() for d in docs], 40)) > 3
    finally:
        repeats.PIECE = before


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_suffix_ranks_follow_the_bytes():
    rng = np.random.default_rng(4)
    for data in (rng.integers(0, 3, 400), rng.integers(0, 256, 300), np.zeros(90), np.frombuffer(thue_morse(1500).encode(), np.uint8)):
        raw = data.astype(np.uint8).tobytes()
        for length in (1, 2, 5, 8, 9, 40, 200):
            cut = [(raw[i : i + length]).ljust(length, b"\0") for i in range(len(raw))]
            place = {c: k for k, c in enumerate(sorted(set(cut)))}
            got = repeats.suffix_ranks(np.frombuffer(raw, np.uint8), length)
            assert len(set(zip(got.tolist(), cut, strict=True))) == len(place) and (np.diff(got[sorted(range(len(raw)), key=lambda i: place[cut[i]])]) >= 0).all()


def test_repeats_in_strings_that_defeat_polynomial_hashes(spark):
    """Thue-Morse strings and their complements, on which sums of powers modulo 2^64 agree."""
    t = thue_morse(4096)
    rows = list(enumerate([t[:2048] + "x", t[2048:] + "y", t[1024:3072], t[100:400] + "z" + t[100:400]]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in repeats.Repeats(200, "none").apply(frame(spark, [t for _, t in rows])).collect()}
    assert got == brute.repeats(rows, 200)


def test_previous_smaller_and_factor():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 300):
        x = rng.permutation(n)
        want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(n)]
        assert repeats.previous_smaller(x).tolist() == want
    text = "abracadabra-abracadabra"
    order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
    lcp = lambda a, b: next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]), 0)
    for length in (1, 3, 5):
        run = np.cumsum([0, *[lcp(order[k - 1], order[k]) < length for k in range(1, len(order))]])
        want = [any(text[j : j + length] == text[i : i + length] and len(text) - i >= length for j in range(i)) for i in range(len(text))]
        assert repeats.long_previous_factor(order, run).tolist() == want
