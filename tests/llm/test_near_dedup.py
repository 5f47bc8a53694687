import random
import re

import numpy as np
import pytest

from halfeven.llm import near_dedup
from halfeven.llm.components import components
from halfeven.llm.near_dedup import near_duplicates

SCHEMA = "doc_id long, text string"


def brute(rows):
    """component of every id, by comparing all pairs of sets."""
    sets, parent = {}, {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        parent[doc] = doc

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def result(spark, rows, **options):
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


def edited(words, changes, rng):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("block, most", [(4096, 500_000), (7, 0)])
def test_copies_of_a_hub_with_many_edits(spark, monkeypatch, block, most):
    """Copies whose similarity to the hub runs from 0.4 to 1: many survive the signatures, few are linked."""
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST", most)
    rng = random.Random(5)
    hub = [f"h{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(k + 10, edited(hub, rng.randrange(0, 14), rng)) for k in range(160)]
    rows += [(500 + k, " ".join(f"x{rng.randrange(10**6)}" for _ in range(40))) for k in range(20)]
    assert result(spark, rows, block=block) == brute(rows)


def test_edges(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "two one"), (7, "a b c d e"), (8, "a b c d e"), (9, long), (10, long + " end"), (11, "É b"), (12, "é b")]
    assert result(spark, rows) == brute(rows)


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (None, "a b c", "z"), (2, "q r s t u v", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(docs).collect())
    assert found == [("1", 1, "1", True), ("1", 1, "1", True), ("2", 2, "2", True), ("None", 1, "None", True)]
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("block, most", [(1024, 500_000), (1, 0)])
def test_every_text_of_a_repeated_id_is_linked(spark, monkeypatch, block, most):
    """Texts under one id whose sets are of one size: each has its own near or exact copies, or none."""
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST", most)
    text = lambda k, more="": " ".join(f"t{k}w{i}" for i in range(30)) + more
    rows = [(10, text(k)) for k in range(6)] + [(10, text(0))] + [(20 + k, text(k, " end")) for k in range(5)]
    rows += [(40, text(7)), (41, text(7)), (41, text(8)), (42, text(8)), (41, ""), (50, text(9)), (51, text(9)), (51, " "), (60, "")]
    want = {10: 10, **{20 + k: 10 for k in range(5)}, 40: 40, 41: 40, 42: 40, 50: 50, 51: 50, 60: 60}
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert len(found) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert {(r.doc_id, r.component_id) for r in found} == set(want.items())


def test_thresholds_are_posterior_bounds():
    """The chance that a pair at the limit passes a batch is at least 1 - MISS, up to the prior's extra place."""
    from math import comb

    for n, m in zip(range(near_dedup.BATCH, near_dedup.HASHES + 1, near_dedup.BATCH), near_dedup.least_matches(), strict=True):
        below = sum(comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(m))
        assert below < 5e-6


def test_signature_matches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:3000], rng.integers(0, 2**63, 1000, dtype=np.uint64)]))
    share = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(share - 0.6) < 0.15


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(200, 199), (199, 198)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 120)}, 199: 198, 200: 198}


def test_no_pair_near_the_limit_is_missed(spark):
    """Hundreds of separate pairs with similarities from exactly 0.75 to 0.80, and as many just below."""
    rng, rows, want = random.Random(11), [], {}
    for k in range(400):
        n = rng.randrange(60, 240)
        words = [f"p{k}w{i}" for i in range(n + 4)]
        most = n * 25 // 75
        linked = k % 2 == 0
        more = rng.randrange(n // 4, most + 1) if linked else most + 1 + rng.randrange(4)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + [f"p{k}x{i}" for i in range(more)]))]
        want[2 * k], want[2 * k + 1] = 2 * k, 2 * k + (0 if linked else 1)
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_rows_dealt_grow_with_the_group(spark, monkeypatch):
    """Twice as many copies of a hub, with as many outsiders: about twice as many rows go to blocks."""
    made, write = [], near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, label: (made.append((label, out.count())) if (out := write(df, label)) is not None and label == "dealt" else None, out)[1])
    for copies in (150, 300):
        rng = random.Random(3)
        hub = [f"h{i}" for i in range(300)]
        rows = [(k, edited(hub, 2, rng)) for k in range(copies)] + [(1000 + k, edited(hub[:230], 0, rng) + f" z{k} " + " ".join(f"z{k}y{i}" for i in range(40))) for k in range(20)]
        assert result(spark, rows, block=64) == brute(rows)
    (_, one), (_, two) = made
    assert two < 2.6 * one
