"""The classifier on invented texts, and the pipeline against its parts' plain versions."""

import random
import zlib

import pytest

import corpus_pipeline
from halfeven.llm import byte_bpe, toxicity

from . import brute
from .test_near_dedup import brute as near

BAD = ["idiotic", "moronish", "worthless"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = frame(spark, [*rows, (5000, None), (5001, ""), (None, "idiotic")])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    truth = {d: t for d, _, t in labels}
    held = [d for d in truth if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in truth)
    right = sum(got[d].predicted == truth[d] for d in held)
    caught = [got[d].predicted for d in held if truth[d]]
    assert right / len(held) > 0.95 and sum(caught) / len(caught) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[5000].score == got[5001].score and got[5000].predicted == 0 and not got[None].held_out
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = corpus(200)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    one, two = (toxicity.fit(frame(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert one.bias == two.bias and (one.weights == two.weights).all() and (one.buckets == two.buckets).all()


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, None), (None, 1, 1)]])
def test_few_labels(spark, labels):
    rows = [(1, "a b c"), (2, None), (3, "word " * 50_000)]
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [r.predicted for r in toxicity.toxicity_scores(docs, model).collect()] == [0, 0, 0]
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_pipeline_equals_plain_versions(spark, tmp_path):
    rng = random.Random(9)
    rows, labels = corpus(300, 4)
    item = "one two three four five six seven eight nine ten eleven twelve"
    fresh = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    base = fresh(60)
    rows += [(1000, base), (1001, base.upper()), (1002, base + " more"), (1003, fresh(20) + " " + item), (1004, None), (1005, ""), (1006, fresh(9) + " idiotic " + fresh(9))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(r.doc_id, r.text) for r in toxicity.drop_toxic(docs, model).select("doc_id", "text").collect()]
    kept = {d for d, v in brute.exact(left).items() if v[2]}
    left = [(d, t) for d, t in left if d in kept]
    left = [(d, t) for d, t in left if near(left)[d][1] == d] if len(left) < 50 else (lambda c: [(d, t) for d, t in left if c[d][1] == d])(near(left))
    hits = brute.contamination(left, [(1, item)])
    left = [(d, t) for d, t in left if not hits[d][1]]
    assert set(got) == {d for d, _ in left}
    assert 1006 not in got and 1003 not in got and len({1000, 1001, 1002} & set(got)) == 1
    import public_tokenizers as P

    bpe = byte_bpe.worker_bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for d, t in left:
        assert got[d].ids == bpe.encode([t or ""])[0].tolist() and got[d].decoded_sha256 == brute.sha((t or "").encode())


def test_stages_take_awkward_tables(spark, tmp_path):
    schema = SCHEMA + ", digest string, x_digest string, kept boolean, component_id string, w string"
    rows = [(1, "a b", None, None, None, None, None, None, None, None), (1, "a b", None, None, None, None, None, None, None, None), (None, None, "x", "y", 3, "d", "e", True, "f", "g")]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() == (0 if table is not docs else 2 if name == "exact_dedup" else 3), name
        assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count() == (3 if table is docs else 0)
