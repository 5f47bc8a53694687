"""Null, empty, very long and repeated texts, an empty table and columns with clashing names, for operators on documents."""

import hashlib

import pytest

from halfeven.llm import byte_bpe, decontaminate, near_dedup, toxicity

from .test_toxicity_and_pipeline import corpus, frame

LONG = " ".join(f"w{k}" for k in range(200_000))
ROWS = [(1, LONG), (1, LONG), (2, None), (None, ""), (3, "a b")]
CLASHING = ["n", "w", "x", "id", "ids", "row_id", "text_key", "x_text_key", "digest", "sig", "items", "score", "kept", "component_id", "pos", "len", "ngram"]


@pytest.fixture(scope="module")
def docs(spark):
    names = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *CLASHING) for r in ROWS], f"doc_id long, text string, {names}")


def shape(rows, *columns):
    return sorted(([r[c] for c in columns] for r in rows), key=str)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from halfeven.llm.common import scratch_path

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://driver:7077"))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch_path(cluster, "x")


def test_near_duplicates(docs):
    got = shape(near_dedup.near_duplicates(docs).collect(), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([[1, 199_996, 1, True], [1, 199_996, 1, True], [2, 0, 2, True], [None, 0, None, True], [3, 1, 3, True]], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_contamination(spark, docs):
    benchmark = spark.createDataFrame([(7, "W5 w6, w7", "a"), (8, None, "b"), (9, "", "c")], "item_id long, text string, ngram string")
    got = shape(decontaminate.contamination(docs, benchmark).collect(), "doc_id", "n_words", "n_hit", "n_items")
    assert got == sorted([[1, 200_000, 3, 1], [1, 200_000, 3, 1], [2, 0, 0, 0], [None, 0, 0, 0], [3, 2, 0, 0]], key=str)
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0


def test_bytes_come_back(docs):
    got = shape(byte_bpe.encode_decode(docs).collect(), "doc_id", "decoded_sha256")
    assert got == sorted(([d, hashlib.sha256((t or "").encode()).hexdigest()] for d, t in ROWS), key=str)
    assert byte_bpe.encode_decode(docs.limit(0)).count() == 0


def test_scores(spark, docs):
    rows, labels = corpus(200)
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.toxicity_scores(docs, model).collect()
    assert [r.doc_id for r in got] == [d for d, _ in ROWS]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD) for r in got)
    assert got[0].score == got[1].score and got[2].score == got[3].score
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
