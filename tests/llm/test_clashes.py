"""Columns called as those that operators make or use."""

import numpy as np

from gridloom.llm import line_dedup, ngram_jaccard, packing, toxicity
from pyspark.sql import functions as F


def test_line_counts_replace_columns_of_their_names(spark):
    pages = spark.createDataFrame([(k, "s", f"same line here\nown {k}", 7, 8, "x") for k in range(4)], "id int, site string, text string, n_lines int, N_DROPPED int, lines string")
    got = line_dedup.line_dedup(pages, F.col("site"), line_dedup.text_lines(F.col("text")), counts=True).collect()
    assert sorted((r.id, r.text, r.n_lines, r.n_dropped, r.lines) for r in got) == [(k, f"own {k}", 2, 1, "x") for k in range(4)]


def test_near_copies_with_columns_of_their_own_names(docs):
    rows = [(1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (3, "other words than those of the rest", "a")]
    frame = docs(rows, (5, "m", 9), "_id int, _mark string, node int")
    got = ngram_jaccard.keep_one_of_each(frame).collect()
    assert sorted((r.doc_id, r._id, r._mark, r.node) for r in got) == [(1, 5, "m", 9), (3, 5, "m", 9)]


def test_scores_replace_a_column_of_their_name(docs):
    frame = docs([(1, "some words", "a"), (2, None, "b")], ("old",), "score string")
    got = toxicity.score(frame, toxicity.Network())
    assert got.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_signatures_against_a_loop(spark):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 50, int(n)).astype("<u2") for n in [0, 1, 2, 7, 64, 65, 200, 130, 1000] * 40]
    counts = np.bincount(np.concatenate(texts), minlength=50)
    term = np.concatenate([np.arange(50), [packing.VOCABULARY, packing.VOCABULARY + 1]])

    class Shared:
        value = packing.Weights(term, np.concatenate([np.minimum(counts, 150), [len(texts), counts.sum()]]))

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.tobytes() for t in texts], pa.binary())], names=["doc_id", "ids"])
    (got,) = packing._signatures(Shared, 64)(iter([batch]))
    for ids, one, two in zip(texts, got.column("first").to_pylist(), got.column("second").to_pylist(), strict=True):
        terms, tf = np.unique(ids[len(ids) // 64 * 64 :], return_counts=True)
        top = terms[np.argsort(-Shared.value.impact(terms, tf, tf.sum()), kind="stable")[:2]].tolist() + [-1, -1]
        assert (one, two) == tuple(top[:2])


def test_signatures_widen_few_rows_at_a_time():
    import tracemalloc

    import pyarrow as pa

    term = np.append(np.arange(50), [packing.VOCABULARY, packing.VOCABULARY + 1])

    class Shared:
        value = packing.Weights(term, np.append(np.full(50, 7), [2000, 2000 * 56]))

    own = (np.arange(3000) % 50).astype("<u2").tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([own] * 2000, pa.binary())], names=["doc_id", "ids"])
    tracemalloc.start()
    (got,) = packing._signatures(Shared, 64)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2000 and peak < batch.nbytes  # four times that for all ids at once
