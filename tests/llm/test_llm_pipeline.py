import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import frame, odd_rows, words  # noqa: F401

from stratus.llm import pieces, text as X, toxicity

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture
def tables(frame, words, tmp_path):  # noqa: F811
    frame([(6, 0, 0), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame([(1, " ".join(words(20))), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, spans string, _id long, "
          "text_hash long, c1 string, rep long, h string, fps string")


def test_stages_take_odd_rows_and_clashing_columns(spark, frame, odd_rows, tables):  # noqa: F811
    import corpus_pipeline
    rows = [(i, t, None, "s" * (k % 3), None if t is None else len(t), float(k), "x", k, k, "c", k, "h", None)
            for k, (i, t) in enumerate(odd_rows)]
    docs = frame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, tables)
        assert got.columns == docs.columns, name
        kept = sorted((r.score, r._id, r.fps, r.n_chars if name != "personal_data" else None) for r in got.collect())
        assert kept and {k[1] for k in kept} <= set(range(len(rows))), name
        if name in ("personal_data", "toxicity"):
            assert len(kept) == len(rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert pieces.count() == len(rows)


def test_stages_take_an_empty_table(spark, frame, tables):  # noqa: F811
    import corpus_pipeline
    docs = frame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0, name


@pytest.mark.parametrize("name", ["toxicity", "pieces"])
def test_memory_of_a_task_does_not_grow_with_its_batch(words, name):  # noqa: F811
    """Workers outlive stages: what a large batch takes in one stage is missing in the next."""
    run = {"toxicity": lambda: toxicity._score(toxicity.Model(np.ones(toxicity.BUCKETS, np.int64), 1.0, 0.0), ["doc_id"]),
           "pieces": lambda: pieces._encode(pieces.default_model(), ["doc_id"])}[name]
    known = words(4_000)
    text = [" ".join(known[i % 400:i % 400 + 3_600]) for i in range(200)]
    small = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": text[:40]})
    large = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": text})
    assert small.nbytes < X.CHUNK_BYTES < large.nbytes / 4
    peaks = []
    for batch in (small, small, large):        # the first call loads what a process keeps
        tracemalloc.start()
        assert sum(out.num_rows for out in run()([batch])) == batch.num_rows
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[2] < 3 * peaks[1]        # the pieces of a batch overlap while one follows the other


def test_stages_with_python_tasks_ask_for_small_batches(spark, frame, tables):  # noqa: F811
    import corpus_pipeline
    from stratus.llm.queries import BATCH_CONF
    docs = frame([(1, "a b c d e f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(BATCH_CONF, None)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name in ("toxicity", "near_duplicates", "pieces"):
                spark.conf.unset(BATCH_CONF)
                stage(spark, docs, tables)
                assert spark.conf.get(BATCH_CONF) == f"{2 << 20}b", name
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)
