import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stratus.llm import text as X

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t🙂", max_size=40)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(texts)
def test_words_and_ngrams_match_plain_python(values):
    buf = X.buffer_of(pa.array(values, pa.string()))
    words = X.split_words(buf)
    names = X.word_hashes(buf, words)
    grams, start = X.ngram_hashes(names, words.first, 2)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", v or "") for v in values]
    assert words.counts().tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert [buf.data[s:e].tobytes().decode() for s, e in zip(words.start, words.end)] == flat
    assert len(set(zip(flat, names.tolist()))) == len(set(flat)) == len(set(names.tolist()))
    pairs = [tuple(p[i:i + 2]) for p in plain for i in range(len(p) - 1)]
    assert len(pairs) == len(grams) and len(set(pairs)) == len(set(grams.tolist()))


def test_hashes_do_not_depend_on_the_batch():
    a = X.buffer_of(pa.array(["red green", "blue"]))
    b = X.buffer_of(pa.array(["x", None, "blue red green"]))
    ha, hb = (X.word_hashes(x, X.split_words(x)) for x in (a, b))
    assert ha.tolist() == [hb[2], hb[3], hb[1]]
    assert X.bytes_hash(b"blue") == hb[1]


def test_chunks_keep_documents_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 10, None, "b" * 50, "", "c"])], names=["doc_id", "text"])
    got = [(r.column("doc_id").to_pylist(), np.diff(b.offsets).tolist()) for r, b in X.chunks([batch], max_bytes=12)]
    assert [i for ids, _ in got for i in ids] == list(range(5))
    assert [n for _, ns in got for n in ns] == [10, 0, 50, 0, 1]
