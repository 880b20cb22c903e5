import re
import zlib

import numpy as np
import pyarrow as pa

from llm_fixtures import frame, odd_rows, words  # noqa: F401

from stratus.llm import quality, text as X, toxicity


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)]


def test_measures_match_plain_python(words):
    texts = ["a b c d e a b c d e x", "l1\nl1\n \n \nl2 \nl2", "é🙂 #|<>", "", None, "x x x x x x x", " ".join(words(60) * 2)]
    buf = X.buffer_of(pa.array(texts))
    got = quality.text_measures(buf, X.split_words(buf))
    for i, t in enumerate(texts):
        assert [int(got[m][i]) for m in quality.MEASURES] == plain_measures(t)


def test_quality_over_odd_rows_and_clean_documents(frame, words, odd_rows):
    good = [(100 + i, " ".join(words(80))) for i in range(40)]
    bad = [(200 + i, " ".join(w + "###" for w in words(80))) for i in range(40)]
    labels = frame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1)], "doc_id long, quality int")
    got = quality.quality_rules(frame(good + bad + odd_rows), labels).collect()
    assert len(got) == len(good + bad + odd_rows)
    verdict = {r.doc_id: r for r in got}
    assert all(verdict[i].kept for i, _ in good)
    assert not any(verdict[i].kept for i, _ in bad)
    assert verdict[1].base_failed and verdict[4].base_failed and not verdict[1].kept
    again = quality.quality_rules(frame(bad + odd_rows + good).repartition(5), labels).collect()
    assert {(r.doc_id, r.log_ratio, r.kept) for r in again} == {(r.doc_id, r.log_ratio, r.kept) for r in got}


def test_quality_without_labels_or_rows(frame):
    none = frame([], "doc_id long, quality int")
    assert quality.quality_rules(frame([]), none).count() == 0
    got = quality.quality_rules(frame([(1, "a b c d e f g h i j k")]), none).collect()
    assert got[0].kept


def toxic_corpus(words, n=300):
    rows, labels = [], []
    for i in range(n):
        body = words(60)
        if i % 3 == 0:
            body[20] = ["idiot", "moron", "worthless"][i % 9 // 3]
            body[40] = "pathetic"
        rows.append((i, " ".join(body)))
        labels.append((i, int(i % 3 == 0)))
    return rows, labels


def test_toxicity_held_out_accuracy_and_misspellings(frame, words):
    rows, labels = toxic_corpus(words)
    got = toxicity.toxicity_scores(frame(rows + [(1000, None), (1001, ""), (None, "idiot"), (1002, " ".join(words(30)) + " idiiot patthetic")]),
                                   frame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (i in held) for i, _ in rows)
    assert np.mean([by[i].predicted == labels[i][1] for i in held]) > 0.9
    assert by[1000].score == by[1001].score < 0.5 and by[1002].predicted == 1 and by[None].held_out is False
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_scores_do_not_depend_on_partitions(frame, words):
    rows, labels = toxic_corpus(words, 120)
    marks = frame(labels, "doc_id long, toxic int")
    a = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame(rows), marks).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame(rows[::-1]).repartition(7), marks).collect()}
    assert a == b


def test_toxicity_without_labels_and_filter_keeps_columns(frame, words):
    none = frame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity_scores(frame([(1, "x")]), none).collect()] == [0]
    assert toxicity.toxicity_scores(frame([]), none).count() == 0
    rows, labels = toxic_corpus(words, 150)
    docs = frame([(i, t, float(i)) for i, t in rows], "doc_id long, text string, score double")
    kept = toxicity.drop_toxic(docs, frame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & {i for i, y in labels if y}) <= 5 and len(ids & {i for i, y in labels if not y}) >= 80


def test_training_bytes_are_bounded_for_huge_texts(frame, words):  # noqa: F811
    """A few labelled books and one word of a megabyte: the sample keeps whole passages up to its bound."""
    plain = words(60_000)
    rows = [(i, " ".join(plain + (["idiot"] * 2_000 if i % 2 else []) + ["x" * 1_000_000])) for i in range(1, 9)] + [(100 + i, "") for i in range(4)]
    marks = frame([(i, i % 2) for i in range(1, 9)] + [(100 + i, 0) for i in range(4)], "doc_id long, toxic int")
    docs = frame(rows)
    whole = toxicity.training_sample(docs, marks)
    part = toxicity.training_sample(docs, marks, max_bytes=60_000)
    assert whole.first[-1] > 100_000 and 1_000 < part.first[-1] < 30_000
    assert set(np.diff(part.first)) <= set(range(1, 17)) and set(part.toxic[part.doc]) == {0, 1}
    assert part.token.max() == len(part.edge) - 2 and part.edge[-1] == len(part.bucket)
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, marks).collect()}
    assert [got[i] for i in range(1, 9)] == [i % 2 for i in range(1, 9)]
