import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import frame, odd_rows, words  # noqa: F401

from stratus.llm import lm, pieces, queries, shards, text as X, toolcalls


# Pieces -----------------------------------------------------------------------

def plain_viterbi(raw, vocab):
    """Best score of a byte string over the vocabulary, one step at a time."""
    table = {int(k): int(s) for k, s in zip(vocab.keys, vocab.scores)}
    best = [0] + [None] * len(raw)
    for j in range(1, len(raw) + 1):
        best[j] = best[j - 1] + int(pieces.BYTE_SCORE * pieces.SCALE)
        for k in vocab.lengths:
            if k <= j and (s := table.get(X.bytes_hash(raw[j - k:j]))) is not None:
                best[j] = max(best[j], best[j - k] + s)
    return best[-1]


def path_score(ids, vocab):
    score = dict(zip(vocab.ids.tolist(), vocab.scores.tolist()))
    return sum(score.get(int(i), int(pieces.BYTE_SCORE * pieces.SCALE)) for i in ids)


TEXTS = ["", "a b  c", "Hello world, ünïcode 日本 \x00\n\tx", " lead", "  two", "trail  ", None, "▁mark a▁b", "x" * 3000, "🙂🙂 été", "\n", " ", "   "]


def test_best_paths_match_plain_viterbi_and_decode():
    vocab = pieces.load(pieces.default_model())
    buf = X.buffer_of(pa.array(TEXTS))
    ids, edges = pieces.Encoder(vocab).encode(buf)
    back = pieces.decode_buffer(ids, edges, vocab)
    for i, t in enumerate(TEXTS):
        raw = (b"\xff" + t.encode().replace(b" ", b"\xff")) if t else b""
        assert path_score(ids[edges[i]:edges[i + 1]], vocab) == plain_viterbi(raw, vocab)
        assert back.data[back.offsets[i]:back.offsets[i + 1]].tobytes().decode() == (t or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=30), max_size=6))
def test_round_trip_of_any_text(texts):
    vocab = pieces.load(pieces.default_model())
    buf = X.buffer_of(pa.array(texts, pa.string()))
    back = pieces.decode_buffer(*pieces.Encoder(vocab).encode(buf), vocab)
    assert [back.data[a:b].tobytes().decode() for a, b in zip(back.offsets, back.offsets[1:])] == texts


def test_pieces_over_odd_rows(frame, odd_rows):
    encoded = pieces.encode_pieces(frame(odd_rows))
    got = encoded.collect()
    assert len(got) == len(odd_rows) and all(r.round_trip for r in got)
    assert [r.piece_ids for r in got if r.doc_id == 1] == [None] and [r.piece_ids for r in got if r.doc_id == 2] == [[]]
    back = pieces.decode_pieces(encoded).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in back) == sorted((i or 0, t or "") for i, t in odd_rows)
    assert pieces.encode_pieces(frame([])).count() == 0


def test_paths_do_not_depend_on_the_batch():
    vocab = pieces.load(pieces.default_model())
    encoder = pieces.Encoder(vocab)
    alone = [pieces.Encoder(vocab).encode(X.buffer_of(pa.array([t])))[0].tolist() for t in TEXTS]
    for _ in range(2):
        ids, edges = encoder.encode(X.buffer_of(pa.array(TEXTS)))
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == alone


# Language model ---------------------------------------------------------------

@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (7, 100), (1000, 1 << 40), (5000, 3000), (3000, (1 << 62) + 1)])
def test_elias_fano_reads_and_finds(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    assert np.array_equal(lm.Monotone(lm.ef_build(values, universe)).get(np.arange(n)), values)
    distinct = np.unique(values)
    got = lm.Monotone(lm.ef_build(distinct, universe))
    asked = np.concatenate((distinct, rng.integers(0, universe, 200, dtype=np.uint64)))
    where = {int(v): i for i, v in enumerate(distinct)}
    assert got.find(asked).tolist() == [where.get(int(v), -1) for v in asked]


def test_a_context_is_looked_up_once_for_all_its_words(monkeypatch):
    sequences = {k: lm.Monotone(lm.ef_build(np.array(v), n)) for k, v, n in (("contexts", [2, 5], 8), ("ranges", [0, 3, 4], 5), ("next", [1, 3, 7, 14], 20))}
    bytes_of = {"a": np.array([0, 32, 64, 96], np.uint8), "rest": np.array([32, 64], np.uint8)}

    class Flat:
        shards, offsets = 1, np.array([0, 4])
        sequence = staticmethod(lambda shard, name: sequences[name])
        array = staticmethod(lambda shard, name: bytes_of[name])
    asked, find = [], lm.Monotone.find
    monkeypatch.setattr(lm.Monotone, "find", lambda self, x, *ends: asked.append((self, len(x))) or find(self, x, *ends))
    node, a, rest = lm.find_next(Flat, 10, np.array([2, 2, 2, 2, 5, 5, 6, -1]), np.array([1, 3, 4, 7, 4, -1, 1, 1]))
    assert node.tolist() == [0, 1, -1, 2, 3, -1, -1, -1]
    assert np.allclose(a, [1, 0.1, 0, 0.01, 0.001, 0, 0, 0]) and np.allclose(rest, [0.1] * 4 + [0.01] * 2 + [1, 1])
    assert sum(n for of, n in asked if of is sequences["contexts"]) == 3


@pytest.mark.parametrize("columns,top", [(1, 50), (2, 50), (2, 1 << 40)])
def test_summed_counts_distinct_keys(columns, top):
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 40, 500).astype(np.uint64) * np.uint64(top) for _ in range(columns)]
    want = Counter(zip(*(k.tolist() for k in keys)))
    got, count = lm._summed(keys, np.ones(500, np.int64))
    assert dict(zip(zip(*(k.tolist() for k in got)), count.tolist())) == want
    assert sorted(want) == list(zip(*(k.tolist() for k in got)))


def plain_model(rows, min_count=2):
    """The same interpolated model with dictionaries, without rounding to bytes."""
    def tokens(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", t) + [None]
    train = [tokens(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = [Counter(), Counter(), Counter()]
    for doc in train:
        padded = ["<s>", *doc]
        counts[0].update(doc)
        counts[1].update(zip(padded, doc))
        counts[2].update(zip(padded, doc, doc[1:]))
    total, seen = sum(counts[0].values()), len(counts[0])
    two = {k: c for k, c in counts[1].items() if c >= min_count}
    three = {k: c for k, c in counts[2].items() if c >= min_count}
    context = Counter(counts[0])
    context["<s>"] = len(train)
    rest1, rest2 = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    for (u, _), c in two.items():
        rest1[u] -= (c - lm.DISCOUNT) / context[u]
    for (u, v, _), c in three.items():
        rest2[u, v] -= (c - lm.DISCOUNT) / two[u, v]

    def score(t):
        doc, base, full, known = tokens(t), 0.0, 0.0, 0
        padded = ["<s>", *doc]
        for j, w in enumerate(doc):
            c = counts[0][w]
            p = (c + 0.5) / (total + 0.5 * (seen + 1))
            base += math.log10(p)
            known += c > 0
            u = padded[j]
            p = (two[u, w] - lm.DISCOUNT) / context[u] * ((u, w) in two) + rest1[u] * p if (u, w) in two else rest1[u] * p
            if j:
                uv = (padded[j - 1], u)
                p = ((three[(*uv, w)] - lm.DISCOUNT) / two[uv] if (*uv, w) in three else 0) + rest2[uv] * p
            full += math.log10(p)
        return len(doc), known, base, full
    return total, score


def test_scores_match_a_model_of_dictionaries(frame, words, odd_rows, monkeypatch):
    pool = [" ".join(words(12)) for _ in range(20)]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(pool[k] for k in rng.integers(0, 20, 5)) + " " + " ".join(words(3))) for i in range(120)]
    rows += [r for r in odd_rows if r[0] not in (8, 10, 11)]
    total, score = plain_model(rows)
    got = lm.lm_scores(frame(rows).repartition(3)).collect()
    assert len(got) == len(rows)
    want = sorted((i or -1, *score(t)) for i, t in rows)
    for r, w in zip(sorted(got, key=lambda r: (r.doc_id or -1, r.n_tokens)), want):
        assert (r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens) == (w[0], w[1], w[2], total)
        assert r.base_score == pytest.approx(w[3], rel=1e-9)
        assert abs(r.score - w[4]) <= 0.03 * w[1]          # one byte per number: half a step per token and order
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_registered_query_keeps_ngrams_seen_once(spark, frame, words, tmp_path):
    rows = [(i, " ".join(words(12))) for i in range(60)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    rows += [(i, t) for i, t in zip(held, learned)]          # held-out copies of texts that training holds once
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    total, score = plain_model(rows, 1)
    cut = plain_model(rows, 2)[1]
    got = {r.doc_id: r for r in queries.op9_language_model(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, known, base, full = score(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert abs(got[i].score - full) <= 0.03 * n
    for i, t in zip(held, learned):
        assert got[i].held_out and got[i].score > cut(t)[3] + 0.3 * got[i].n_tokens


def test_probabilities_sum_to_about_one(frame, words):
    rows = [(i, " ".join(words(4) + ["red", "green", "blue"] * 3)) for i in range(0, 60)]
    docs = frame(rows).selectExpr("text", "true AS training")
    model = lm.train(docs)
    vocabulary = sorted({w for _, t in rows for w in t.split()})
    names = np.array([X.bytes_hash(w.encode()) for w in vocabulary] + [int(lm.END)], np.uint64)
    first = [X.bytes_hash(w.encode()) for w in ("red", "green")]
    total = 0.0
    for name in names:
        _, _, p = lm.score_tokens(np.array([*first, name], np.uint64), np.array([0, 3]), model)
        total += 10 ** p[2]
    assert total == pytest.approx(1, abs=0.06)


def test_model_of_nothing(frame):
    assert lm.lm_scores(frame([])).count() == 0
    got = lm.lm_scores(frame([(None, "a b")])).collect()[0]
    assert got.train_tokens == 0 and got.n_known == 0 and got.n_tokens == 3


# Shards -----------------------------------------------------------------------

def test_shards_are_even_gapless_and_keep_copies_together(frame, odd_rows, words):
    rows = odd_rows + [(100 + i, " ".join(words(int(i % 40) + 1))) for i in range(500)] + [(1000 + i, "copy text here") for i in range(300)]
    got = shards.assign_shards(frame(rows), 40).collect()
    assert len(got) == len(rows)
    size = {(i, t): len((t or "").encode()) + 16 for i, t in rows}
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
        (i or -1, size[i, t], zlib.crc32((t or "").encode())) for i, t in rows)
    total, biggest = sum(r.size for r in got), max(r.size for r in got)
    for k in range(40):
        own = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 40) <= biggest
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert sum(len(h) - 1 for h in homes.values()) <= 39
    assert shards.assign_shards(frame([]), 40).count() == 0


# Tool calls -------------------------------------------------------------------

CALLS = "conv_id long, call_id string, place long, tool string, arguments string"
USES = "conv_id long, call_id string, used_id string"
RESULTS = "conv_id long, call_id string, place long, content string"
SCHEMAS = {"add": {"required": ["a"], "additionalProperties": False,
                   "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}, "m": {"type": "string", "enum": ["x", "y"]}}}}


def link(frame, calls, uses, results):
    return toolcalls.link_tool_calls(frame(calls, CALLS), frame(uses, USES), frame(results, RESULTS), SCHEMAS).collect()


def test_links_verdicts_and_canonical_json(frame):
    calls = [(1, "c1", 0, "add", '{"b": 2.5, "a": 1}'), (1, "c2", 2, "add", '{"a": -1, "z": 0}'), (1, "c3", 4, "sub", "{}"),
             (1, "c4", 5, "add", "{bad"), (1, "c5", 6, "add", None), (1, "c1", 7, "add", '{"a": 2}'), (None, "c1", 0, "add", '{"a": 1}'),
             (2, "c1", 0, "add", '{"a": true, "m": "q"}'), (1, "c2", 2, "add", '{"a": -1, "z": 0}'), (3, "é\"", 0, "add", '{"a": 1, "m": "x"}')]
    results = [(1, "c1", 1, 'got "é"\n'), (1, "c1", 3, "again"), (1, "c9", 8, "orphan"), (2, "c1", 1, None)]
    got = link(frame, calls, [], results)
    assert len(got) == len(calls) + len(results) - 2          # two results live in their calls' rows
    main = {(r.conv_id, r.call_id): r for r in got if r.kind == "call" and r.status in ("linked", "open")}
    assert json.loads(main[1, "c1"].message) == {"arguments": {"a": 1, "b": 2.5}, "id": "c1", "name": "add", "result": 'got "é"\n'}
    assert main[1, "c1"].message.startswith('{"arguments":{"a":1,"b":2.5},"id"') and main[1, "c1"].valid
    assert main[1, "c2"].errors == ["a: too small", "z: unknown"] and main[1, "c3"].errors == ["tool: unknown"]
    assert main[1, "c4"].errors == ["arguments: not JSON"] and main[1, "c5"].errors == ["arguments: missing"]
    assert main[2, "c1"].errors == ["a: not integer", "m: not allowed"] and main[2, "c1"].status == "linked"
    assert json.loads(main[3, "é\""].message)["id"] == "é\""
    assert Counter((r.kind, r.status) for r in got)[("call", "duplicate")] == 3
    assert Counter((r.kind, r.status) for r in got)[("result", "orphan")] == 1 and Counter((r.kind, r.status) for r in got)[("result", "repeated")] == 1


def test_order_respects_uses_and_marks_cycles(frame):
    calls = [(1, f"c{i}", i, "add", '{"a": 1}') for i in range(12)]
    uses = [(1, "c0", "c5"), (1, "c5", "c3"), (1, "c3", "c9"), (1, "c4", "c9"), (1, "c9", "c1"), (1, "c7", "gone"), (1, "c10", "c11"), (1, "c11", "c10"), (1, "c0", "c4")]
    got = [r for r in link(frame, calls, uses, []) if r.kind == "call"]
    rank = {r.call_id: i for i, r in enumerate(sorted(got, key=lambda r: (r.place_after, r.depth, r.place)))}
    cyclic = {r.call_id for r in got if r.status == "cyclic"}
    assert cyclic == {"c10", "c11"}
    for _, user, used in uses:
        if used in rank and not {user, used} & cyclic:
            assert rank[used] < rank[user]
    assert [r.place_after for r in got if r.call_id == "c2"] == [2]


def test_long_conversation_and_empty_tables(frame):
    turns = frame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3000)], "conv_id long, turn long, role string, text string")
    got = toolcalls.link_tool_calls(*toolcalls.calls_of_conversations(turns), toolcalls.SCHEMAS)
    assert got.where("status = 'linked' AND valid").count() == 1500
    assert link(frame, [], [], []) == []


def test_arguments_that_no_parser_takes_are_errors_not_crashes(frame):  # noqa: F811
    deep = "[" * 200_000 + "]" * 200_000
    texts = {"big": '{"x":1e999}', "half": '{"x":"\\ud800"}', "key": '{"\\udfff":1}', "deep": deep, "long": '{"x":' + "9" * 5000 + "}",
             "nan": '{"x":NaN}', "cut": '{"x":', "pair": '{"x":"\\ud83d\\ude42"}', "null": "null"}
    rows = [(1, k, i, "none", t) for i, (k, t) in enumerate(texts.items())]
    got = {r.call_id: r for r in toolcalls.link_tool_calls(frame(rows, CALLS), frame([], USES), frame([], RESULTS), {"none": {}}).collect()}
    assert set(got) == set(texts)
    wrong = {k: r.errors for k, r in got.items() if r.message is None}
    assert set(wrong) == {"big", "half", "key", "deep", "long", "nan", "cut"}
    assert wrong["deep"] == ["arguments: nested too deeply"] and all(e == ["arguments: not JSON"] for k, e in wrong.items() if k != "deep")
    assert got["pair"].valid and '"x":"🙂"' in got["pair"].message and got["null"].errors == ["arguments: not an object"]
