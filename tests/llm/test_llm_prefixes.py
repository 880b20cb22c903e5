"""Prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from llm_fixtures import frame  # noqa: F401
from stratus.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth long, x1 long, bytes string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    lines = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        lines[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:] if rebuild else turns)
    members = defaultdict(list)
    for c, line in lines.items():
        for d in range(len(line) + 1):
            members[line[:d]].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(convs) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted((min(convs), len(node), min(members[node[:-1]]) if node else -1, len(convs), kids[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(str(c) for c in sorted(convs) if lines[c] == node).encode()).hexdigest())
                  for node, convs in members.items())


def found(df):
    assert dict(df.dtypes) == dict.fromkeys(COLUMNS[:-1], "bigint") | {"ends_sha256": "string"}
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(COLUMNS).collect())


def rows_of(rng, convs, most, kinds):
    return [(c, t, rng.choice("ab"), f"é{rng.randrange(kinds)}" * rng.randrange(1, 3), 1, 2, "z")
            for c in convs for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("members", [4, 1024])
def test_trie_equals_a_dictionary(frame, members):  # noqa: F811
    rng = random.Random(members)
    rows = rows_of(rng, range(60), 14, 2) + [(100 + c, t, "a", f"same{t}", 1, 2, "z") for c in range(25) for t in range(12)]
    rng.shuffle(rows)
    assert found(prefixes.prefix_trie(frame(rows, SCHEMA), members=members)) == brute(rows)


def test_long_conversations_cross_blocks(frame):  # noqa: F811
    long = [(c, t, "a", f"t{t}", 1, 2, "z") for c in (5, 10, 11) for t in range(1060 + (c == 11))]
    rows = long + [(7, 0, None, None, 1, 2, "z")]
    assert found(prefixes.prefix_trie(frame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(frame):  # noqa: F811
    rows = [(None, 0, "a", "x", 1, 2, "z"), (3, None, None, None, 1, 2, "z"), (3, 0, "", "", 1, 2, "z"), (4, 5, "a", None, 1, 2, "z"),
            (4, 5, "a", None, 1, 2, "z"), (8, None, "a", "y" * 200_000, 1, 2, "z"), (9, 1, None, "\x00日本", 1, 2, "z"), (-7, 1, "a", "b", 1, 2, "z")]
    for rebuild in (True, False):
        if rebuild:     # a negative id rounds towards zero, as in SQL; the dictionary above rounds down
            rows_now = rows[:-1]
        else:
            rows_now = rows
        assert found(prefixes.prefix_trie(frame(rows_now, SCHEMA), rebuild=rebuild)) == brute(rows_now, rebuild)


def test_turns_that_repeat_a_number_stand_in_one_order(frame):  # noqa: F811
    rows = [(c, 1, "a", x, 1, 2, "z") for c in (1, 2) for x in ("p", "q", "r")]
    got = prefixes.prefix_trie(frame(rows + rows[:1], SCHEMA), rebuild=False).collect()
    assert sorted((r.depth, r.n_convs) for r in got)[:2] == [(0, 2), (1, 2)] and max(r.depth for r in got) == 4


def test_empty_table(frame):  # noqa: F811
    assert prefixes.prefix_trie(frame([], SCHEMA)).count() == 0
    assert prefixes.prefix_trie(frame([(None, 1, "a", "b", 1, 2, "z")], SCHEMA)).count() == 0


def test_queue_spills_and_keeps_the_order(tmp_path):
    rng = random.Random(3)
    queue, sent = prefixes.SpillingQueue(str(tmp_path / "runs"), 10), defaultdict(int)
    for _ in range(500):
        place, n = (rng.randrange(40), rng.randrange(3)), rng.randrange(9)
        queue.push((*place, n, 2 * n, 1))
        sent[place] += n
    assert queue.spilled > 10
    for place in sorted(sent):
        got = list(queue.pop_at(place))
        assert sum(m[2] for m in got) == sent[place] and sum(m[3] for m in got) == 2 * sent[place]
    assert len(queue) == 0 and not list((tmp_path / "runs").iterdir())


def test_spilling_gives_the_same_totals(frame):  # noqa: F811
    rows = rows_of(random.Random(1), range(80), 9, 2)
    assert found(prefixes.prefix_trie(frame(rows, SCHEMA), queue_rows=3)) == brute(rows)
