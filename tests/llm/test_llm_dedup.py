import re

import numpy as np
import pytest

from llm_fixtures import frame, odd_rows, words  # noqa: F401

from stratus.llm import decontam, neardup, repeats


def plain_words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = plain_words(t, True)
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_corpus(words):
    rows, i = [], 0
    for _ in range(6):                       # families of near copies, one edit apart along a chain
        body = words(120)
        for k in range(8):
            rows.append((i, " ".join(body)))
            body = list(body)
            body[(k * 13) % 120] = "edit" + str(k)
            i += 1
    rows += [(i + j, " ".join(words(40))) for j in range(30)]
    i += 30
    rows += [(i + j, rows[0][1].upper()) for j in range(10)]     # copies
    i += 10
    rows += [(i, ""), (i + 1, None), (i + 2, "two words"), (i + 3, "Two words"), (i + 4, "two"), (i + 5, "a b c d e f g"), (i + 6, "a b c d e f g h")]
    return rows


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_components_match_brute_force(frame, words, n, percent):
    rows = near_corpus(words)
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(rows), n, percent).collect()}
    want = plain_components(rows, n, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_refined_buckets_lose_nothing(frame, words):
    passage = words(60)
    rows = [(i, " ".join(passage + words(25))) for i in range(60)]
    rows += [(100 + i, " ".join(passage + words(6))) for i in range(20)]
    near = words(100)
    for i in range(60):                      # copies of one text, some beyond the threshold from it
        w = list(near)
        for j in range(1 + i % 4):
            w[(i * 7 + j * 25) % 100] = f"x{i}y{j}"
        rows.append((200 + i, " ".join(w)))
    for n, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(rows), n, percent).collect()}
        assert got == {i: c for i, (_, c) in plain_components(rows, n, percent).items()}


def test_far_copies_of_a_copied_text_do_not_multiply_bucket_rows(frame, words, monkeypatch):
    body, rows = words(150), []
    for i in range(260):                     # some 60 % within the threshold of the first, the others not
        w = list(body)
        for j in range(1 + i % 13):
            w[(i * 11 + j * 149 // (1 + i % 13)) % 150] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    made, write = [], neardup.materialize

    def counted(df, name):
        out = write(df, name)
        if name in ("buckets", "refined"):
            made.append(out.count())
        return out
    monkeypatch.setattr(neardup, "materialize", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(rows), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows, 3, 85).items()}
    assert sum(made) < 4 * made[0]


def test_twice_extended_keys_miss_few_pairs():
    rng = np.random.default_rng(1)
    for percent in (80, 85):
        chance = (percent / 100) ** neardup.rows_for(percent)
        shared = rng.random((100_000, neardup.BANDS)) < chance
        found = np.zeros(len(shared), bool)
        for a in neardup.STEPS[0]:
            for b in neardup.STEPS[1]:
                found |= (shared & np.roll(shared, -a, 1) & np.roll(shared, -b, 1)).any(1)
        assert (~found).sum() <= 10


def test_bits_of_a_pair_at_the_threshold_stay_below_the_bound():
    rng = np.random.default_rng(2)
    for size in (17, 170, 1700):             # 17 / 20 = 0.85
        apart = []
        for _ in range(300):
            pool = rng.integers(0, 2 ** 63, size * 20 // 17, dtype=np.uint64)
            a, b = np.sort(pool), np.sort(pool[:size])
            sketch = neardup.one_permutation(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), neardup.BITS)
            x, y = neardup.sketch_bits(sketch).view(np.uint64)
            apart.append(sum(int(v).bit_count() for v in x ^ y))
        assert max(apart) <= neardup.bits_for(85) and abs(np.mean(apart) - 512 * 0.075) < 4


def test_near_duplicates_over_odd_rows(frame, odd_rows):
    got = neardup.near_duplicates(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].kept and by[2][0].kept and by[1][0].component_id == 1
    assert by[7][0].component_id == 6 and len(by[7]) == 2 and not by[7][0].kept
    assert by[10][0].component_id == 8 and all(r.component_id is None and r.kept for r in by[None])
    assert neardup.near_duplicates(frame([])).count() == 0


def test_one_of_each_group_stays_with_clashing_columns(frame):
    text = "a b c d e f g h i j"
    docs = frame([(1, text, 1), (2, text, 2), (2, text, 2), (3, "other words in here now", 3), (3, "other words in here now", 4), (None, text, 5)],
                 "doc_id long, text string, component_id int")
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.component_id) for r in kept.collect()) == [(0, 5), (1, 1), (3, 4)]


def test_densified_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2 ** 63, 60, dtype=np.uint64)
    other = np.concatenate((base[:50], rng.integers(0, 2 ** 63, 10, dtype=np.uint64)))
    hashes = np.concatenate((np.sort(base), np.sort(other)))
    sketch = neardup.one_permutation(hashes, np.array([0, 60, 120]), 4000)
    assert abs((sketch[0] == sketch[1]).mean() - 50 / 70) < 0.12


def plain_hits(text, items, window=13):
    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, found = tokens(text), set(), set()
    for i, t in items:
        w = tokens(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            for p in range(len(doc) - n + 1):
                if doc[p:p + n] == w[s:s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(doc), len(hit), sorted(found)


def test_contamination_matches_brute_force(frame, words, odd_rows):
    item = [words(30), words(13), words(20), ["short", "one"], ["single"], words(14)]
    items = [(i, " ".join(w)) for i, w in enumerate(item)] + [(10, None), (11, "..."), (None, "null id item"), (0, " ".join(item[0])), (12, " ".join(item[0][5:]))]
    rows = [(100, " ".join(words(20) + item[0][3:20] + words(30))), (101, " ".join(words(5) + item[1])), (102, "-".join(item[2]).upper()),
            (103, " ".join(item[0][:12] + words(4) + item[0][12:])), (104, "x short one y short, one"), (105, "SINGLE single!"),
            (106, " ".join(item[5] * 3)), (107, " ".join(words(400) + item[1])), (107, " ".join(words(400)))]
    all_rows = rows + [r for r in odd_rows if r[0] not in (8, 10)]
    got = decontam.contamination(frame(all_rows), frame(items, "item_id long, text string")).collect()
    assert len(got) == len(all_rows)
    named = [(i, t) for i, t in items if i is not None]
    want = sorted((i or -1, *plain_hits(t, named)[:2], len(plain_hits(t, named)[2])) for i, t in all_rows)
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_contamination_with_empty_tables(frame):
    none = frame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.contamination(frame([(1, "a b")]), none).collect()] == [False]
    assert decontam.contamination(frame([]), frame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_only_contaminated_rows_go(frame, words):
    item = words(20)
    docs = frame([(1, " ".join(item), "x"), (2, "clean text", "y"), (None, None, "z")], "doc_id long, text string, items string")
    kept = decontam.drop_contaminated(docs, frame([(1, " ".join(item))], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.items for r in kept.collect()) == ["y", "z"]


def plain_repeats(rows, window=50):
    seen, tokens = {}, {}
    for i, t in rows:
        tokens[i] = plain_words(t)
        for s in range(len(tokens[i]) - window + 1):
            g = tuple(tokens[i][s:s + window])
            seen[g] = min(seen.get(g, i), i)
    out = {}
    for i, w in tokens.items():
        gone = {p for s in range(len(w) - window + 1) if seen[tuple(w[s:s + window])] < i for p in range(s, s + window)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def test_repeats_match_brute_force(frame, words):
    a, b, run = words(200), words(120), ["the"] * 130
    period = words(7) * 20
    rows = [(1, " ".join(a)), (2, " ".join(words(30) + a[20:90] + words(30))), (3, " ".join(a[40:89])), (4, " ".join(a[150:] + b)),
            (5, "\n".join(words(3) + b[:50])), (6, " ".join(run)), (7, " ".join(words(4) + run[:70] + words(4))), (8, " ".join(period)),
            (9, " ".join(words(9) + period[3:100])), (10, " ".join(a)), (11, " ".join(a) + " tail"), (12, ""), (13, None),
            (14, " ".join(run[:49])), (15, " ".join(words(2) + a[10:60] + b[60:110] + words(2))), (16, " ".join(a[:50]))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.repeats_removed(frame(rows)).collect()}
    assert got == plain_repeats(rows)


def test_random_splices_match_brute_force(frame, words):
    rng = np.random.default_rng(4)
    pool = [words(140) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(3):
            source = pool[rng.integers(4)]
            s = int(rng.integers(0, 90))
            parts += source[s:s + int(rng.integers(40, 60))] + words(int(rng.integers(0, 8)))
        rows.append((i, " ".join(parts)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.repeats_removed(frame(rows)).collect()}
    assert got == plain_repeats(rows)


def test_repeats_over_odd_rows(frame, odd_rows):
    got = repeats.repeats_removed(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[10].n_removed == 20_000 and by[10].kept_text == "end" and by[8].n_removed == 0 and by[1].kept_text == ""
    assert repeats.repeats_removed(frame([])).count() == 0
