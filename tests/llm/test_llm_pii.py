import hashlib
import re

from llm_fixtures import frame  # noqa: F401

from stratus.llm import pii

ROWS = [
    (1, "mail me: jo.doe+x@mail.example.com or a@b.c.@c.d"), (2, "host 10.0.0.1, not 300.1.1.1, 010.2.3.004 and 1.2.3.4.5.6.7.8"),
    (3, "pay 4111 1111 1111 1111 or 4111-1111-1111-1111, not 4111 1111 1111 1112"), (4, "call +49 (0)151 234-5678 now, +1 22"),
    (5, "é🙂 a@b.co +4111111111111111 x"), (6, None), (7, ""), (8, "nothing here"), (8, "nothing here"), (None, "x@y.zz"),
    (9, "9" * 30_000 + " a@" + "a." * 20_000 + "b " + "x" * 30_000 + "@y"),
]


def plain(text):
    text, out = text or "", []

    def luhn(d):
        values = [int(c) for c in reversed(d)]
        return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if len(text) < 50_000 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_match_plain_python(frame):
    got = pii.personal_data(frame(ROWS)).collect()
    assert len(got) == len(ROWS)
    want = {i: plain(t) for i, t in ROWS if i != 9}
    for r in got:
        if r.doc_id == 9:
            assert r.n_email == 1 and r.n_card == 0
            continue
        assert r.base_sha256 == hashlib.sha256(written(want[r.doc_id]).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want[r.doc_id]) for i in range(4)]
        assert set(filter(None, written(want[r.doc_id]).split(","))) <= set(r.spans.split(","))


def test_documents_table_matches_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id].base_sha256 == hashlib.sha256(written(plain(r.text)).encode()).hexdigest()


def test_redaction_and_extra_columns(frame):
    docs = frame([(1, "a@b.co and +49 151 2345678!", 5), (2, None, 6), (3, "plain", 7)], "doc_id long, text string, spans long")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "<EMAIL> and <PHONE>!" and got[2].text is None and got[3].text == "plain" and got[3].spans == 7


def test_trees_add_cards_inside_digit_runs(frame):
    good = ["4111111111111111", "5500005555555559", "4012888888881881"]
    rows = [(i, f"word {good[i % 3]} tail number {i}") for i in range(60)]
    rows += [(100 + i, f"word 41111111111{i:05d} tail") for i in range(60)]
    rows += [(300, "word 12345678 4111111111111111 tail")]
    got = {r.doc_id: r for r in pii.personal_data(frame(rows)).collect()}
    assert all(got[i].n_card == 1 for i in range(60))
    base = {i for i in got if got[i].n_card}
    assert all(got[i].spans for i in base)


def spans_of(text, kind, part):
    at = text.index(part)
    return f"{kind}:{at}:{at + len(part)}"


def test_spelled_out_addresses_and_separated_numbers_are_added(frame):
    rows, want = [], {}
    for i in range(60):
        cards = ["4111.1111.1111.1111", "5500.0055.5555.5559", "4012.8888.8888.1881"]
        for j, (kind, part, text) in enumerate([
                ("email", f"jane{i} [at] example [dot] com", "note from {} on day two"),
                ("card", cards[i % 3], "he paid with {} on day two"),
                ("phone", f"0151 23 45 {100 + i}", "her phone is {} on day two")]):
            rows.append((10 * i + j, text.format(part)))
            want[10 * i + j] = spans_of(rows[-1][1], kind, part)
        rows += [(10 * i + 5, f"bob{i}@mail.example.com and +49 151 2345{100 + i}, 4111111111111111"),
                 (10 * i + 6, f"order {7000000000 + 13 * i} of item {i}"), (10 * i + 7, f"paid 4111.1111.1111.1{200 + i} to")]
    luhn_bad = {i for i, t in rows if i % 10 == 7 and not any(k == 2 for _, k, _ in plain(t.replace(".", "")))}
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(rows)).collect()}
    assert {i: got[i] for i in want} == want
    assert all(got[i] == "" for i in got if i % 10 == 6)              # clean numbers
    assert len(luhn_bad) > 40 and all("card" not in got[i] for i in luhn_bad)


def test_addresses_alone_are_added(frame):
    text = "ask jane [at] example [dot] com now"
    got = pii.personal_data(frame([(1, text)])).collect()
    assert [r.spans for r in got] == [spans_of(text, "email", "jane [at] example [dot] com")]


def test_documents_with_one_loose_span_only_propose_it(frame):
    rows = [(1, "jane [at] example.com", "email"), (2, "mail jane at example.com", "email"),
            (3, "06 12 34 56 78", "phone"), (4, "10 . 0 . 0 . 1", "ip"), (5, "nothing here", None)]
    docs = pii.with_base_spans(frame([r[:2] for r in rows]))
    got = {(r.doc_id, pii.KINDS[r.k]) for r in pii.proposals(docs, ["doc_id"]).collect()}
    assert got == {(i, kind) for i, _, kind in rows if kind}


def test_empty_table(frame):
    assert pii.personal_data(frame([])).count() == 0
