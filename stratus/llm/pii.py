"""Personal data: candidate gradient boosting over rule spans (DataFrame and SQL functions only).

Base rules find e-mail addresses, IP addresses, card numbers and phone numbers with
regular expressions and validate them; these spans always stay.  High-recall
generators then propose further, overlapping spans: spelled-out addresses, and every
longer run of digits as card and as phone number, every dotted quad.  A proposal must
be valid in its normalised form ('[at]', '[dot]' and separators undone, then checks
like those of the base rules).  Boosted trees score the valid proposals from their
format and from the text around them; per kind, the cut-off is the least score at
which the proposals that touch no base span are right often enough.  Those above it
that touch no better proposal are added.

The trees learn from a bounded number of proposals (``TRAIN_ROWS``, lowest text
hashes first, one fold in ``FOLDS`` left out).  A label says that the span is a base
span, or that its form or the text around it speaks for its kind (:func:`verdict`);
no feature restates the checks.  Proposals outside that sample, all of them, set the
cut-offs (of a kind that has none there, those of the sample).

Regular expressions use possessive repeats and start at the head of a run, so they
match what the plain forms match, in linear time and constant stack, however long
the text.  Matches are found per document and only when a cheap test says that there
can be any.

Defined results: null and empty texts have no spans; null ids and repeated rows give
one row each; an empty table gives no rows; where all proposals are labelled right all
are above the cut-off, where none is, none; other columns are ignored (kept by :func:`redact`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.session import materialize, shared_dir

KINDS = ["email", "ip", "card", "phone"]
TRAIN_ROWS = 20_000
TREES = 20
DEPTH = 3
FOLDS = 5
#: Share of the proposals above a cut-off that must be labelled right.
PRECISION = 0.98
LEAST_SCORE = 0.5

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[\[(]at[\])]|\x20at\x20)\x20?"
             r"[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9])[0-9]{1,4}+(?:\x20?\.\x20?[0-9]{1,4}+){3}(?![0-9])",
    "number": r"(?<![0-9A-Za-z.+])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}+(?![0-9])",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Words that often stand before a span of each kind.
CUES = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|visa|credit|pay",
        "phone": "phone|tel|call|fax|mobil"}
#: What is read as '@' and as '.' in a spelled-out address.
AT = r"\x20?(?:@|[\[(]at[\])]|\x20at\x20)\x20?"
DOT = r"\x20?[\[(]dot[\])]\x20?|\x20dot\x20"
ADDRESS = r"^[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+\.)+[A-Za-z]{2,}$"
#: Phone numbers without '+': an area code in brackets, a trunk zero before groups, three-three-four.
PHONE = r"\([0-9]+\)|^0[0-9]{1,4}(?:[\x20().-]{1,2}[0-9]{2,4}){2,}$|^[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}$"
DATE = r"(?<![0-9])(?:[0-9]{1,2}[\x20.-][0-9]{1,2}[\x20.-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[\x20.-][0-9]{1,2}[\x20.-][0-9]{1,2})(?![0-9])"


def _matches(df: DataFrame, name: str, pattern: str, possible: Column) -> DataFrame:
    """Add the matches of a pattern, the text between them, and where they start (code points)."""
    none = F.array().cast("array<string>")
    df = (df.withColumn(f"{name}_m", F.when(possible, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
          .withColumn(f"{name}_g", F.when(F.size(f"{name}_m") > 0, F.split("text", pattern)).otherwise(none)))
    m, g = f"{name}_m", f"{name}_g"
    return df.withColumn(f"{name}_s", F.expr(
        f"CASE WHEN size({m}) = 0 THEN cast(array() AS array<bigint>) ELSE "
        f"aggregate(sequence(0, size({m}) - 1), named_struct('pos', 0L, 'at', cast(array() AS array<bigint>)), "
        f"(a, i) -> named_struct('pos', a.pos + char_length({g}[i]) + char_length({m}[i]), "
        f"'at', concat(a.at, array(a.pos + char_length({g}[i])))), a -> a.at) END"))


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: whether a string of at most 19 digits passes the check."""
    return (f"aggregate(sequence(0, char_length({digits}) - 1), 0, (a, i) -> a + "
            f"CASE WHEN i % 2 = 0 THEN cast(substr({digits}, char_length({digits}) - i, 1) AS int) "
            f"ELSE 2 * cast(substr({digits}, char_length({digits}) - i, 1) AS int) "
            f"- CASE WHEN substr({digits}, char_length({digits}) - i, 1) > '4' THEN 9 ELSE 0 END END) % 10 = 0")


def _valid(kind: str, t: str) -> str:
    d = _digits(t)
    return {"email": "true",
            "ip": f"{t} RLIKE '^{OCTET}([.]{OCTET}){{3}}$'",
            "card": f"CASE WHEN char_length({d}) BETWEEN 12 AND 19 THEN {luhn(d)} ELSE false END",
            "phone": f"char_length({d}) BETWEEN 9 AND 15"}[kind]


def with_base_spans(docs: DataFrame) -> DataFrame:
    """Add ``base``: the validated spans (s, k, e, t) by start, then kind; ``text`` must not be null."""
    digit = F.col("text").rlike("[0-9]")
    possible = {"email": F.contains("text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("text", F.lit("+"))}
    df, parts = docs, []
    for k, kind in enumerate(KINDS):
        df = _matches(df, f"_{kind}", BASE[kind], possible[kind])
        m, s = f"_{kind}_m", f"_{kind}_s"
        parts.append(F.expr(
            f"filter(transform({m}, (t, i) -> named_struct('s', {s}[i], 'k', {k}, 'e', {s}[i] + char_length(t), 't', t)), "
            f"x -> {_valid(kind, 'x.t')})"))
    return df.withColumn("base", F.array_sort(F.concat(*parts))).drop(*(f"_{k}_{p}" for k in KINDS for p in "mgs"))


def proposals(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Valid loose spans with the text around them: ``keep`` + (k, s, e, t, before, after, own, touches, label).

    ``own``: is a base span; ``touches``: overlaps one; ``label``: the :func:`verdict`.
    """
    # Each test holds wherever its pattern matches.
    digit = F.col("text").rlike("[0-9]")
    possible = {"email": F.col("text").rlike(r"@|[\[(]at[\])]|\x20at\x20"), "ip": digit, "number": digit}
    df, parts = docs.where(possible["email"] | digit), []
    for name, pattern in LOOSE.items():
        df = _matches(df, f"_{name}", pattern, possible[name])
        m, g, s = f"_{name}_m", f"_{name}_g", f"_{name}_s"
        for kind in {"email": ["email"], "ip": ["ip"], "number": ["card", "phone"]}[name]:
            parts.append(F.expr(
                f"transform({m}, (t, i) -> named_struct('k', {KINDS.index(kind)}, 's', {s}[i], 'e', {s}[i] + char_length(t), "
                f"'t', t, 'before', right({g}[i], 24), 'after', left({g}[i + 1], 8)))"))
    each = df.select(*keep, "base", F.explode(F.concat(*parts)).alias("c"))
    own = F.exists("base", lambda b: (b["k"] == F.col("c.k")) & (b["s"] == F.col("c.s")) & (b["e"] == F.col("c.e")))
    touches = F.exists("base", lambda b: (b["s"] < F.col("c.e")) & (F.col("c.s") < b["e"]))
    each = each.select(*keep, "c.*", own.alias("own"), touches.alias("touches")).withColumn("norm", normalised())
    kind_valid = reduce(lambda a, k: a.when(F.col("k") == k, F.expr(_valid(KINDS[k], "norm"))), (1, 2, 3),
                        F.when(F.col("k") == 0, F.col("norm").rlike(ADDRESS)))
    return each.where(F.col("own") | kind_valid).withColumn("label", verdict().cast("double")).drop("norm")


def normalised() -> Column:
    """A proposal with spelled-out signs and separators undone."""
    t, k = F.col("t"), F.col("k")
    return (F.when(k == 0, F.regexp_replace(F.regexp_replace(t, AT, "@"), DOT, "."))
            .when(k == 1, F.replace(t, F.lit(" "), F.lit(""))).otherwise(F.regexp_replace(t, "[^0-9]", "")))


def verdict() -> Column:
    """Whether a valid proposal is a base span, or its form or the text around it speaks for its kind."""
    t, k, before, after = (F.col(c) for c in ("t", "k", "before", "after"))
    cue = {kind: F.lower(before).rlike(words) for kind, words in CUES.items()}
    apart = ~before.rlike("[0-9A-Za-z_=]$") & ~after.rlike("^[0-9A-Za-z_=]")
    email = t.rlike(r"@|[\[(]at[\])]") | t.rlike(DOT) | cue["email"]
    ip = ~before.rlike(r"[0-9]\x20?\.\x20?$") & ~after.rlike(r"^\x20?\.\x20?[0-9]") & (~F.contains(t, F.lit(" ")) | cue["ip"])
    card = cue["card"] | ~cue["phone"]
    phone = cue["phone"] | (t.rlike(PHONE) & ~t.rlike(DATE) & ~cue["card"])
    return F.col("own") | (apart & F.when(k == 0, email).when(k == 1, ip).when(k == 2, card).otherwise(phone))


def with_features(candidates: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context of proposals as numbers."""
    t, before, after = F.col("t"), F.col("before"), F.col("after")
    n = F.char_length(t)
    made = {f"is_{kind}": F.col("k") == i for i, kind in enumerate(KINDS)}
    made |= {
        "length": n,
        "letters": F.char_length(F.regexp_replace(t, "[^A-Za-z]", "")),
        "spaces": n - F.char_length(F.replace(t, F.lit(" "), F.lit(""))),
        "dots": n - F.char_length(F.replace(t, F.lit("."), F.lit(""))),
        "groups": F.size(F.split(t, "[^0-9A-Za-z]+")),
        "last_group": F.char_length(F.regexp_extract(t, "([0-9A-Za-z]+)$", 1)),
        "first_group": F.char_length(F.regexp_extract(t, "([0-9A-Za-z]+)", 1)),
        "has_bracket": t.rlike(r"[\[(]"), "leading_zero": t.rlike("^[(]?0"),
        "joined_before": before.rlike("[0-9A-Za-z_=]$"), "joined_after": after.rlike("^[0-9A-Za-z_=]"),
        "quoted": before.rlike("[\"'=]\\s*$"), "digits_before": F.char_length(F.regexp_replace(before, "[^0-9]", "")),
    }
    made |= {f"cue_{kind}": F.lower(before).rlike(words) for kind, words in CUES.items()}
    return candidates.withColumns({f"f_{k}": v.cast("double") for k, v in made.items()}), [f"f_{k}" for k in made]


def scored_proposals(docs: DataFrame, keep: list[str], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Valid proposals with ``score`` and ``chosen``."""
    shared_dir(docs.sparkSession)
    rows, names = with_features(proposals(docs, keep))
    rows = materialize(rows.withColumn("h", F.xxhash64("t", "before", "after", "k")), "pii-proposals")
    order = [F.col(c) for c in ("h", "t", "before", "after", "k", "label")]
    learn = F.pmod("h", F.lit(FOLDS)) != 0
    # At most train_rows rows: one partition, so that the fit sees them in one order.
    sample = rows.where(learn).select(*names, "label", *(c for c in ("h", "t", "before", "after", "k"))).orderBy(*order).limit(train_rows)
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    sample = materialize(sample.coalesce(1), "pii-training")
    seen = sample.agg(F.max("h").alias("last"), F.min("label").alias("least"), F.max("label").alias("most")).first()
    if seen["least"] != seen["most"]:
        trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=11,
                              minInstancesPerNode=4).fit(assembler.transform(sample))
        rows, score = trees.transform(assembler.transform(rows)), F.round(vector_to_array("probability")[1], 3)
    else:       # nothing to tell apart: the proposals' only label, or without a sample each one's own
        score = F.col("label") if seen["last"] is None else F.lit(seen["least"])
    trained = learn & (F.col("h") <= F.lit(seen["last"])) if seen["last"] is not None else F.lit(False)
    scored = rows.select(*keep, "k", "s", "e", "own", "touches", "label", trained.alias("trained"), score.alias("score"))
    scored = materialize(scored, "pii-scored")
    # Of what can be added, two rows per kind and thousandth.
    bins = (scored.where("NOT touches").groupBy("k", "trained", "score")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("right")).toPandas())
    chosen = []
    for k in range(len(KINDS)):
        own = bins[bins["k"] == k]
        own = own[~own["trained"]] if not own["trained"].all() else own
        own = own.sort_values("score", ascending=False)
        exact = own["right"].cumsum() / own["n"].cumsum() >= PRECISION
        good = own["score"][exact & (own["score"] >= LEAST_SCORE)]
        chosen.append((F.col("k") == k) & (F.col("score") >= (float(good.min()) if len(good) else 2.0)))
    return scored.withColumn("chosen", reduce(lambda a, b: a | b, chosen))


def with_spans(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text_hash, base, spans`` per row: arrays of (s, k, e), by start, then kind."""
    key = ["doc_id", "text_hash"]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    based = with_base_spans(docs)
    light = materialize(based.select(*key, F.transform("base", lambda x: F.struct(x["s"], x["k"], x["e"])).alias("base")), "pii-base")
    scored = scored_proposals(based, key, train_rows)
    extra = materialize(scored.where("chosen AND NOT touches").select(*key, F.struct("s", "k", "e", "score").alias("x")).distinct()
                        .groupBy(*key).agg(F.collect_list("x").alias("extra")), "pii-extra")
    a, b = light.alias("a"), extra.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    return both.select("a.doc_id", "a.text_hash", "base", F.coalesce("extra", F.array().cast("array<struct<s:bigint,k:int,e:bigint,score:double>>")).alias("extra")).withColumn(
        "spans", F.expr(
            "array_sort(concat(base, transform(filter(extra, x -> NOT exists(base, b -> b.s < x.e AND x.s < b.e) "
            "AND NOT exists(extra, y -> y.s < x.e AND x.s < y.e AND "
            "(y.score > x.score OR (y.score = x.score AND named_struct('s', y.s, 'k', y.k, 'e', y.e) < named_struct('s', x.s, 'k', x.k, 'e', x.e))))), "
            "x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))))")).drop("extra")


def _written(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({kinds})[x.k], ':', x.s, ':', x.e)), ',')"


def personal_data(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id``, base counts per kind, ``base_sha256`` and ``spans`` (kind:start:end) per row."""
    found = with_spans(docs, train_rows)
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) AS bigint)").alias(f"n_{kind}")
              for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(_written("base")), 256).alias("base_sha256"),
                        F.expr(_written("spans")).alias("spans"))


def redact(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` with each stretch of personal data replaced by its kind, as in ``<EMAIL>``.

    Overlapping spans are one stretch, named after the first.  Null texts stay null.
    """
    found = with_spans(docs, train_rows).where(F.size("spans") > 0).select("doc_id", "text_hash", "spans")
    spans = materialize(found.distinct(), "pii-spans")
    d, s = docs.alias("d"), spans.alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("s.text_hash"))
    kinds = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    cut = F.expr(
        "CASE WHEN s.spans IS NULL THEN d.text ELSE aggregate(s.spans, "
        "named_struct('pos', 0L, 'out', cast(array() AS array<string>)), "
        "(a, x) -> CASE WHEN x.s >= a.pos THEN named_struct('pos', x.e, 'out', concat(a.out, "
        f"array(substr(d.text, cast(a.pos + 1 AS int), cast(x.s - a.pos AS int)), array({kinds})[x.k]))) "
        "ELSE named_struct('pos', greatest(a.pos, x.e), 'out', a.out) END, "
        "a -> concat(array_join(a.out, ''), substr(d.text, cast(a.pos + 1 AS int)))) END")
    return d.join(s, same, "left").select(*(cut.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))
