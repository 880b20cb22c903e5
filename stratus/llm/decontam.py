"""Benchmark decontamination by winnowing (DataFrame and SQL functions only).

Words are hashed; of every ``w`` consecutive hashes of ``k``-word runs the least
is a fingerprint, so any shared span of ``w + k - 1`` words shares one.  With
``w + k - 1`` equal to the benchmark window no contaminated span is missed.
Items shorter than the window are one window of their own length; each length
that occurs (at most the window's) gets its own ``k`` and ``w``.

1. Documents keep their distinct fingerprints (about a quarter of the words).
2. Joining them with the benchmark's fingerprints gives candidate documents.
3. Where a candidate's ``k``-word run carries a shared fingerprint, the hit is
   extended word by word to both sides, as far as a window can reach.  If it
   grows to a whole window, its words are hit.
4. Overlapping spans are united per document by a running maximum.

No side is broadcast by hint: the benchmark's fingerprints are written out, so
Spark knows their bytes and picks a broadcast or a shuffle join by its own
threshold.  A fingerprint that a third of all documents share is a skewed key of
a plain join, which adaptive execution splits.  Hashes are 64 bits wide.

Defined results: null texts have no words and no hits; null ids keep their row;
repeated rows are judged alike and all returned; items without words or without
an id are ignored; repeated items count once; an empty benchmark contaminates
nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratus.session import materialize

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text as an array; empty for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() is faster and the same for ASCII texts; others keep their non-ASCII capitals.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.split(low, SEPARATORS)


def with_word_hashes(df: DataFrame, text: str, out: str = "h") -> DataFrame:
    """Add the array of word hashes; empty pieces at either end of the split are no words."""
    df = df.withColumn("_w", words(F.col(text)))
    first, last = F.col("_w")[0] == "", (F.element_at("_w", -1) == "") & (F.size("_w") > 1)
    df = (df.withColumn("_lead", first.cast("int"))
          .withColumn("_n", F.size("_w") - F.col("_lead") - last.cast("int")))
    return (df.withColumn(out, F.transform(F.slice("_w", F.col("_lead") + 1, F.col("_n")), lambda w: F.xxhash64(w)))
            .drop("_w", "_lead", "_n"))


def run_words(length: int) -> int:
    """k: words per hashed run for windows of ``length`` words (w = length - k + 1)."""
    return (length + 1) // 2


def runs(length: int, h: str = "h") -> Column:
    """Hashes of all runs of k consecutive words, in order."""
    k = run_words(length)
    items = ", ".join(f"{h}[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN size({h}) >= {length} THEN "
                  f"transform(sequence(0, size({h}) - {k}), i -> xxhash64({length}, {items})) "
                  f"ELSE cast(array() AS array<bigint>) END")


def winnowed(length: int, g: str) -> Column:
    """Distinct minima of w consecutive run hashes."""
    w = length - run_words(length) + 1
    items = ", ".join(f"{g}[i + {j}]" for j in range(w))
    least = f"least({items})" if w > 1 else items
    return F.expr(f"CASE WHEN size({g}) >= {w} THEN "
                  f"array_distinct(transform(sequence(0, size({g}) - {w}), i -> {least})) "
                  f"ELSE cast(array() AS array<bigint>) END")


def with_fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """From word hashes ``h`` to run hashes ``g<length>`` and all fingerprints ``fps``."""
    for length in lengths:
        df = df.withColumn(f"g{length}", runs(length))
    return df.withColumn("fps", F.concat(*(winnowed(n, f"g{n}") for n in lengths)))


def occurrences(length: int) -> Column:
    """Where runs carry a fingerprint of ``fps``: (length, place, fingerprint, words around it)."""
    k = run_words(length)
    reach = length - k
    around = ", ".join(f"get(h, p + ({j}))" for j in range(-reach, k + reach))
    return F.expr(f"transform(filter(sequence(0, greatest(size(g{length}) - 1, 0)), "
                  f"p -> size(g{length}) > 0 AND array_contains(fps, g{length}[p])), "
                  f"p -> struct({length} AS len, p AS place, g{length}[p] AS fp, array({around}) AS around))")


def with_occurrences(df: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    found = F.concat(*(occurrences(n) for n in lengths))
    return df.select(*keep, F.explode(found).alias("o")).select(*keep, "o.*")


def benchmark_runs(benchmark: DataFrame, window: int) -> tuple[DataFrame | None, list[int]]:
    """(item_id, len, fp, around) of the benchmark's fingerprints, and the window lengths."""
    items = with_word_hashes(
        benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text"), "text")
    items = items.where(F.size("h") > 0)
    lengths = [r[0] for r in items.select(F.least(F.size("h"), F.lit(window))).distinct().collect()]   # <= window rows
    if not lengths:
        return None, []
    parts = []
    for n in sorted(lengths):
        own = items.where(F.least(F.size("h"), F.lit(window)) == n)
        parts.append(with_occurrences(with_fingerprints(own, [n]), [n], ["item_id"]))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return materialize(found.drop("place").distinct(), "benchmark-runs"), sorted(lengths)


def _extension(side: str) -> str:
    """Equal words next to the run, counted outwards until the first difference."""
    walk = ("reverse(slice(eq, 1, reach))" if side == "left" else "slice(eq, k + reach + 1, reach)")
    return f"coalesce(nullif(array_position({walk}, false), 0) - 1, reach)"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated`` per row of ``docs``."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    bench, lengths = benchmark_runs(benchmark, window)
    hashed = with_word_hashes(docs, "text")
    if bench is None:
        light = hashed.select("doc_id", "text_hash", F.size("h").cast("long").alias("n_words"))
        return _report(light, light.select("doc_id", "text_hash").limit(0).withColumns(
            {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")}))
    light = materialize(with_fingerprints(hashed, lengths)
                        .select("doc_id", "text_hash", F.size("h").cast("long").alias("n_words"), "fps"), "fingerprints")
    shared = (light.select("doc_id", "text_hash", F.explode("fps").alias("fp"))
              .join(bench.select("fp").distinct(), "fp", "left_semi"))
    hits = materialize(shared.groupBy("doc_id", "text_hash").agg(F.collect_set("fp").alias("fps")), "candidates")
    key = ["doc_id", "text_hash"]
    d, c = docs.alias("d"), hits.alias("c")
    candidates = (d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))
                         & (F.col("d.text_hash") == F.col("c.text_hash")))
                  .select("d.doc_id", "d.text_hash", "d.text", "c.fps"))
    own = with_word_hashes(candidates, "text")
    for n in lengths:
        own = own.withColumn(f"g{n}", runs(n))
    around = materialize(with_occurrences(own, lengths, key), "occurrences")
    matched = (around.join(bench.withColumnRenamed("around", "other"), ["len", "fp"])
               .withColumn("k", F.expr("(len + 1) div 2")).withColumn("reach", F.col("len") - F.col("k"))
               .withColumn("eq", F.expr("zip_with(around, other, (a, b) -> coalesce(a = b, false))"))
               .withColumn("left", F.expr(_extension("left"))).withColumn("right", F.expr(_extension("right")))
               .where(F.expr("left + k + right >= len AND NOT exists(slice(eq, reach + 1, k), x -> NOT x)"))
               .select(*key, "item_id", (F.col("place") - F.col("left")).alias("s"),
                       (F.col("place") + F.col("k") + F.col("right")).alias("e")))
    spans = materialize(matched.distinct(), "hit-spans")
    before = Window.partitionBy(*key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(F.max("e").over(before), F.lit(0))))
    hit = (spans.select(*key, "s", "e").distinct().withColumn("fresh", fresh)
           .groupBy(*key).agg(F.sum("fresh").cast("long").alias("n_hit")))
    items = spans.groupBy(*key).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    # Equal keys on both sides, null ids included: one aggregate instead of a join.
    found = (hit.withColumn("items", F.lit(None).cast("array<string>"))
             .unionByName(items.withColumn("n_hit", F.lit(None).cast("long")))
             .groupBy(*key).agg(F.max("n_hit").alias("n_hit"), F.max("items").alias("items")))
    return _report(light.drop("fps"), found)


def _report(light: DataFrame, found: DataFrame) -> DataFrame:
    a, b = light.alias("a"), found.alias("b")
    n_hit = F.coalesce("n_hit", F.lit(0))
    items = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return (a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
            .select("a.doc_id", "a.text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                    F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                    ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, unchanged, that are not contaminated."""
    judged = contamination(docs, benchmark, window)
    bad = materialize(judged.where("contaminated").select("doc_id", "text_hash").distinct(), "contaminated")
    d, b = docs.alias("d"), bad.alias("b")
    same = (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("b.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
    return d.join(b, same, "left_anti")
