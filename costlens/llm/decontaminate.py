"""Benchmark decontamination by winnowing.

A fingerprint is the smallest hash of ``GRAM`` words in a sliding window of
``SLIDE`` such grams.  ``GRAM + SLIDE - 1`` equals ``SPAN``, so every shared run of
``SPAN`` words holds one whole window and therefore leaves the same fingerprint on
both sides.  Documents that share a fingerprint are extended: the span of words
around each shared gram is compared word by word with the benchmark's spans.

Benchmark items shorter than ``SPAN`` count as one span of their own length; they
have no window, so every gram of that length (there are fewer than ``SPAN``
lengths) serves as a fingerprint.

Defined results: null and empty texts have no words, no hits and are clean; an
item without words is skipped, as is an item without id; repeated rows get equal
results; an empty benchmark leaves everything clean; only the named columns are
read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import as_row, ascii_lower, let, of_row, pieces, stored, whole

SPAN = 13
GRAM = 6
SLIDE = SPAN - GRAM + 1
# What is not a digit, a-z or beyond ASCII separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return pieces(ascii_lower(whole(text)), GAP)


def _grams(words: Column, n: int) -> Column:
    """Hash of each run of ``n`` words, by its first word's position."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(
        starts, lambda w, i: F.xxhash64(F.lit(n), w, *[F.get(words, i + k) for k in range(1, n)])
    )


def _winnowed(words: Column) -> Column:
    """The smallest gram hash of every window of ``SLIDE`` grams, each once."""

    def smallest(grams: Column) -> Column:
        starts = F.slice(grams, F.lit(1), F.greatest(F.size(grams) - (SLIDE - 1), F.lit(0)))
        nexts = lambda i: [F.get(grams, i + k) for k in range(1, SLIDE)]
        return F.array_distinct(F.transform(starts, lambda h, i: F.least(h, *nexts(i))))

    return let(_grams(words, GRAM), smallest)


def _spans(words: Column) -> Column:
    """An item's spans: all runs of ``SPAN`` words, or the whole item if shorter."""
    count = F.greatest(F.size(words) - SPAN + 1, F.lit(1))
    return F.transform(
        F.sequence(F.lit(1), count), lambda i: F.concat_ws(" ", F.slice(words, i, SPAN))
    )


def _benchmark(benchmark: DataFrame, item_col: str, text_col: str):
    """Spans by item, the spans' fingerprints, and the lengths below ``SPAN`` in use."""
    items = benchmark.select(
        F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words")
    ).where((F.size("words") > 0) & F.col("item_id").isNotNull())
    spans = stored(
        items.select("item_id", F.explode(_spans(F.col("words"))).alias("span")).distinct(),
        "spans",
    )
    span_words = F.split("span", " ")
    lengths = spans.select(F.size(span_words).alias("n")).distinct()
    short = sorted(r.n for r in lengths.where(F.col("n") < SPAN).collect())  # under SPAN values
    prints = F.when(F.size(span_words) == SPAN, _winnowed(span_words))
    for n in short:
        prints = prints.when(F.size(span_words) == n, _grams(span_words, n))
    found = spans.select(F.explode(prints).alias("print")).distinct()
    return spans, stored(found, "prints"), short


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: its words, the words inside benchmark spans, and the items hit.

    A document is told apart by id and text, so repeated ids do no harm.
    """
    spans, prints, short = _benchmark(benchmark, item_col, item_text_col)
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("version"),
        words_of(F.col(text_col)).alias("words"),
    )
    key = ["doc_id", "version"]
    words = F.col("words")
    fingerprints = F.concat(_winnowed(words), *[_grams(words, n) for n in short])
    base = stored(
        own.select(*key, F.size("words").cast("long").alias("n_words"), fingerprints.alias("prints")),
        "fingerprints",
    )
    shared = (
        base.select(*key, F.explode("prints").alias("print"))
        .join(prints, "print", "left_semi")
        .groupBy(*key)
        .agg(F.collect_set("print").alias("shared"))
    )
    # Written first: the planner then knows whether it is small next to the texts.
    shared = stored(shared, "shared")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["version"] == b["version"])
    suspects = (
        own.join(shared, same(own, shared))
        .select(own["doc_id"], own["version"], "words", "shared")
        .dropDuplicates(key)
    )
    hits = stored(_extended(suspects, key, short).join(spans.select("span").distinct(), "span"), "hits")
    covered = _covered(hits, key)
    items = (
        hits.select(*key, "span")
        .distinct()
        .join(spans, "span")
        .groupBy(*key)
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )
    both = covered.join(items, same(covered, items)).select(
        covered["doc_id"], covered["version"], "n_hit", "items"
    )
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return base.join(both, same(base, both), "left").select(
        base["doc_id"],
        base["version"],
        "n_words",
        n_hit.alias("n_hit"),
        F.array_sort(F.coalesce("items", none)).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _extended(suspects: DataFrame, key: list[str], short: list[int]) -> DataFrame:
    """Every run of words around a shared gram that could be a benchmark span."""
    words, shared = F.col("words"), F.col("shared")

    def around(n: int, gram: int) -> Column:
        """Spans of ``n`` words that contain a shared gram of ``gram`` words."""
        at = F.filter(
            F.transform(
                _grams(words, gram), lambda h, i: F.when(F.array_contains(shared, h), i)
            ),
            lambda i: i.isNotNull(),
        )
        last = F.size(words) - n
        first = F.flatten(
            F.transform(
                at,
                lambda i: F.filter(
                    F.transform(F.sequence(F.lit(0), F.lit(n - gram)), lambda k: i - k),
                    lambda s: (s >= 0) & (s <= last),
                ),
            )
        )
        return F.transform(
            F.array_distinct(first), lambda s: F.struct(s.alias("start"), F.lit(n).alias("n"))
        )

    runs = F.concat(around(SPAN, GRAM), *[around(n, n) for n in short])
    placed = suspects.select(*key, "words", F.inline(runs))
    span = F.concat_ws(" ", F.slice(words, F.col("start") + 1, F.col("n")))
    return placed.select(*key, "start", "n", span.alias("span"))


def _covered(hits: DataFrame, key: list[str]) -> DataFrame:
    """Words inside the union of a document's hits."""
    ends = F.struct(F.col("start"), (F.col("start") + F.col("n")).alias("end"))
    runs = hits.groupBy(*key).agg(F.array_sort(F.collect_set(ends)).alias("runs"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    union = F.aggregate(
        "runs",
        zero,
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], r["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    return runs.select(*key, union.alias("n_hit"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The clean rows of ``docs`` with all their columns."""
    judged = contamination(docs, benchmark, text_col=text_col).where("contaminated")
    dirty = judged.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    rows = docs.select(as_row(docs), F.col("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("version"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    return rows.join(stored(dirty, "contaminated"), same, "left_anti").select(*of_row(docs))
