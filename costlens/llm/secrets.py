"""Secret scan with corpus-wide ownership of every candidate value.

Three base kinds are found by pattern.  On top of them the method looks at the
whole corpus: a value that only one owner has, and that looks random, is a live
credential; a value that several owners have is a copied example.  Long tokens that
no pattern names are reported (kind ``owned``) when they look random and belong to
one owner only.

A repository is a (source, language) pair and an owner is a source, unless other
columns are named.

Defined results: null and empty texts have no spans; null owners count as one
unnamed owner; repeated rows get equal results; an empty table gives no rows; only
the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import stored, whole


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "password|passwd|secret|token|api_?key"
# kind -> pattern, group that carries the value, its least length.
KINDS = {
    "assign": (
        rf"""({_either_case(KEYWORDS)})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
# Only long runs can be dropped here: shorter ones fail the least length anyway.
SCANNED = KINDS | {"hex": (r"[0-9a-f]{24,}", 0, 24)}
# A long token outside the base kinds; the method decides whether it counts.
LOOSE = (r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
EXAMPLE_OWNERS = 2
SALTS = 32

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _spans(text: Column, kind: str, rank: int) -> Column:
    """Places and values of all matches, in code points.

    The text between matches and the matches alternate, so lengths add up to places.
    """
    pattern, group, least = (SCANNED | {"owned": LOOSE})[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern)
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        span = F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            x["value"].alias("value"),
        )
        wanted = F.char_length(x["value"]) >= least
        out = F.when(wanted, F.concat(a["out"], F.array(span).cast(SPAN))).otherwise(a["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    spans = F.aggregate(steps, zero, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def _random_looking(value: Column) -> Column:
    """Letters and digits mixed, and many different characters."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= 10)


def candidates(
    docs: DataFrame, id_col: str, text_col: str, repository: Column, owner: Column
) -> DataFrame:
    """One row per document with its base spans and its loose candidates."""
    text = whole(F.col(text_col))
    base = F.concat(*[_spans(text, kind, i) for i, kind in enumerate(KINDS)])
    loose = F.filter(
        _spans(text, "owned", len(KINDS)), lambda s: _random_looking(s["value"])
    )
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("version"),
        F.sha2(repository.cast("string"), 256).alias("repository"),
        owner.cast("string").alias("owner"),
        F.array_sort(base).alias("base"),
        loose.alias("loose"),
    )
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return found.withColumn("loose", F.filter("loose", apart))


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash: documents, repositories and owners that have it.

    Counted in two steps, so a value copied everywhere is combined before it moves.
    """
    values = F.transform(F.concat("base", "loose"), lambda s: s["value"])
    each = found.select(
        "repository", F.coalesce("owner", F.lit("")).alias("owner"), F.explode(values).alias("value")
    )
    pairs = each.groupBy(F.sha2("value", 256).alias("hash"), "repository", "owner").agg(
        F.count("*").alias("n"), F.max(_random_looking(F.col("value"))).alias("random")
    )
    owners = pairs.groupBy("hash", "owner").agg(
        F.sum("n").alias("n"), F.count("*").alias("repositories"), F.max("random").alias("random")
    )
    return owners.groupBy("hash").agg(
        F.sum("n").alias("n_spans"),
        F.sum("repositories").alias("n_repositories"),
        F.count("*").alias("n_owners"),
        F.max("random").alias("random"),
    )


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository: Column | None = None,
    owner: Column | None = None,
) -> DataFrame:
    """Per document: ``base`` spans, and ``spans`` with the corpus's verdict on each.

    Spans are structs of start, end, kind, value and ``live`` (random-looking and of a
    single owner); ``n_live`` and ``n_example`` count the verdicts.
    """
    repository = F.struct("source", "lang") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    found = stored(candidates(docs, id_col, text_col, repository, owner), "candidates")
    owned = ownership(found)
    # One row per span; a value that is everywhere is spread over SALTS tasks.
    verdict = owned.select(
        "hash",
        (F.col("random") & (F.col("n_owners") < EXAMPLE_OWNERS)).alias("live"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    each = found.where(F.size("base") + F.size("loose") > 0).dropDuplicates(["doc_id", "version"])
    each = each.select("doc_id", "version", F.explode(F.concat("base", "loose")).alias("span"))
    salt = F.pmod(F.xxhash64("doc_id", "version"), F.lit(SALTS)).cast("int")
    each = each.withColumn("hash", F.sha2("span.value", 256)).withColumn("salt", salt)
    judged = each.join(verdict, ["hash", "salt"]).select(
        "doc_id", "version", F.struct("span.*", "live").alias("span")
    )
    own = judged.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    own = own.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    counted = F.filter("spans", lambda s: (s["kind"] != "owned") | s["live"])
    full = found.select("doc_id", "version", "base").join(own, same, "left")
    spans = F.coalesce(counted, F.array().cast(SPAN.replace("value:string", "value:string,live:boolean")))
    return full.select(
        "doc_id",
        "base",
        spans.alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def span_text(spans: Column) -> Column:
    return F.concat_ws(
        ",",
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
    )
