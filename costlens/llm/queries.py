"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.llm import (
    bpe,
    chat,
    decontaminate,
    jaccard,
    periodic,
    prefix_trie,
    quality_fm,
    quality_rules,
    repair,
    secrets,
    sketch,
    templates,
    warc,
)
from costlens.llm.common import BLANKS, let, pieces, table, whole


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )


def _two_answers(conversations: DataFrame) -> DataFrame:
    """Turns of both sides: every conversation as it is, and with the last assistant turn's
    text replaced by that of the neighbouring conversation (id with the last bit flipped)."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text")
    )
    is_answer = F.col("role") == chat.TRAINED_ROLE
    last = Window.partitionBy("conv_id", is_answer).orderBy(F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"))
    turns = turns.where(F.col("conv_id").isNotNull())
    turns = turns.withColumn("answers", is_answer & (F.row_number().over(last) == 1))
    other = turns.where("answers").select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("text").alias("other"))
    swapped = turns.where("answers").drop("text").join(other, "conv_id", "left").withColumnRenamed("other", "text")
    columns = ["conv_id", "turn", "role", "text"]
    rejected = turns.where("not answers").select(*columns).union(swapped.select(*columns))
    return turns.select(*columns, F.lit(True).alias("chosen")).union(rejected.select(*columns, F.lit(False)))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names no preference: a conversation is chosen over itself with another's last answer."""
    turns = _two_answers(table(spark, sf_dir, "conversations"))
    found = chat.format_preferences(turns, F.col("conv_id"), F.col("chosen"))
    return found.select(
        *[c for c in found.columns if not c.endswith("_mask")],
        chat.mask_text(F.col("chosen_mask")).alias("chosen_mask"),
        chat.mask_text(F.col("rejected_mask")).alias("rejected_mask"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality_rules.fails(quality_rules.BASE).alias("base_failed"),
        (~quality_rules.fails(quality_rules.STANDARD)).alias("kept"),
        "n_lines",
        "fail_bits",
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(spark, sf_dir).drop("url")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = templates.clean(table(spark, sf_dir, "documents"))
    return done.select(
        "row.doc_id",
        "cleaned.n_recurring",
        "cleaned.n_dropped",
        F.char_length("cleaned.clean").cast("long").alias("n_chars_kept"),
        F.sha2("cleaned.clean", 256).alias("clean_sha256"),
    )


def op10_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.write_and_read(table(spark, sf_dir, "documents"))


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Every tenth document (by the CRC-32 of its id) repeats a stretch of its words from some place on."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    shift = F.floor(code / 10)

    def repeated(words):
        n = F.size(words)
        a = (shift % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + shift % 8))).cast("int")
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, source(i)))
        return F.when(n > 0, F.array_join(made, " "))

    changed = F.when(code % 10 == 0, let(pieces(whole(F.col("text")), BLANKS), repeated))
    return docs.select("doc_id", F.coalesce(changed, "text").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_with_periodic_tails(table(spark, sf_dir, "documents")))
    best = F.col("best")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.withColumn("best", periodic.longest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def _with_shared_beginnings(conversations: DataFrame) -> DataFrame:
    """Every conversation c begins with the first turns of conversation c - c % 5."""
    conv = F.col("conv_id").cast("long")
    lists = prefix_trie.turn_lists(conversations, conv - conv % 5)
    near = lists.groupBy("together").agg(F.collect_list(F.struct("conv_id", "turns")).alias("near"))
    head = F.get(F.filter("near", lambda x: x["conv_id"] == F.col("together")), F.lit(0))["turns"]
    none = F.array().cast(prefix_trie.TURNS)
    each = near.select(F.coalesce(head, none).alias("head"), F.explode("near").alias("own"))
    h = (F.crc32(F.col("own.conv_id").cast("string").cast("binary")) % 9).cast("int")
    own, n = F.col("own.turns"), F.size("own.turns")
    rest = F.when(n > h, F.slice(own, h + 1, n - h)).otherwise(none)
    return each.select("own.conv_id", F.concat(F.slice("head", F.lit(1), h), rest).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_with_shared_beginnings(table(spark, sf_dir, "conversations")))


def op13_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.with_next(table(spark, sf_dir, "documents"))
    found = found.withColumn("edited", sketch.edited(F.col("text"), F.col("next_text")))
    found = found.withColumn("edited_print", sketch.fingerprint(sketch.sketch(F.col("edited"))))
    own, other, following = (sketch.hashes_of(F.col(c)) for c in ("print", "edited_print", "next_print"))
    return found.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        sketch.likeness(own, other).alias("near_edited"),
        sketch.likeness(own, following).alias("near_next"),
        sketch.containment(own, other).alias("contained_edited"),
        sketch.containment(own, following).alias("contained_next"),
    )


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_preference_format": op2_preference_format,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_warc_index": op7_warc_index,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_repair_shards": op10_repair_shards,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_scaled_sketch": op13_scaled_sketch,
}

# -- SQL ---------------------------------------------------------------------------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FOUND = {kind: (pattern.replace("'", "''"), group, least) for kind, (pattern, group, least) in
          {**secrets.KINDS, "owned": secrets.LOOSE}.items()}


def _sql_spans(rank: int, kind: str) -> str:
    """All matches of a kind: gaps and matches alternate, so lengths add up to places."""
    pattern, group, least = _FOUND[kind]
    return f"""
    SELECT r, {rank} AS rank, '{kind}' AS kind, values[i] AS value,
      list_sum(list_transform(gaps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s,
      length(hits[i]) AS n
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(t, '{pattern}', 0) AS hits,
        regexp_extract_all(t, '{pattern}', {group}) AS values,
        string_split_regex(t, '{pattern}') AS gaps
      FROM d WHERE regexp_matches(t, '{pattern}')))
    WHERE length(values[i]) >= {least}"""


ORACLE_SQL = {
    "op1_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang, source FROM documents),
base AS ({" UNION ALL ".join(_sql_spans(i, k) for i, k in enumerate(secrets.KINDS))}),
random AS (SELECT DISTINCT value, regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND len(list_distinct(string_split(value, ''))) >= 10 AS random
  FROM (SELECT value FROM base UNION ALL SELECT value FROM ({_sql_spans(3, "owned")}))),
loose AS (SELECT o.* FROM ({_sql_spans(3, "owned")}) o JOIN random USING (value)
  WHERE random AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = o.r AND b.s < o.s + o.n AND o.s < b.s + b.n)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
owners AS (SELECT value, count(DISTINCT coalesce(source, '')) AS n_owners FROM spans JOIN d USING (r) GROUP BY value),
judged AS (SELECT spans.*, random AND n_owners < {secrets.EXAMPLE_OWNERS} AS live
  FROM spans JOIN owners USING (value) JOIN random USING (value)),
counted AS (SELECT r,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, rank) FILTER (kind <> 'owned') AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, rank)
      FILTER (kind <> 'owned' OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live AND kind <> 'owned') AS n_example
  FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN counted USING (r)""",
    "op2_preference_format": """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER
    (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(n) FILTER (role = 'assistant') AS final FROM o GROUP BY conv_id),
answer AS (SELECT o.conv_id, o.text FROM o JOIN last ON last.conv_id = o.conv_id AND n = final),
t AS (SELECT conv_id AS pair_id, 0 AS side, role, text, n FROM o
  UNION ALL SELECT o.conv_id, 1, role, CASE WHEN n = final THEN coalesce(a.text, '') ELSE o.text END, n
  FROM o JOIN last ON last.conv_id = o.conv_id LEFT JOIN answer a ON a.conv_id = xor(o.conv_id, 1)),
c AS (SELECT * FROM t WHERE side = 0), r AS (SELECT * FROM t WHERE side = 1),
p AS (SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr
  FROM t GROUP BY pair_id HAVING nc > 0 AND nr > 0),
same AS (SELECT pair_id, c.n FROM c JOIN r USING (pair_id, n) WHERE c.role = r.role AND c.text = r.text),
shared AS (SELECT pair_id, nc, nr, (SELECT count(*) FROM same s WHERE s.pair_id = p.pair_id
    AND NOT EXISTS (SELECT 1 FROM range(1, s.n) g(i) WHERE NOT EXISTS
      (SELECT 1 FROM same x WHERE x.pair_id = s.pair_id AND x.n = g.i))) AS k FROM p),
told AS (SELECT t.*, k, '<|' || role || '|>' || chr(10) AS head,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said FROM t JOIN shared USING (pair_id)),
placed AS (SELECT *, sum(length(said)) OVER (PARTITION BY pair_id, side ORDER BY n) AS stop FROM told WHERE n > k),
sides AS (SELECT pair_id, side, string_agg(said, '' ORDER BY n) AS said,
    string_agg((stop - length(said) + length(head))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY n)
      FILTER (role = 'assistant') AS mask
  FROM placed GROUP BY pair_id, side),
prompts AS (SELECT pair_id, string_agg(said, '' ORDER BY n) AS prompt FROM told WHERE side = 0 AND n <= k GROUP BY pair_id)
SELECT pair_id, k AS n_prompt_turns, nc - k AS n_chosen_turns, nr - k AS n_rejected_turns,
  coalesce(prompt, '') AS prompt, coalesce(a.said, '') AS chosen, coalesce(b.said, '') AS rejected,
  nc = k AND nr = k AS identical, coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask
FROM shared LEFT JOIN prompts USING (pair_id)
LEFT JOIN (SELECT * FROM sides WHERE side = 0) a USING (pair_id)
LEFT JOIN (SELECT * FROM sides WHERE side = 1) b USING (pair_id)""",
    "op3_decontamination": rf"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
spans AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS span
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM spans),
runs AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths)),
hits AS (SELECT r, i, n, span FROM runs WHERE span IN (SELECT span FROM spans)),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items
  FROM (SELECT DISTINCT r, span FROM hits) JOIN spans USING (span) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN found USING (r)""",
    "op4_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT r, doc_id, t, {_WORDS} AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM again) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines)::BIGINT AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeated USING (r)),
f AS (SELECT *, n_words < 10 AS b0, 100 * n_repeat_words > 20 * n_words AS b1, 2 * n_symbols > n_words AS b2,
    n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines AS b3,
    word_chars < 2 * n_words OR word_chars > 40 * n_words AS b4 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 OR b1 AS base_failed,
  NOT (b0 OR b1 OR b2 OR b3 OR b4) AS kept, n_lines,
  (b0::INT + 2 * b1::INT + 4 * b2::INT + 8 * b3::INT + 16 * b4::INT)::BIGINT AS fail_bits
FROM f""",
    "op7_warc_index": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN page_id IS NOT NULL AND payload_bytes >= {warc.LEAST_BYTES}
    THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f""",
    "op12_prefix_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER
    (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM t),
-- CRC-32 of the decimal id, bit by bit
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
        lambda b, k: xor(b >> 1, 3988292384::BIGINT * (b & 1)))), 4294967295::BIGINT) % 9 AS h FROM ids),
turns AS (SELECT h.conv_id, t.n, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 WHERE t.n <= h
  UNION ALL SELECT h.conv_id, 1000000 + t.n, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id WHERE t.n > h),
told AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS d,
    sha256(octet_length(encode(role)) || ':' || role || text) AS s, octet_length(encode(text)) AS bytes FROM turns),
path AS (SELECT conv_id, list(s ORDER BY d) AS p FROM told GROUP BY conv_id),
begun AS (SELECT conv_id, p, unnest(range(1, len(p) + 1)) AS d FROM path),
member AS (SELECT b.conv_id, b.d, sha256(array_to_string(p[1:b.d], ',')) AS node,
    CASE WHEN b.d > 1 THEN sha256(array_to_string(p[1:b.d - 1], ',')) ELSE 'root' END AS parent, bytes, len(p) = b.d AS last
  FROM begun b JOIN told ON told.conv_id = b.conv_id AND told.d = b.d
  UNION ALL SELECT conv_id, 0, 'root', NULL, 0, NOT EXISTS (SELECT 1 FROM path WHERE path.conv_id = ids.conv_id) FROM ids),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM member GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent),
-- a node lies below those that its smallest member passes
below AS (SELECT m.node, sum((x.n_convs - 1) * x.bytes)::BIGINT AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM nodes x JOIN member m ON m.conv_id = x.conv_id AND m.d <= x.depth LEFT JOIN kids ON kids.node = x.node
  GROUP BY m.node)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children,
  leaves AS n_leaves, saved AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.node = x.parent LEFT JOIN kids ON kids.node = x.node JOIN below ON below.node = x.node""",
    "op13_scaled_sketch": rf"""
WITH o AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT o.r, o.doc_id, o.t, n.r AS nr, n.t AS nt FROM o JOIN o n ON n.r = o.r % (SELECT count(*) FROM o) + 1),
e AS (SELECT *, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) AS et FROM p),
texts AS (SELECT r, 0 AS k, t FROM e UNION ALL SELECT r, 1, et FROM e),
w AS (SELECT r, k, list_filter(regexp_split_to_array(
    translate(t, '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
h AS (SELECT DISTINCT r, k, left(md5(array_to_string(w[i:i + 4], ' ')), 16) AS h
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
f AS (SELECT r, k, coalesce(list(h ORDER BY h) FILTER (h < '{int(sketch.SHARE * 2**64):016x}'), [min(h)]) AS f
  FROM h GROUP BY r, k),
g AS (SELECT e.*, coalesce(a.f, []) AS own, coalesce(b.f, []) AS edited, coalesce(c.f, []) AS following FROM e
  LEFT JOIN f a ON a.r = e.r AND a.k = 0 LEFT JOIN f b ON b.r = e.r AND b.k = 1 LEFT JOIN f c ON c.r = e.nr AND c.k = 0),
c AS (SELECT *, len(list_intersect(own, edited)) AS ie, len(list_intersect(own, following)) AS i_n FROM g)
SELECT doc_id, length(t) AS n_chars, sha256(et) AS edited_sha256, array_to_string(own, ',') AS fingerprint,
  array_to_string(edited, ',') AS edited_fingerprint,
  CASE WHEN len(own) + len(edited) = 0 THEN 1.0::DOUBLE ELSE ie::DOUBLE / (len(own) + len(edited) - ie) END AS near_edited,
  CASE WHEN len(own) + len(following) = 0 THEN 1.0::DOUBLE ELSE i_n::DOUBLE / (len(own) + len(following) - i_n) END AS near_next,
  CASE WHEN len(own) = 0 THEN 1.0::DOUBLE ELSE ie::DOUBLE / len(own) END AS contained_edited,
  CASE WHEN len(own) = 0 THEN 1.0::DOUBLE ELSE i_n::DOUBLE / len(own) END AS contained_next
FROM c""",
    "op8_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c >= {jaccard.LINK} * (a.n + b.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT y, root FROM reach JOIN ways ON x = doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY doc_id, n""",
}
