"""Registered queries of the dealt operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm import balltree, exact, jaccard, mixing, pieces, quality, quotes, shards, simhash, structure, suffixes, toxicity, warc
from paperloom.functions.skew import row_numbers
from paperloom.llm.store import new_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs, carry=["doc_id"]).select("__doc.doc_id", "__stats.*", "base_failed", "kept", F.round("distance", 6).alias("distance"))


@query(
    "op9_mixing",
    """
WITH d AS (
  SELECT doc_id, source, coalesce('v' || source, 'n') AS key, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(concat_ws('|', doc_id::VARCHAR, coalesce(text, ''))) AS ord
  FROM documents),
s AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
        (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w FROM s),
r AS (SELECT *, (sum(source_size) OVER ())::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl FROM w),
l AS (SELECT arg_min(lft / wl, struct_pack(a := cap / w, b := source)) AS level FROM r WHERE lft / wl * w <= cap),
t AS (SELECT key, source_size, least(cap, coalesce((SELECT level FROM l) * w, cap)) AS target,
        ('0x' || substr(md5(key), 1, 5))::BIGINT / 1048576.0::DOUBLE AS o FROM r),
k AS (SELECT d.*, t.*, row_number() OVER (PARTITION BY d.key ORDER BY floor(sqrt(size)), ord) AS rank FROM d JOIN t USING (key))
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN size * (floor(o + target / source_size * rank) - floor(o + target / source_size * (rank - 1)))::BIGINT ELSE 0 END AS taken
FROM k""",
)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.document_copies(docs).select(
        "__doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query(
    "op10_exact_dedup",
    """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
)
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_groups(docs, keep="max")


@query("op2_sharding")
def op2(spark, sf_dir):
    names = [f"shard-{i:05d}" for i in range(256)]
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return shards.place(docs, F.col("doc_id"), names).select("__row.doc_id", "slot", "shard")


def quoting_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail: every turn quotes the one before it, and below it, one level deeper, the one before that.

    Turns are numbered without their texts, in spans, so that a long conversation is spread; texts then meet by number.
    """
    raw = written(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row")), "quoting")
    thin = raw.select("conv_id", "turn", "row").withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    at = row_numbers(thin, ["conv"], ["turn", "row"], F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / 1000), "at").select("row", "conv", "at")
    placed = raw.join(at, "row")
    quoted = lambda k, mark: placed.select("conv", (F.col("at") + k).alias("at"), F.regexp_replace("text", "(?m)^", mark).alias(f"q{k}"))
    text = F.concat_ws("\n", "q1", "q2", F.when(F.col("turn") > 0, ""), "text")
    return placed.join(quoted(1, "> "), ["conv", "at"], "left").join(quoted(2, "> > "), ["conv", "at"], "left").select("conv_id", "turn", "role", text.alias("text"))


@query("op3_quotes")
def op3(spark, sf_dir):
    linked = quotes.link_quotes(quoting_messages(spark, sf_dir))
    return linked.select("__row.conv_id", "__row.turn", "parent", "root", "depth", "position", "n_quotes", "n_linked",
                         F.md5("reply").alias("reply_md5"))


@query(
    "op4_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       translate(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 11, 10))::BIGINT, 32, 8)
              || to_base(('0x' || substr(h, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
)
def op4(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return warc.page_archive(spark, path)


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query("op7_pieces")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_texts(docs, carry=["doc_id"], ids=False)


@query("op8_near_copies")
def op8(spark, sf_dir):
    return jaccard.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_repeats")
def op5(spark, sf_dir):
    return suffixes.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


@query("op13_simhash")
def op13(spark, sf_dir):
    return simhash.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of conversation and turn; nulls become one space, but for ids and turns."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    times = F.array_repeat(F.lit(0), F.when(case == 0, 0).when(case == 3, 2).otherwise(1))
    return conversations.select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation with what was found, the repair's cost and edits, and a digest of the repaired rows."""
    summary, repaired = structure.repair(damaged(conversations.select("conv_id", "turn", "role", "text")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    own = summary.withColumnRenamed("conv_id", "c").join(structure.digests(repaired).withColumnRenamed("conv_id", "d"), F.col("c").eqNullSafe(F.col("d")), "left")
    return conversations.select("conv_id").distinct().join(own, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op11_structure")
def op11(spark, sf_dir):
    return repaired_conversations(table(spark, sf_dir, "conversations"))


@query(
    "op12_ranked_search",
    """
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, a GROUP BY term),
v AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len)) AS v FROM tf JOIN n USING (doc_id), a),
qw AS (SELECT item_id, term, count(*) * any_value(w) AS w FROM q JOIN w USING (term) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(w * v)::BIGINT AS score FROM qw JOIN v USING (term) GROUP BY ALL HAVING sum(w * v) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s QUALIFY rank <= 20""",
)
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return balltree.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
