"""Queries of this subpackage over the driver tables, each a thin step from the tables to an operator and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import archives, chat, codes, contamination, links, near, overlaps, packing, passages, prefixes, quality, rules, token_files
from scorelake.llm.exchange import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recognised page texts."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page_id"), "text")


def page_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as reviews, without the rows held out for testing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return labels.filter(learn).select(F.col("doc_id").alias("page_id"), F.col("quality").alias("accepted"))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), rules.WORD_BREAK), lambda w: w != ""))


LINK_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
LINK_PATTERNS = [("block", "ads-*/"), ("block", "*track*/"), ("block", "*/*login"), ("block", "*/*.exe")]


@query(
    "op10_url_filters",
    r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '\A.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '\A.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN suffix('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN suffix('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN suffix('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN suffix('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN suffix('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN NOT starts_with(path, '/') THEN 'allow'
    WHEN contains('.' || host, '.ads-') OR regexp_matches('.' || host, '\..*track') OR contains(path, 'login') OR contains(path, '.exe')
    THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return links.screen_links(pages, LINK_RULES, LINK_PATTERNS).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op9_quality_rules",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i AS pos, list_slice(w, i, i + 7) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
marked AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM win),
rep AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - pos, 8))) AS n
  FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM marked WHERE twice)
  GROUP BY doc_id),
c AS (
  SELECT d.doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)
            OR 2 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > word_chars
            OR 5 * (length(text) - length(replace(text, '!', ''))) > n_words) AS kept
FROM b""",
)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.screen_texts(page_texts(spark, sf_dir))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("page_id").alias("doc_id"), *counts, "base_failed", "kept")


@query("op2_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps.remove_overlaps(page_texts(spark, sf_dir))
    return found.select(F.col("page_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeated_passages(page_texts(spark, sf_dir))
    return found.select(F.col("page_id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op1_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = quality.grade_pages(page_texts(spark, sf_dir), page_reviews(spark, sf_dir))
    held_out = F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0
    return graded.select(F.col("page_id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted")


@query("op4_warc")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html").alias("body"))
    folder = scratch(spark, "archives")
    archives.archive_pages(pages, folder)
    back = archives.read_archives(spark, folder, payloads=False)
    ids = {c: F.col(c).cast("bigint").alias(c) for c in ("page_id", "refers_to")}
    return back.select(ids["page_id"], "payload_bytes", "payload_digest", "record_type", ids["refers_to"])


@query("op7_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = docs.select(F.col("doc_id").alias("score_id"), n_words(F.col("text")).alias("n_tokens"))
    return packing.pack_sequences(sizes).withColumnRenamed("score_id", "doc_id")


@query("op5_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(page_texts(spark, sf_dir)).withColumnRenamed("page_id", "doc_id")


@query("op3_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumnRenamed("item_id", "sample_id")
    found = contamination.find_leaks(page_texts(spark, sf_dir), samples)
    return found.withColumnsRenamed({"page_id": "doc_id", "sample_id": "item_id"})


TURN_SCHEMAS = {
    "user": {"properties": {"prompt": "string", "turn": "integer"}, "required": ["prompt", "turn"], "additional": False},
    "system": {"properties": {"prompt": "string", "turn": "integer", "scope": "string"}, "required": ["prompt", "scope"]},
}


@query(
    "op8_chat_formatting",
    """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, text, CASE WHEN turn >= 2 THEN turn - 2 WHEN turn = 1 THEN 0 END AS after
  FROM conversations WHERE role <> 'assistant'),
r AS (SELECT conv_id, turn, turn - 1 AS id, text FROM conversations WHERE role = 'assistant'),
d AS (
  SELECT c.conv_id, c.turn, 0 AS depth FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.after WHERE p.turn IS NULL
  UNION ALL
  SELECT c.conv_id, c.turn, d.depth + 1 FROM d JOIN c ON c.conv_id = d.conv_id AND c.after = d.turn)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id,
       row_number() OVER (PARTITION BY coalesce(c.conv_id, r.conv_id) ORDER BY d.depth NULLS LAST, c.turn NULLS LAST, r.turn NULLS LAST,
                          CAST(coalesce(c.turn, r.id) AS VARCHAR))::INT AS position,
       CAST(coalesce(c.turn, r.id) AS VARCHAR) AS call_id, c.turn AS turn, r.turn AS result_turn,
       c.role AS name, d.depth::BIGINT AS depth,
       CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'open' ELSE 'linked' END AS status,
       CASE WHEN c.turn IS NULL THEN 'call: missing' WHEN c.role = 'system' THEN 'scope: missing' WHEN c.role = 'user' THEN ''
            ELSE 'name: no such tool' END AS errors,
       '{"arguments":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE '{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '}' END
         || ',"id":"' || coalesce(c.turn, r.id) || '","name":' || CASE WHEN c.role IS NULL THEN 'null' ELSE to_json(c.role) END
         || ',"result":' || CASE WHEN r.text IS NULL THEN 'null' ELSE to_json(r.text) END || '}' AS json
FROM c FULL JOIN r ON r.conv_id = c.conv_id AND r.id = c.turn LEFT JOIN d ON d.conv_id = c.conv_id AND d.turn = c.turn""",
)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user or system turn as a call to answer, every assistant turn as the result of the turn before."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    answers, turn = F.col("role") == "assistant", F.col("turn")
    messages = turns.select(
        "conv_id",
        "turn",
        F.when(answers, "result").otherwise("call").alias("kind"),
        F.when(answers, turn - 1).otherwise(turn).alias("call_id"),
        F.col("role").alias("name"),
        F.when(answers, F.col("text")).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).alias("content"),
        F.when(turn >= 2, turn - 2).when(turn == 1, 0).alias("after_id"),
    )
    linked = chat.link_tool_calls(messages, TURN_SCHEMAS)
    return linked.withColumn("errors", F.array_join("errors", "; ")).drop("n_calls", "n_results")


@query("op11_token_files")
def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "token-files")
    token_files.write_token_files(page_texts(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    back = token_files.read_token_files(spark, folder)
    return back.select(F.col("page_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _assigned(codebook: str) -> str:
    """SQL for the first nearest entry of each part, given the entries in a table."""
    return f"""
  SELECT n, part, min_by(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT v.n, v.part, c.entry, sum((v.x - c.c) ** 2)::HUGEINT AS d FROM v JOIN {codebook} c USING (part, pos) GROUP BY v.n, v.part, c.entry)
  GROUP BY n, part"""


def _replaced(assigned: str, codebook: str) -> str:
    """SQL for the floored means of the parts of each entry."""
    return f"""
  SELECT part, entry, pos, coalesce(m.c, b.c) AS c FROM {codebook} b LEFT JOIN (
    SELECT part, entry, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS c
    FROM v JOIN {assigned} USING (n, part) GROUP BY part, entry, pos) m USING (part, entry, pos)"""


@query(
    "op12_vector_codes",
    f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, label, embedding, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT n, (i - 1) // w AS part, (i - 1) % w AS pos, floor(256 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT n, w, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
c0 AS (SELECT part, n - 1 AS entry, pos, x AS c FROM v WHERE n <= 64),
a0 AS MATERIALIZED ({_assigned("c0")}),
c1 AS MATERIALIZED ({_replaced("a0", "c0")}),
a1 AS MATERIALIZED ({_assigned("c1")}),
c2 AS MATERIALIZED ({_replaced("a1", "c1")}),
a2 AS MATERIALIZED ({_assigned("c2")}),
e AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY n),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM e JOIN kept USING (n) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c2) AS codebooks_sha256
FROM e JOIN kept USING (n) JOIN l ON l.label IS NOT DISTINCT FROM kept.label""",
)
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    columns = ["vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(made.digest()).alias("codebooks_sha256")]
    return made.codes.select(*columns)


@query(
    "op13_prefix_trie",
    r"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS own FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, own, xor(list_reduce(
           list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1])), 4294967295) % 4 AS h
  FROM o CROSS JOIN crc),
r AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h.h), []), coalesce(list_slice(h.own, h.h + 1, len(h.own)), [])) AS turns
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, turns, d::BIGINT AS depth, list_slice(turns, 1, d) AS p FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
  FROM m GROUP BY depth, p),
k AS (SELECT depth - 1 AS depth, list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
s AS (
  SELECT n.*, coalesce(k.n_children, 0)::BIGINT AS n_children,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.p[-1].text, '[^ 	-
]+')) END AS saved
  FROM n LEFT JOIN k USING (depth, p)),
u AS (
  SELECT a.depth, a.p, count_if(b.n_children = 0)::BIGINT AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens
  FROM s a JOIN s b ON b.depth >= a.depth AND list_slice(b.p, 1, a.depth) = a.p GROUP BY a.depth, a.p)
SELECT s.conv_id, s.depth, q.conv_id AS parent_conv_id, s.n_convs, s.n_children, u.n_leaves, u.saved_tokens, s.ends_sha256
FROM s JOIN u USING (depth, p) LEFT JOIN n q ON q.depth = s.depth - 1 AND q.p = list_slice(s.p, 1, s.depth - 1)""",
)
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scores, turns as lines; each is an edition of the first of its twenty."""
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnsRenamed({"conv_id": "score_id", "turn": "line_idx"})
    score = F.col("score_id")
    head = F.crc32(score.cast("string").cast("binary")) % 4
    editions = lines.select("score_id").distinct().select(score, (score - score % 20).alias("base_id"), head.alias("head"))
    trie = prefixes.score_prefix_trie(lines, editions)
    nodes = trie.nodes.join(prefixes.ends_digests(trie.ends), "node_id", "left")
    return nodes.select(
        score.alias("conv_id"),
        "depth",
        F.col("parent_score_id").alias("parent_conv_id"),
        F.col("n_scores").alias("n_convs"),
        "n_children",
        "n_leaves",
        F.col("saved_words").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
