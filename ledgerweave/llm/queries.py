"""The operators bound to the test tables, one query each, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import ann, chat, exact_topk, html_main, language_id, line_dedup, mixing, neardup, packing, periodic, prefix_trie, quality, token_counts
from ledgerweave.functions.stage import stage
from ledgerweave.llm.common import WORD, read, written
from ledgerweave.llm.forest import join_one
from ledgerweave.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(use_utc(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    codes = language_id.fit(docs.filter(~held))
    out = language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), codes)
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


@query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@query("op8_source_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


@query("op2_nearest_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.vectors(read(spark, sf_dir, "embeddings"))
    return ann.nearest(rows.filter("id % 50 = 0"), rows)


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '### ', '\h'), '</turn>', '\t') AS inside FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role || ': ') + length(inside) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op5_chat_formatting", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    chats = chat.format_chats(given.unionByName(extra))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = chats.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "formatted")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op6_html_main_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.extract(pages, html_main.fit(pages))


#: Unsigned CRC-32 (the reflected polynomial 0xEDB88320) of a number's decimal digits: each byte, then eight shifts.
CRC_SQL = """xor(4294967295, list_reduce(
  flatten(list_transform(range(1, length({x}::VARCHAR) + 1), lambda i: [ascii(substr({x}::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295))"""


# Every pair of equal five-word windows of a text is joined here; a run has one at each place of its diagonal.
OP11_SQL = r"""
WITH given AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, @CRC AS h FROM documents
), numbered AS (
  SELECT k, doc_id, ws, h, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM given
), placed AS (
  SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE ws END AS ws
  FROM numbered
), words AS (
  SELECT k, n, unnest(ws) AS word, unnest(range(0, n)) AS i FROM placed
), grams AS (
  SELECT k, n, i, hash(word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS gram
  FROM words WINDOW w AS (PARTITION BY k ORDER BY i) QUALIFY lead(word, 4) OVER w IS NOT NULL
), cells AS (
  SELECT x.k, x.i, x.i - y.i AS q FROM grams x JOIN grams y ON x.k = y.k AND x.gram = y.gram AND x.i > y.i AND 4 * (x.i - y.i) <= x.n
), diagonals AS (
  SELECT k, q, min(i) - q AS start, max(i) + 5 - min(i) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM cells) GROUP BY k, q, island
), runs AS (
  SELECT k, start, length, min(q) AS period FROM diagonals WHERE length >= greatest(6, 4 * q) GROUP BY k, start, length
), per_row AS (
  SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    first({'start': start, 'length': length, 'period': period} ORDER BY length::DOUBLE / period DESC, start, period) AS best
  FROM runs GROUP BY k
), kept AS (
  SELECT k, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.k = w.k AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY k
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM given LEFT JOIN per_row USING (k) LEFT JOIN kept USING (k)
""".replace("@CRC", CRC_SQL.format(x="doc_id"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the ids, by their CRC-32, gets a text whose words repeat from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = stage(docs.select("doc_id", "text"), {"h": h, "words": F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})")))})
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    sized = stage(words, {"a": g % n, "n": n, "p": 1 + F.floor((n - g % n) / (3 + g % 8))})
    repeated = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), repeated), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeated_tails(read(spark, sf_dir, "documents"))
    found = stage(periodic.find_runs(docs, ["doc_id"]), {"best": periodic.strongest(F.col("runs"))})
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


@query("op12_exact_topk", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_topk.sparse_rows(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", exact_topk.floor_of(64))
    return exact_topk.top_k(rows.filter("id % 20 = 0"), rows, 20)


OP13_SQL = """
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, @CRC % 6 AS h FROM (SELECT DISTINCT conv_id FROM placed)
), rebuilt AS (
  SELECT c.conv_id, b.role, b.text, b.pos FROM convs c JOIN placed b ON b.conv_id = c.base AND b.pos < c.h
  UNION ALL SELECT c.conv_id, o.role, o.text, o.pos + 1000000000 FROM convs c JOIN placed o ON o.conv_id = c.conv_id AND o.pos >= c.h
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt
), chain AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), named AS (
  SELECT conv_id, depth, chars, sha256(path) AS node FROM chain
), linked AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM named
), nodes AS (
  SELECT node, min(parent) AS parent, min(depth) AS depth, min(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM linked GROUP BY node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)
), sums AS (
  SELECT l.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens
  FROM full_nodes f JOIN linked l ON l.conv_id = f.conv_id AND l.depth <= f.depth GROUP BY l.node
)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums USING (node) LEFT JOIN nodes p ON f.parent = p.node
""".replace("@CRC", CRC_SQL.format(x="conv_id"))


def shared_heads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, item, chars`` where each conversation begins with up to five turns of its hundred's first one, and all ids.

    Ids are replaced by ``id - id % 100`` rounded towards zero, so at most 199 conversations share a head.
    """
    sizes = written(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    taken = lambda c: F.crc32(F.col(c).cast("string")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    convs = sizes.select("conv_id", base.alias("base"), taken("conv_id").alias("h"))
    first = rows.filter("conv_id % 100 = 0 AND pos < 5").select(F.col("conv_id").alias("base"), "pos", "item", "chars")
    heads = convs.join(first, "base").filter("pos < h").select("conv_id", "pos", "item", "chars")
    rest = rows.withColumn("base", base).withColumn("h", taken("conv_id")).filter("pos >= h")
    lengths = sizes.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    moved = join_one(rest, lengths, "base").withColumn("pos", F.col("pos") - F.col("h") + F.least("h", F.coalesce("n_base", F.lit(0))))
    return heads.unionByName(moved.select("conv_id", "pos", "item", "chars")), sizes.select("conv_id")


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = written(prefix_trie.sequences(given), "sequences")
    nodes, ends = prefix_trie.trie(*shared_heads(rows))
    out = nodes.join(prefix_trie.end_digests(ends), "node", "left")
    figures = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*figures, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
