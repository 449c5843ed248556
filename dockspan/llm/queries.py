"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from dockspan.llm import rank_bpe
from dockspan.llm.bpe import decode_ids, encode_texts
from dockspan.llm.catalog import ORACLES, QUERIES, query, table  # noqa: F401
from dockspan.llm.line_templates import drop_recurring_lines
from dockspan.llm.mask_search import ranked_search
from dockspan.llm.mixing import score_documents
from dockspan.llm.packing import pack_documents
from dockspan.llm.quality import judge_quality
from dockspan.llm.repeats import remove_repeats
from dockspan.llm.sharding import shard_documents
from dockspan.llm.simhash import near_duplicates
from dockspan.llm.token_counts import count_tokens
from dockspan.llm.top_k import top_k_search
from dockspan.llm.turn_trie import prefix_trie


@query("op1_context_mixing")
def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_prefix_bpe")
def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op4_run_length_repeats")
def op4_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    # The remaining bytes as text too; a character that a removal cuts in two becomes a replacement mark.
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)


@query("op5_bk_tree_neighbours")
def op5_bk_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), w AS (
  SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS raw
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), m AS (
  SELECT doc_id, pos, raw, len(raw) AS n,
         list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS words FROM w
), k AS (SELECT *, n || ' ' || array_to_string(words[1:3], ' ') AS leaf FROM m),
busy AS (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
p AS (
  SELECT doc_id, pos, leaf, n, unnest(raw) AS word, generate_subscripts(raw, 1) AS place FROM k JOIN busy USING (leaf)
), c AS (
  SELECT leaf, place, word, regexp_matches(word, '[0-9]') AS digit FROM p GROUP BY ALL HAVING count(*) >= 10
), t AS (
  SELECT p.doc_id, p.pos, p.leaf, any_value(p.n) AS n, count(c.word) AS held, count(c.word) FILTER (NOT c.digit) AS constants,
         string_agg(CASE WHEN NOT c.digit THEN c.word ELSE '<*>' END, ' ' ORDER BY p.place) AS template,
         string_agg(coalesce(c.word, '<*>'), ' ' ORDER BY p.place) AS numbered
  FROM p LEFT JOIN c ON p.leaf = c.leaf AND p.place = c.place AND p.word = c.word GROUP BY p.doc_id, p.pos, p.leaf
), g AS (
  SELECT doc_id, pos, leaf || CASE WHEN constants >= 0.6 * n THEN '|' || template ELSE '||' || numbered END AS template
  FROM t WHERE held >= 0.6 * n
),
o AS (
  SELECT template, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM g
  GROUP BY template HAVING count(DISTINCT doc_id) >= 10
), d AS (
  SELECT g.doc_id, g.pos FROM g JOIN o USING (template) WHERE struct_pack(doc_id := g.doc_id, pos := g.pos) <> o.first
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l ANTI JOIN d USING (doc_id, pos) GROUP BY l.doc_id
), cnt AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY doc_id),
dropped AS (SELECT doc_id, count(*) AS n_dropped FROM d GROUP BY doc_id)
SELECT x.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents x LEFT JOIN cnt USING (doc_id) LEFT JOIN dropped USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op6_line_templates", LINE_SQL)
def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_recurring_lines(table(spark, sf_dir, "documents"), depth=3, min_docs=10, share=0.6)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


@query("op7_decision_list")
def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op8_top_k_search", TOP_K_SQL)
def op8_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


@query("op9_hash_tree_shards")
def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Packing with the parameters used here; the last stage of the pipeline too."""
    return pack_documents(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        capacity=2048,
        end_id=1,
    )


@query("op10_differencing_pack")
def op10_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed_pieces(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op11_chunked_bpe")
def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = rank_bpe.encode_texts(table(spark, sf_dir, "documents"), path, pattern)
    return rank_bpe.decode_ids(coded, path, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("decimals", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


RANKED_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), d AS (SELECT row_no, doc_id, len(terms) AS n FROM t WHERE len(terms) > 0),
c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
p AS (
  SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM t) GROUP BY ALL
), q AS (
  SELECT item_no, any_value(item_id) AS item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item_no, item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
  ) GROUP BY item_no, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term, big_n
), s AS (
  SELECT item_no, any_value(item_id) AS item_id, row_no, any_value(doc_id) AS doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (row_no), c GROUP BY item_no, row_no
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""


@query("op12_mask_search", RANKED_SQL)
def op12_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), k AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS lead, CAST(xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, strlen(CAST(conv_id AS VARCHAR)) + 1),
      lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))
  )) % 6 AS INTEGER) AS h FROM t
), b AS (
  SELECT k.conv_id, list_concat(coalesce(f.turns, [])[1:h], k.turns[h + 1:]) AS turns
  FROM k LEFT JOIN t f ON f.conv_id = k.lead
), m AS (
  SELECT conv_id, d, len(turns) AS size, md5(CAST(to_json(turns[1:d]) AS VARCHAR)) AS node,
         CASE WHEN d > 0 THEN md5(CAST(to_json(turns[1:d - 1]) AS VARCHAR)) END AS parent,
         CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS last
  FROM b, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)
), n AS (
  SELECT node, d AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(last) AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
  FROM m GROUP BY node, d
), c AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
u AS (
  SELECT up.node, sum(n.own) AS saved, count(*) FILTER (WHERE c.n_children IS NULL) AS leaves
  FROM n JOIN m path ON path.conv_id = n.conv_id AND path.d <= n.depth JOIN n up ON up.node = path.node
  LEFT JOIN c ON c.parent = n.node GROUP BY up.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves,
       CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN u USING (node) LEFT JOIN n p ON p.node = n.parent LEFT JOIN c ON c.parent = n.node
"""


@query("op13_turn_trie", TRIE_SQL)
def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
