"""The corpus operators as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import conversation_trie, decontaminate, embedding_dedup, graph_search, line_dedup, mixing, pii, secrets, simhash, suffix_dedup, token_alignment, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"))


#: The site rules of the url query.
SITE_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Patterns that decide where no site rule fits: farms of spam, and hosts with one of these words before a dash.
PATTERN_RULES = (
    url_filter.word_rule("block", "spam farms", r"^(?:[^#]*\.)?spam-farm(?:\.[^#]*)?#", ("spam", "farm")),
    *(url_filter.word_rule("block", f"{word} hosts", rf"^(?:[^#]*\.)?{word}-[^#]*#", (word,)) for word in ("adult", "casino", "cheap")),
)


@query(
    "op4_url_filters",
    r"""
    WITH parts AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages
    ), split AS (
      SELECT page_id, translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
      FROM parts
    ), rules(rule, rule_host, rule_path, action) AS (
      VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
             ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
    ), judged AS (
      SELECT page_id, host, path,
             (SELECT min({'r': -length(rule), 'rule': rule, 'action': action}) FROM rules
              WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
      FROM split
    )
    SELECT page_id, host, path, best.rule AS rule,
           coalesce(best.action, CASE WHEN regexp_matches(host, '^(.*\.)?(spam-farm(\..*)?$|(adult|casino|cheap)-)')
                                      THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rules = [url_filter.site_rule(*rule) for rule in SITE_RULES]
    return url_filter.judge_urls(table(spark, folder, "pages"), [*rules, *PATTERN_RULES])


@query("op5_mix_to_target_weights")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op8_secret_scans")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.repeated_spans(table(spark, folder, "documents")).drop("text_id")


@query("op2_embedding_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"))


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, folder, "documents"))


@query("op9_pii")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data_report(table(spark, folder, "documents"))


@query(
    "op13_conversation_prefix_trie",
    r"""
    WITH turns AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
             {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
      FROM conversations WHERE conv_id IS NOT NULL
    ), listed AS (
      SELECT conv_id, list(said ORDER BY pos) AS said,
             xor(4294967295, list_reduce(
               list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
               lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda x, step: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h
      FROM turns GROUP BY conv_id
    ), built AS (
      SELECT c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) AS path
      FROM listed c LEFT JOIN listed b ON b.conv_id = c.conv_id - c.conv_id % 5
    ), prefixes AS (
      SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM built
    ), nodes AS (
      SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends
      FROM prefixes GROUP BY ALL
    ), children AS (
      SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
    ), weighed AS (
      SELECT node, depth, (n_convs - 1) * coalesce(strlen(node[depth].text), 0) AS w, (n IS NULL)::BIGINT AS leaf
      FROM nodes LEFT JOIN children USING (node)
    ), above AS (
      SELECT node, unnest(range(0, depth + 1)) AS upto, w, leaf FROM weighed
    ), sums AS (
      SELECT node[1:upto] AS node, sum(w) AS w, sum(leaf) AS leaves FROM above GROUP BY ALL
    )
    SELECT nodes.conv_id, nodes.depth, parent.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0)::BIGINT AS n_children,
           sums.leaves::BIGINT AS n_leaves, sums.w::BIGINT AS saved_tokens, sha256(nodes.ends) AS ends_sha256
    FROM nodes JOIN sums USING (node) LEFT JOIN children USING (node)
    LEFT JOIN nodes parent ON nodes.depth > 0 AND parent.node = nodes.node[1:nodes.depth - 1]
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    turns = conversation_trie.shared_heads(conversation_trie.numbered_turns(table(spark, folder, "conversations")))
    nodes = conversation_trie.prefix_trie(turns)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves"]
    return nodes.select(*names, F.col("saved").alias("saved_tokens"), "ends_sha256")


@query("op12_cross_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.alignment_report(table(spark, folder, "documents"))


@query("op11_graph_search")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return graph_search.search(graph_search.build_index(vectors), vectors.where("vec_id % 20 = 0"))
