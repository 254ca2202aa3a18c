"""A query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from defectlens.llm import bpe, chat, decontaminate, licenses, linededup, ppm, prefix_trie, repair, sharding, simhash, tokencount, topk, toxicity
from defectlens.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def sql_crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    bit = "CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END"
    byte = f"list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda d, z: {bit}, xor(c, b))"
    return f"xor(4294967295, list_reduce({codes}, lambda c, b: {byte}, 4294967295::BIGINT))"


def vocabulary_path() -> str:
    """Where the public vocabulary file of the queries lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query(
    "op2_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
        WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, o.vec_id, list_sum(list_transform(list_zip(q.c, o.c), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v q JOIN v o ON q.vec_id % 50 = 0 AND o.vec_id <> q.vec_id AND len(q.c) = len(o.c)
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op2(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    "op3_benchmark_decontamination",
    r"""
    WITH items AS (
        SELECT item_id, list_filter(string_split_regex(lower(text), '[ 	-
]+'), lambda w: w <> '') AS w FROM benchmark
    ), item AS (
        SELECT item_id, len(w) AS n, least(len(w), 5) AS k, list_transform(range(1, len(w) - least(len(w), 5) + 2),
               lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS s FROM items WHERE len(w) > 0
    ), doc AS (
        SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents
    ), ds AS (
        SELECT doc_id, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS s
        FROM doc, (SELECT DISTINCT k FROM item) WHERE len(w) >= k
    ), placed AS (
        SELECT doc_id, k, unnest(s) AS g, unnest(range(1, len(s) + 1)) AS p, s FROM ds
    ), win AS (
        SELECT DISTINCT a.doc_id, i.item_id, a.p, a.s[a.p:a.p + i.n - i.k] AS win, i.s AS want
        FROM placed a JOIN (SELECT *, unnest(s) AS g FROM item) i ON a.g = i.g AND a.k = i.k
    ), shared AS (
        SELECT doc_id, item_id, p, len(win) AS nw, len(want) AS ni, list_sum(list_transform(list_distinct(win), lambda x: least(
            len(list_filter(win, lambda y: y = x)), len(list_filter(want, lambda y: y = x))))) AS c FROM win
    ), scored AS (
        SELECT doc_id, item_id, p - 1 AS start, c / (nw + ni - c) AS similarity FROM shared
    )
    SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(start, (similarity, -start))::BIGINT AS start
    FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
    """,
)
def op3(spark, sf_dir):
    leaks = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select(F.col("id").alias("doc_id"), "item_id", "similarity", "start")


@query("op4_lm_scoring")
def op4(spark, sf_dir):
    return ppm.score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_bpe_encode_decode")
def op5(spark, sf_dir):
    packed = bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), decoded=True)
    return packed.select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


@query("op7_chat_formatting")
def op7(spark, sf_dir):
    sample = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", sample), (-7, 1, "assistant", sample)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    talks = chat.format_conversations(rows).withColumns(
        {"turns": chat.read_turns(F.col("formatted")), "learnt": chat.learnt_text(F.col("segments"))}
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "violation",
    )


@query("op8_license_scan")
def op8(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.col("base.n").alias("n_base"), F.col("base.first").alias("first_word"),
        F.col("base.last").alias("last_word"), F.array_join("base.labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


@query(
    "op9_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
    ), placed AS (
        SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM lines
    ), keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed
    ), often AS (
        SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    ), marked AS (
        SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
    )
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op9(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op10_token_counts")
def op10(spark, sf_dir):
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
    return counted.withColumnRenamed("id", "doc_id")


@query(
    "op11_conversation_repair",
    rf"""
    WITH RECURSIVE marked AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS mark FROM conversations
    ), dealt AS (
        SELECT *, {sql_crc32("mark")} % 20 AS d FROM marked
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
               CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
        FROM dealt, range(2) AS r(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)
    ), seen AS (
        SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
               count(*) OVER (PARTITION BY conv_id) AS n,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k0 FROM damaged
    ), faulty AS (
        SELECT *, left(role, 1) AS k, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd'
               WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM seen
    ), arcs(q, k, nxt) AS (
        VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
    ), todo AS (
        SELECT conv_id, i, n, role, text, f, k, q, nxt, s FROM faulty, (SELECT q, max(nxt) AS nxt FROM arcs GROUP BY q) a, range(4) AS g(s)
    ), ways AS (
        SELECT conv_id, i, n, q, 2 AS c, 'D' AS e, NULL AS line, q AS to_q FROM todo WHERE s = 0
        UNION ALL SELECT t.conv_id, i, n, t.q, CASE WHEN f = 't' THEN 5 ELSE 0 END, 'K', role || ':' || text, a.nxt
        FROM todo t JOIN arcs a ON a.q = t.q AND a.k = t.k WHERE s = 1 AND f NOT IN ('b', 'd')
        UNION ALL SELECT conv_id, i, n, q, CASE WHEN f = 't' THEN 6 ELSE 1 END, 'R', CASE nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END || text, nxt
        FROM todo WHERE s = 2 AND f NOT IN ('b', 'd')
    ), more(q, ins, c, e, lines, to_q) AS (
        SELECT q, 0, 0, '', []::VARCHAR[], q FROM range(4) AS g(q)
        UNION ALL SELECT m.q, ins + 1, c + 5, e || 'I', list_append(lines, CASE WHEN m.to_q = 2 THEN 'assistant:' ELSE 'user:' END), CASE WHEN m.to_q = 2 THEN 3 ELSE 2 END
        FROM more m WHERE ins < 3
    ), steps AS (
        SELECT w.conv_id, w.i, w.n, m.q, m.c + w.c AS c, m.e || w.e AS e, CASE WHEN w.line IS NULL THEN m.lines ELSE list_append(m.lines, w.line) END AS lines, w.to_q
        FROM more m JOIN ways w ON w.q = m.to_q
    ), best(conv_id, i, q, c, e, lines) AS (
        SELECT t.conv_id, n + 1, m.q, min(m.c), arg_min(m.e, (m.c, m.e)), arg_min(m.lines, (m.c, m.e))
        FROM (SELECT DISTINCT conv_id, n FROM faulty) t, more m WHERE m.to_q IN (0, 3) GROUP BY t.conv_id, n, m.q
        UNION ALL
        SELECT conv_id, i, q, r.c, r.e, r.lines FROM (
            SELECT s.conv_id, s.i, s.q, arg_min({{'c': s.c + b.c, 'e': s.e || b.e, 'lines': list_concat(s.lines, b.lines)}}, (s.c + b.c, s.e || b.e)) AS r
            FROM steps s JOIN best b ON b.conv_id IS NOT DISTINCT FROM s.conv_id AND b.i = s.i + 1 AND b.q = s.to_q GROUP BY s.conv_id, s.i, s.q)
    ), told AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE f = 'b') AS blank,
               count(*) FILTER (WHERE f = 'd') AS duplicate, count(*) FILTER (WHERE f = 't') AS truncated,
               count(*) FILTER (WHERE i > 1 AND k0 || k NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(c, 0)::BIGINT AS cost, coalesce(e, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1 AND b.q = 0
    """,
)
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    mark = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    dealt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(mark) % 20).alias("damage"))
    damaged = dealt.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("damage") != 0).alias("present"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))),
    )
    found = repair.repair_conversations(damaged, present="present")
    repaired = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.select(
        "conv_id", "gaps", *[repair.fault_count(F.col("said"), f).alias(f) for f in (repair.BLANK, repair.DUPLICATE, repair.TRUNCATED)],
        "illegal", "cost", "audit", F.sha2(repaired, 256).alias("repaired_sha256"),
    )


@query("op12_sharding")
def op12(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.shuffle_into_shards(docs, 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op13_conversation_prefix_trie",
    f"""
    WITH talks AS (
        SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS said,
               coalesce({sql_crc32("conv_id::VARCHAR")} % 9, 0) AS h FROM conversations GROUP BY conv_id
    ), rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) AS said FROM talks c LEFT JOIN talks b ON b.conv_id = c.conv_id - c.conv_id % 5
    ), prefixes AS (
        SELECT conv_id, d, said[1:d] AS k, len(said) = d AS is_end FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM rebuilt)
    ), node AS (
        SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(coalesce(conv_id::VARCHAR, ''), ',' ORDER BY conv_id NULLS FIRST) FILTER (WHERE is_end) AS ends
        FROM prefixes GROUP BY d, k
    ), full_node AS (
        SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n
        LEFT JOIN (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2) c ON c.d = n.d AND c.k = n.k
    ), sums AS (
        SELECT a AS d, k[1:a] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
               sum((n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].t) END)::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_node) GROUP BY 1, 2
    )
    SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM full_node n JOIN sums s ON s.d = n.d AND s.k = n.k LEFT JOIN node p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
    """,
)
def op13(spark, sf_dir):
    talks = prefix_trie.conversations(table(spark, sf_dir, "conversations"))
    shared = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 9, F.lit(0)).cast("int")
    heads = talks.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    rebuilt = talks.withColumns({"base": F.expr("conv_id - conv_id % 5"), "h": shared}).join(heads, "base", "left")
    turns = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(dict(talks.dtypes)["turns"])), F.slice("turns", F.col("h") + 1, F.size("turns")))
    trie = prefix_trie.prefix_trie(rebuilt.select("conv_id", turns.alias("turns")))
    return trie.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
