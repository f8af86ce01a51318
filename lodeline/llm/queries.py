"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import chat, html_extract, langid, media, merkle, mixing, neardup, packing, quality, sharding, swap_packing, tokenfiles, whitening
from lodeline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def ids_crc32(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = ids_crc32(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
    return packing.place_pieces(pieces, packing.group_count(docs)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


_QUALITY_SQL = rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS text,
               trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS squeezed FROM documents
    ), words AS (
        SELECT row_no, unnest(string_split(squeezed, ' ')) AS word, generate_subscripts(string_split(squeezed, ' '), 1) AS i
        FROM docs WHERE squeezed <> ''
    ), windows AS (
        SELECT row_no, i, word, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c, lead(word, 3) OVER w AS d, lead(word, 4) OVER w AS e
        FROM words WINDOW w AS (PARTITION BY row_no ORDER BY i)
    ), again AS (
        SELECT row_no, i, e IS NOT NULL AND count(*) OVER (PARTITION BY row_no, word, b, c, d, e) > 1 AS twice FROM windows
    ), covered AS (
        SELECT row_no, max(CASE WHEN twice THEN 1 ELSE 0 END)
               OVER (PARTITION BY row_no ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM again
    ), repeats AS (
        SELECT row_no, count(*) AS n_words, sum(inside) AS n_repeat_words FROM covered GROUP BY row_no
    ), lines AS (
        SELECT row_no, source, text, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS key
        FROM (SELECT row_no, source, text, unnest(string_split(text, chr(10))) AS line FROM docs)
    ), full_lines AS (
        SELECT *, len(string_split(key, ' ')) AS line_words FROM lines WHERE key <> ''
    ), dups AS (
        SELECT row_no, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY row_no
    ), hosts AS (
        SELECT source, count(DISTINCT text) AS host_docs FROM full_lines GROUP BY source
    ), common AS (
        SELECT f.source, f.key FROM full_lines f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
        GROUP BY f.source, f.key, h.host_docs
        HAVING count(DISTINCT text) > {quality.MAX_DOCS} AND count(DISTINCT text) > {quality.MAX_SHARE} * h.host_docs
    ), removed AS (
        SELECT row_no, sum(line_words) AS removed_words FROM full_lines f
        JOIN common c ON f.source IS NOT DISTINCT FROM c.source AND f.key = c.key GROUP BY row_no
    ), measured AS (
        SELECT docs.doc_id, coalesce(n_words, 0)::BIGINT AS n_words,
               length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
               (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
               coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
               coalesce(removed_words, 0)::BIGINT AS removed_words
        FROM docs LEFT JOIN repeats USING (row_no) LEFT JOIN dups USING (row_no) LEFT JOIN removed USING (row_no)
    ), failed AS (
        SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed
        FROM measured
    )
    SELECT *, NOT base_failed AND n_words - removed_words >= {quality.LEAST_LEFT} * n_words AS kept FROM failed
    """


@query("op2_quality", _QUALITY_SQL)
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"]).drop("removed")


def _mixing_sql(weights: tuple[int, ...], share: float, seed: int) -> str:
    weight = f"list_extract([{', '.join(map(str, weights))}], (source_rank % {len(weights)} + 1)::INTEGER)"
    size = r"CASE WHEN trim(squeezed) = '' THEN 0 ELSE len(string_split(trim(squeezed), ' ')) END"
    passes = " UNION ALL ".join(
        f"SELECT *, {turn} AS turn, md5('{seed}:{turn}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM numbered" for turn in (0, 1)
    )
    return rf"""
    WITH squeezed AS (
        SELECT doc_id, source, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS squeezed FROM documents
    ), numbered AS (
        SELECT doc_id, source, ({size})::BIGINT AS size, row_number() OVER () AS row_no FROM squeezed
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size FROM numbered GROUP BY source
    ), ranked AS (
        SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_rank FROM sources
    ), capped AS (
        SELECT *, {weight} AS weight, 2 * source_size AS cap FROM ranked
    ), levels AS (
        SELECT *, ({share}::DOUBLE * sum(source_size) OVER ()
                   - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM capped
    ), open_level AS (
        SELECT level FROM levels WHERE level * weight < cap ORDER BY cap / weight, source_rank LIMIT 1
    ), targets AS (
        SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM open_level) * weight, cap::DOUBLE)) AS target
        FROM levels
    ), items AS ({passes}), queued AS (
        SELECT items.*, targets.source_size, targets.target,
               CASE WHEN target > 0 THEN sum(size) OVER (
                   PARTITION BY items.source ORDER BY turn, key, doc_id, size, row_no ROWS UNBOUNDED PRECEDING
               )::BIGINT / target END AS finish
        FROM items JOIN targets ON items.source IS NOT DISTINCT FROM targets.source
    ), cut AS (
        SELECT *, sum(size) FILTER (finish IS NOT NULL) OVER (ORDER BY finish NULLS LAST RANGE UNBOUNDED PRECEDING) AS upto FROM queued
    )
    SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size,
           any_value(target) AS target,
           sum(CASE WHEN finish IS NOT NULL AND upto <= {share}::DOUBLE * (SELECT sum(size) FROM numbered) THEN size ELSE 0 END)::BIGINT AS taken
    FROM cut GROUP BY row_no
    """


@query("op3_mixing", _mixing_sql(mixing.WEIGHTS, mixing.SHARE, mixing.SEED))
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op10_near_dedup")
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query("op8_chat")
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    read = chat.read_conversations(chat.format_conversations(turns.union(extra)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "valid",
    )


@query("op7_token_ids")
def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = tokenfiles.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"))
    return ids_crc32(tokenfiles.read_ids(spark, manifest, docs.schema["doc_id"].dataType.simpleString()))


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    rows = langid.identify(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "language.*")


@query("op9_media")
def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.measured(media.encode_texts(table(spark, sf_dir, "documents")))


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


# The parity of a CRC-32 is that of its register: each byte is put in, then eight steps.
_CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""


def _leaf_sql(text: str) -> str:
    values = ["doc_id", "source", "lang", "n_chars", text]
    parts = [f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


_MERKLE_SQL = f"""
    WITH RECURSIVE docs AS (
        SELECT row_number() OVER () AS row_no, doc_id, source, {_leaf_sql("text")} AS leaf,
               CASE WHEN {_CRC32_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS tampered
        FROM documents
    ), placed AS (
        SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               count(*) OVER (PARTITION BY source) AS n FROM docs
    ), nodes AS (
        SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
        UNION ALL
        SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3)
        FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3
    ), subroots AS (SELECT tree, digest AS subroot, level AS height FROM nodes WHERE n = 1
    ), tops AS (
        SELECT 0 AS level, tree AS pos, subroot AS digest, (SELECT count(*) FROM subroots) AS n FROM subroots
        UNION ALL
        SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3)
        FROM tops WHERE n > 1 GROUP BY level, pos // 3
    ), walk AS (
        SELECT row_no, tree, height, false AS top, 0 AS level, pos FROM placed JOIN subroots USING (tree)
        UNION ALL
        SELECT row_no, tree, height, top OR level = height, CASE WHEN NOT top AND level = height THEN 0 ELSE level + 1 END,
               CASE WHEN NOT top AND level = height THEN tree ELSE pos // 3 END
        FROM walk WHERE NOT top OR level < (SELECT max(level) FROM tops)
    ), steps AS (
        SELECT row_no, w.top, w.level, string_agg(m.digest, '' ORDER BY m.pos) AS both_sides,
               coalesce(string_agg(m.digest, '' ORDER BY m.pos) FILTER (m.pos < w.pos), '') AS l,
               coalesce(string_agg(m.digest, '' ORDER BY m.pos) FILTER (m.pos > w.pos), '') AS r
        FROM walk w JOIN (SELECT tree, false AS top, level, pos, digest FROM nodes UNION ALL SELECT NULL, true, level, pos, digest FROM tops) m
          ON w.top = m.top AND (w.top OR w.tree = m.tree) AND w.level = m.level AND w.pos // 3 = m.pos // 3 AND w.pos <> m.pos
        GROUP BY ALL
    ), runs AS (
        SELECT row_no, top, level, coalesce(both_sides, '') AS both_sides, coalesce(l, '') AS l, coalesce(r, '') AS r
        FROM walk LEFT JOIN steps USING (row_no, top, level)
        WHERE CASE WHEN top THEN level < (SELECT max(level) FROM tops) ELSE level < height END
    ), proofs AS (
        SELECT row_no, sha256(string_agg(both_sides, '' ORDER BY top, level)) AS proof_sha256,
               list(l ORDER BY top, level) AS ls, list(r ORDER BY top, level) AS rs FROM runs GROUP BY row_no
    ), folds AS (
        SELECT row_no, tampered AS acc, 1 AS step, coalesce(ls, []) AS ls, rs FROM docs LEFT JOIN proofs USING (row_no)
        UNION ALL
        SELECT row_no, sha256(ls[step] || acc || rs[step]), step + 1, ls, rs FROM folds WHERE step <= len(ls)
    ), folded AS (SELECT row_no, acc AS folded_root FROM folds WHERE step = len(ls) + 1
    ), rooted AS (SELECT digest AS root FROM tops WHERE n = 1)
    SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM placed JOIN subroots USING (tree) JOIN folded USING (row_no) LEFT JOIN proofs USING (row_no), rooted
    """


@query("op13_merkle", _MERKLE_SQL)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hashed = lambda text: merkle.leaf_hash([*[F.col(c) for c in merkle.LEAF_COLUMNS[:-1]], text])
    cut = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaf = hashed(F.col("text"))
    leaves = docs.select(
        "source", "doc_id", leaf.alias("leaf"), F.when(cut, hashed(F.translate("text", "\n", ""))).alias("tampered")
    )
    proofs, root = merkle.prove(leaves)
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    return proofs.select(
        "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.lit(root)).alias("verified"),
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whitening.whiten(table(spark, sf_dir, "embeddings"))
    explained = [] if model is None else [float(v) for v in model.explained]
    per_component = F.array(*[
        F.struct(F.lit(i + 1).alias("component"), F.get("whitened", F.lit(i)).alias("whitened"), F.lit(share).alias("explained"))
        for i, share in enumerate(explained)
    ]).cast("array<struct<component: int, whitened: double, explained: double>>")
    return rows.select("vec_id", "deviation", F.explode(per_component).alias("c")).select(
        "vec_id", "c.component", F.lit(model.n if model else 0).cast("bigint").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(error).alias("identity_error"),
    )


@query("op11_best_fit")
def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    length = swap_packing.SEQUENCE_LENGTH
    pieces = ids_crc32(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), length, swap_packing.END_ID))
    placed = swap_packing.place_pieces(pieces, packing.group_count(docs, swap_packing.GROUP_ROWS), length)
    return placed.select(
        "doc_id", F.expr(f"start div {length}").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset"
    )
