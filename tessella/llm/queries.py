"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, chat, neardup, packing, pieces, pii, repair, simhash, substrings, topk, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.fit(docs))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = toxicity.fit(toxicity.bounded_sample(docs, _table(spark, sf_dir, "labels")), corpus=docs)
    scored = toxicity.score_documents(docs, index)
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(_table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = chat.read_back(chat.format_chats(rows.unionByName(extra)))
    masked = chat.masked_text()
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(_table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.damage(_table(spark, sf_dir, "conversations"))
    return repair.conversations(repair.repair(damaged, copies_col="copies"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_pack": op1_pack, "op4_pii": op4_pii, "op5_toxicity": op5_toxicity, "op6_pieces": op6_pieces, "op2_warc": op2_warc, "op3_simhash": op3_simhash, "op7_repeats": op7_repeats, "op8_top_k": op8_top_k, "op9_near_vectors": op9_near_vectors, "op10_chat_format": op10_chat_format, "op11_bpe": op11_bpe, "op12_repair": op12_repair, "op13_whitening": op13_whitening}


def _escaped_sql(x: str) -> str:
    x = f"replace({x}, '&', '&amp;')"
    for c in chat.CONTROLS:
        x = f"replace({x}, '{c}', '{chat.ENTITIES[c[0]] + c[1:]}')"
    return x


ORACLE_SQL = {
    "op12_repair": r"""
        WITH RECURSIVE k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key, dense_rank() OVER (ORDER BY conv_id) AS cid FROM conversations),
        f AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i::INT, 1))::BIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS f FROM k),
        d AS (SELECT cid, turn, CASE f WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
            unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
        m AS (SELECT *, left(role, 1) AS letter, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY cid, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
            regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut, row_number() OVER w - 1 AS pos, lag(role) OVER w AS before
            FROM d WINDOW w AS (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy)),
        r AS MATERIALIZED (SELECT *, blank OR again AS must, (cut AND NOT blank AND NOT again)::INT AS late FROM m),
        ins AS (SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
            (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])) t(s, s1, c1, a1, t1)),
        edit AS (SELECT * FROM (VALUES (0, 'D', NULL, 0, 3, NULL), (1, 'D', NULL, 1, 3, NULL), (2, 'D', NULL, 2, 3, NULL), (3, 'D', NULL, 3, 3, NULL), (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL),
            (0, 'R', NULL, 2, 2, 'user'), (1, 'R', NULL, 2, 2, 'user'), (2, 'R', NULL, 3, 2, 'assistant'), (3, 'R', NULL, 2, 2, 'user')) t(s1, e, letter, s2, c2, becomes)),
        go AS (SELECT cid, 0::BIGINT AS pos, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'told': []::VARCHAR[]} AS b FROM (SELECT DISTINCT cid FROM r) UNION ALL
            SELECT cid, pos + 1, s2, min(b) FROM (
                SELECT g.cid, g.pos, s2, {'cost': g.b.cost + c1 + c2 + CASE WHEN e = 'D' THEN 0 ELSE late END, 'audit': g.b.audit || a1 || e,
                    'told': list_concat(list_concat(g.b.told, t1), CASE WHEN e = 'D' THEN []::VARCHAR[] ELSE [coalesce(becomes, role) || ':' || text] END)} AS b
                FROM go g JOIN r ON r.cid = g.cid AND r.pos = g.pos JOIN ins ON ins.s = g.s JOIN edit ON edit.s1 = ins.s1 AND (e = 'D' OR NOT must) AND (edit.letter IS NULL OR edit.letter = r.letter))
            GROUP BY ALL),
        n AS (SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(late)::BIGINT AS truncated,
            count(*) FILTER (before IS NOT NULL AND left(before, 1) || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY cid),
        last AS (SELECT cid, min({'cost': b.cost + c, 'audit': b.audit || a, 'told': list_concat(b.told, t)}) AS b FROM go JOIN n USING (cid) JOIN (VALUES (0, 0, '', []::VARCHAR[]), (3, 0, '', []), (2, 2, 'I', ['assistant:']), (1, 4, 'II', ['user:', 'assistant:'])) e(s, c, a, t) USING (s) WHERE pos = n GROUP BY cid)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.told, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT cid, conv_id FROM k) LEFT JOIN n USING (cid) LEFT JOIN last USING (cid)""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT *, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS head FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::INT >> (5 * (3 - i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> head THEN head END AS refers_to FROM d""",
    "op9_near_vectors": """
        WITH RECURSIVE e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reach AS (SELECT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
        c AS (SELECT node AS vec_id, min(root) AS component_id FROM reach GROUP BY node)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
        FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op8_top_k": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 10""",
    "op10_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, {_escaped_sql('role')} AS r, {_escaped_sql('text')} AS b FROM t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r, b)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r, b) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length(r) + length(b) + {len(chat.TURN + chat.BODY + chat.END)})::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
}
