"""The thin queries over the driver's tables, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from soundtable.llm import bpe, decontamination, embedding_dedup, exact_dedup, hmm, language_id, prefix_trie, sharding, simhash, spelling, token_files, toxicity, warc
from soundtable.llm.common import load


def op1_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(load(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return bpe.digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_simhash(spark, sf_dir):
    found = simhash.near_groups(spark, load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontaminate(spark, sf_dir):
    return decontamination.contaminated(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_language_id(spark, sf_dir):
    model = language_id.train(spark, load(spark, sf_dir, "documents"), F.col("text"), F.col("lang"), F.col("doc_id"))
    return language_id.identify_pages(spark, load(spark, sf_dir, "pages"), model)


def _remainder(doc_id, by):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def op5_toxicity(spark, sf_dir):
    documents = load(spark, sf_dir, "documents")
    held_out = _remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(spark, documents, load(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(documents, model, F.col("text"), [F.col("doc_id"), held_out.alias("held_out")])
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_hmm_score(spark, sf_dir):
    held_out = _remainder(F.col("doc_id"), 7) == 2
    return hmm.score_texts(spark, load(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id"), "held_out": held_out}, ~held_out)


def op7_elias_fano(spark, sf_dir):
    files = token_files.write_token_files(spark, load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_exact_dedup(spark, sf_dir):
    found = exact_dedup.exact_groups(spark, load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_warc(spark, sf_dir):
    files = warc.write_warc(spark, load(spark, sf_dir, "pages"))
    return warc.read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_shards(spark, sf_dir):
    placed = sharding.stratified_shards(load(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(spark, load(spark, sf_dir, "conversations"))


def op12_embedding_dedup(spark, sf_dir):
    found = embedding_dedup.near_vectors(spark, load(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op13_spelling(spark, sf_dir):
    return spelling.spelling_variants(spark, load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_decontaminate, op4_language_id, op5_toxicity, op6_hmm_score, op7_elias_fano, op8_exact_dedup, op9_warc, op10_shards, op11_prefix_trie, op12_embedding_dedup, op13_spelling)}

ORACLE_SQL = {
    "op3_decontaminate": r"""
        WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
        ds AS (SELECT id, len(w) AS words, unnest(range(len(w) - 4)) AS p, w FROM d WHERE len(w) >= 5),
        dsh AS (SELECT id, words, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM ds),
        ish AS (SELECT item_id, len(w) AS width, array_to_string(w[p + 1:p + 5], ' ') AS s
                FROM (SELECT item_id, w, unnest(range(len(w) - 4)) AS p FROM i WHERE len(w) >= 5)),
        ic AS (SELECT item_id, width, s, count(*) AS c FROM ish GROUP BY ALL),
        st AS (SELECT DISTINCT id, item_id, width, least(p, greatest(words - width, 0)) AS position FROM dsh JOIN ic USING (s)),
        wc AS (SELECT st.id, item_id, width, position, s, count(*) AS c FROM st
               JOIN dsh ON dsh.id = st.id AND dsh.p BETWEEN position AND position + width - 5 GROUP BY ALL),
        t AS (SELECT id, item_id, position, sum(wc.c) AS n, sum(least(wc.c, coalesce(ic.c, 0))) AS common
              FROM wc LEFT JOIN ic USING (item_id, width, s) GROUP BY ALL),
        m AS (SELECT item_id, sum(c) AS m FROM ic GROUP BY ALL),
        v AS (SELECT id, item_id, position, common::DOUBLE / (n + m - common)::DOUBLE AS similarity FROM t JOIN m USING (item_id))
        SELECT id AS doc_id, item_id, max(similarity) AS similarity, arg_max(position, (similarity, -position)) AS position
        FROM v WHERE similarity >= 0.8 GROUP BY ALL""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex,
                     max(page_id) OVER (PARTITION BY html) AS top FROM p),
        b AS (SELECT *, list_reduce(list_transform(range(40), lambda i:
                lpad(bin(strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM g)
        SELECT page_id, payload_bytes,
               list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
                 + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT + 1, 1)), lambda x, y: x || y) AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM b""",
    "op10_shards": """
        WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
                lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
        d AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h,
                     md5('1:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
        c AS (SELECT doc_id, source, draw, length(h) // 2 + 8 AS size,
                xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2),
                  lambda i: 16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)),
                  lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS text_crc32 FROM d, tbl),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, text_crc32, size) - 1 AS k,
                     count(*) OVER (PARTITION BY source) AS n FROM c),
        p AS (SELECT *, row_number() OVER (ORDER BY (k + 0.5::DOUBLE) / n, source, draw, doc_id, text_crc32, size) - 1 AS position,
                     count(*) OVER () AS total FROM r)
        SELECT doc_id, size, text_crc32, 'rows' AS law, (position * 24 // total)::INT AS shard,
               position - ((position * 24 // total) * total + 23) // 24 AS slot, NULL::INT AS grown_shard
        FROM p""",
    "op11_prefix_trie": r"""
        WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
                lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
        c AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        h AS (SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295], list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)),
                lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % 4 AS h FROM c, tbl),
        r AS (SELECT h.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE list_slice(b.turns, 1, h) END, list_slice(h.turns, h + 1, len(h.turns))) AS t
              FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
        m AS (SELECT conv_id, d, list_slice(t, 1, d) AS p, len(t) = d AS ends FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM r)),
        n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
        w AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(p[d].text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS words FROM n),
        k AS (SELECT w.*, u.conv_id AS parent_conv_id FROM w LEFT JOIN w u ON u.d = w.d - 1 AND u.p = list_slice(w.p, 1, w.d - 1)),
        f AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS n_children FROM w WHERE d > 0 GROUP BY 1, 2),
        g AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN f USING (p, d)),
        s AS (SELECT list_slice(p, 1, up) AS p, up AS d, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
              FROM (SELECT *, unnest(range(d + 1)) AS up FROM g) GROUP BY 1, 2)
        SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
        FROM g JOIN s USING (p, d)""",
    "op12_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER () AS row FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        link AS (SELECT a.row AS a, b.row AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.row <> b.row
                 WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
        reach(a, b) AS (SELECT row, row FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
        c AS (SELECT reach.a AS row, min(v.vec_id) AS component_id FROM reach JOIN v ON v.row = reach.b GROUP BY 1),
        n AS (SELECT a AS row, count(*) AS n FROM link GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (row) LEFT JOIN n USING (row)""",
}
