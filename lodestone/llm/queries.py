"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, chat_format, collocations, fill_in_middle, fingerprints, language_id, license_scan, packing, quality_classifier, quality_rules, simhash, token_files, warc
from lodestone.llm.shared import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's perspective."""
    return chat_format.perspectives(table(spark, sf_dir, "conversations"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows whose crc32 modulo 4 is 2 take no part in the fit."""
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    texts = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return language_id.identify(texts, net, keep=["doc_id", "held_out"])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model, keep=["doc_id"])


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits("simhash").alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows whose crc32 modulo 5 is 0 take no part in the fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    texts = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return quality_classifier.classify(texts, model, keep=["doc_id", "held_out"])


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, and how alike they and the next document's are."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written, indexed and read back."""
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of the documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files of fixed bit width and read back from them."""
    index = token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(index).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in the middle, and rebuilt from that."""
    coded = fill_in_middle.transform(table(spark, sf_dir, "documents"), keep=["doc_id"])
    coded = coded.withColumn("output_sha256", F.sha2("output", 256))
    return fill_in_middle.restore(coded).withColumn("restored_sha256", F.sha2("restored", 256)).drop("restored")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_perspectives": op1_chat_perspectives,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_license_scan": op4_license_scan,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_fingerprints": op9_fingerprints,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_token_files": op12_token_files,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op1_chat_perspectives": """
        WITH s AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS s, coalesce(text, '') AS content FROM conversations),
        c AS (SELECT DISTINCT conv_id, s AS perspective FROM s WHERE s <> 'system'),
        m AS (SELECT s.conv_id, perspective, turn, s,
                     CASE WHEN s = 'system' THEN 'system' WHEN s = perspective THEN 'assistant' ELSE 'user' END AS role,
                     CASE WHEN s <> 'system' AND s <> perspective THEN s END AS name, content,
                     CASE WHEN s <> 'system' AND s = perspective THEN 1 ELSE 0 END AS mask
              FROM s JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id),
        r AS (SELECT *, '<|' || concat_ws(' ', role, name) || '|>' || chr(10) || content || '<|end|>' || chr(10) AS rendered FROM m)
        SELECT conv_id, perspective, turn, role, name, content, rendered, CAST(mask AS INTEGER) AS mask,
               CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, s, left(sha256(content), 32)
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
               CAST(length(rendered) AS BIGINT) AS length
        FROM r
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
        FROM f
    """,
    "op11_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        o AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k)),
        f AS (SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM o GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, p, f AS a FROM f WHERE k >= 2 AND f >= 100),
        u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
        s AS (SELECT u.lang, u.p, u.a, x.f AS l, y.f AS r, n.n, u.cut, CAST((1000::HUGEINT * u.a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
              FROM u JOIN f x ON x.lang = u.lang AND x.k = u.cut AND x.p = u.p[1:u.cut] JOIN f y ON y.lang = u.lang AND y.k = u.k - u.cut AND y.p = u.p[u.cut + 1:] JOIN n ON n.lang = u.lang),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
        v AS (SELECT lang, p[i:j] AS p, max(a) AS longer FROM c, range(1, 6) t(i), range(1, 6) z(j) WHERE j <= k AND j - i + 1 BETWEEN 2 AND k - 1 GROUP BY ALL),
        q AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score FROM b LEFT JOIN v ON v.lang = b.lang AND v.p = b.p WHERE v.longer IS NULL OR 100 * v.longer < 100 * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM q QUALIFY rank <= 2000
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS s,
                          regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
        h AS (SELECT doc_id, text, t, len(t) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS x, coalesce(array_to_string(t[a + 1:b], ''), '') AS y, coalesce(array_to_string(t[b + 1:], ''), '') AS z FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
}
