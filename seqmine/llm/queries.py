"""The queries of the text operators on the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmine.llm import bpe, hard_negatives, html_text, merkle, minhash, mixing, packing, quality_model, quality_rules, token_files, url_rules, vector_dups, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    found = quality_rules.judge(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_vector_dups(spark: SparkSession, d: str) -> DataFrame:
    return vector_dups.near_duplicates(table(spark, d, "embeddings"))


def op3_warc(spark: SparkSession, d: str) -> DataFrame:
    found = warc.write_and_read(table(spark, d, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, d, "documents")))


def op5_token_files(spark: SparkSession, d: str) -> DataFrame:
    found = token_files.write_and_read(table(spark, d, "documents"))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.crc32("ids").alias("ids_crc32"))


def op6_html_text(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract(table(spark, d, "pages"))


def op7_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents"), words=4)


def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    return pieces(packing.pack(table(spark, d, "documents")))


def pieces(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op9_url_rules(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    rules = url_rules.mine(labelled_urls(pages, table(spark, d, "labels")))
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls whose last number names a labelled document; bad ones are of low quality or toxic."""
    named = url_rules.split_url(pages.select("url")).select(
        "url", F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long").alias("doc_id"))
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return named.where("doc_id is not null").join(known, "doc_id").select("url", bad.alias("bad"))


def op10_quality_model(spark: SparkSession, d: str) -> DataFrame:
    found = quality_model.classify(table(spark, d, "documents"), table(spark, d, "labels"))
    return found.select("doc_id", "quality_score", "kept")


def op11_mixing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = mixing.mix(docs, mixing.dealt(docs, "source", (5, 2, 1)), keep=["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op12_merkle(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose key has an even checksum lose the line feeds of their text before they are verified."""
    docs = table(spark, d, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    stripped = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in columns]
    shown = F.when(even, merkle.digest(merkle.spelled(stripped)))
    found = merkle.manifest(docs, columns=columns, more=[shown.alias("shown")])
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("shown", "leaf"), F.col("path")))
    return found.select("doc_id", hexed("leaf"), hexed("subroot"), hexed("root"), merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.lower(F.hex("root"))).alias("verified"))


def op13_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth row is an anchor; every seventh has a wrong label."""
    rows = table(spark, d, "embeddings")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(sound).select("vec_id", label.alias("label"), F.transform(
        "embedding", lambda x: F.floor(F.lit(256) * x.cast("double"))).alias("v"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Query]:
    found = (op1_quality_rules, op2_vector_dups, op3_warc, op4_bpe, op5_token_files, op6_html_text, op7_minhash, op8_packing,
             op9_url_rules, op10_quality_model, op11_mixing, op12_merkle, op13_hard_negatives)
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    """SQL for the queries that SQL expresses over whole tables; the others are tested against brute force."""
    return {"op1_quality_rules": OP1, "op3_warc": OP3, "op11_mixing": OP11, "op12_merkle": OP12, "op13_hard_negatives": OP13}


OP1 = r"""
WITH f AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_transform(range(0, len(w) - 7), lambda i: array_to_string(w[i + 1:i + 8], ' ')) AS s FROM f WHERE len(w) >= 8
), e AS (
  SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM s
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM e) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(8) AS x(k) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM f)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), b AS (
  SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
         coalesce(l.n_lines, 0) AS n_lines, coalesce(c.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^!]', '', 'g')) AS shouts, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals
  FROM f LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
), v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 20 > word_chars OR n_dup_lines * 2 > n_lines
            OR shouts * 20 > word_chars OR capitals * 3 > word_chars) AS kept
FROM v
"""

OP3 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""

OP11 = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(md5(text), '-')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w
  FROM f GROUP BY source
), c AS (
  SELECT w, source_size, k, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY k
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lam
  FROM (SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source) AS k FROM s)
), v AS (
  SELECT arg_min(lam, k) AS lam FROM c WHERE w::DOUBLE * lam <= 2.0::DOUBLE * source_size
), p AS (
  SELECT source, source_size, n, CASE WHEN w::DOUBLE * lam > 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size ELSE w::DOUBLE * lam END AS target,
         CASE WHEN n <= 512 THEN 0 ELSE length(bin((n - 1) // 512)) END AS bits
  FROM s, v
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM p
), r AS (
  SELECT *, greatest(0, CAST(floor(target - whole * source_size) AS BIGINT)) AS rest FROM q
), b AS (
  SELECT f.*, r.* EXCLUDE (source), f.h >> CAST(60 - bits AS INT) AS bucket FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
), u AS (
  SELECT source, bucket, rest, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) AS after, sum(size) AS own FROM b GROUP BY source, bucket, rest
), x AS (
  SELECT source, min(bucket) AS border, CAST(min(rest) - arg_min(after - own, bucket) AS BIGINT) AS room FROM u WHERE after > rest GROUP BY source
), y AS (
  SELECT b.source, doc_id, h, size, room, row_number() OVER (PARTITION BY b.source ORDER BY h, size, doc_id) AS i
  FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source AND bucket = border WHERE size > 0
), walk AS (
  SELECT source, doc_id, h, size, i, size <= room AS hit, CASE WHEN size <= room THEN room - size ELSE room END AS room FROM y WHERE i = 1
  UNION ALL
  SELECT y.source, y.doc_id, y.h, y.size, y.i, y.size <= w.room, CASE WHEN y.size <= w.room THEN w.room - y.size ELSE w.room END
  FROM walk w JOIN y ON y.source IS NOT DISTINCT FROM w.source AND y.i = w.i + 1
), z AS (
  SELECT *, NOT hit AND row_number() OVER (PARTITION BY source, hit ORDER BY size, h) = 1
            AND size - arg_max(room, i) OVER (PARTITION BY source) < arg_max(room, i) OVER (PARTITION BY source) AS over FROM walk
)
SELECT b.doc_id, b.size, source_size, target,
       b.size * CAST(whole + CASE WHEN border IS NOT NULL AND (bucket < border OR z.hit OR z.over) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM b LEFT JOIN x ON b.source IS NOT DISTINCT FROM x.source
LEFT JOIN z ON b.source IS NOT DISTINCT FROM z.source AND b.doc_id = z.doc_id AND b.h = z.h AND b.size = z.size
"""

OP12 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda a, x: list_reduce(list_concat([xor(a, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda e, k: xor(e >> 1, (e & 1) * 3988292384))) AS crc
  FROM documents
), l AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(CASE WHEN (crc & 1) = 1 THEN replace(text, chr(10), '') ELSE text END)) || ':'
                || CASE WHEN (crc & 1) = 1 THEN replace(text, chr(10), '') ELSE text END, '-')) AS shown
  FROM d
), o AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l
), tree AS (
  SELECT t, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM o
  UNION ALL
  SELECT t, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY t, lvl, i // 3, n
), subroot AS (SELECT t, h FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, t AS i, h, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY lvl, i // 3, n
), sides AS (
  SELECT a.t, a.lvl, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS pre, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS post
  FROM (SELECT t, lvl, i, h, n FROM tree WHERE n > 1 UNION ALL SELECT -1, lvl, i, h, n FROM upper WHERE n > 1) a
  JOIN (SELECT t, lvl, i, h, n FROM tree WHERE n > 1 UNION ALL SELECT -1, lvl, i, h, n FROM upper WHERE n > 1) b
    ON a.t = b.t AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 GROUP BY ALL
), climb AS (
  SELECT doc_id, leaf, t AS home, t, 0 AS lvl, i, (SELECT max(n) FROM tree x WHERE x.t = o.t AND x.lvl = 0) AS n, shown AS h, '' AS proof FROM o
  UNION ALL
  SELECT doc_id, leaf, home, CASE WHEN c.n = 1 THEN -1 ELSE c.t END, CASE WHEN c.n = 1 THEN 0 ELSE c.lvl + 1 END, CASE WHEN c.n = 1 THEN c.t ELSE c.i // 3 END,
         CASE WHEN c.n = 1 THEN (SELECT count(*) FROM subroot) ELSE (c.n + 2) // 3 END,
         CASE WHEN c.n = 1 THEN c.h ELSE sha256(s.pre || c.h || s.post) END, CASE WHEN c.n = 1 THEN c.proof ELSE c.proof || s.pre || s.post END
  FROM climb c LEFT JOIN sides s ON s.t = c.t AND s.lvl = c.lvl AND s.i = c.i WHERE NOT (c.t = -1 AND c.n = 1)
)
SELECT doc_id, leaf, subroot.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, climb.h AS folded_root, climb.h = r.h AS verified
FROM climb JOIN subroot ON subroot.t = home, (SELECT h FROM upper WHERE n = 1) r WHERE climb.t = -1 AND climb.n = 1
"""

OP13 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.b AS negative_id, p.score AS positive_score,
       s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)
QUALIFY row_number() OVER w <= 10
"""
