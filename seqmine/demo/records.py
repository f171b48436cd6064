"""Queries for decoding, classification, text indexes and record files."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqmine.demo import conventions as c
from seqmine.functions import rational as ra
from seqmine.functions.bits import SYNC_HEX
from seqmine.operators import classify as cl, items as it
from seqmine.session import scratch_path
from seqmine.sources import export, index_text, layout, records


def headers(spark, d):
    e = c.table(spark, d, "events").select("event_id", "user_id")
    pad = lambda col: F.lpad(col.cast("string"), 2, "0")
    sync = (F.when(F.col("user_id") % 11 == 0, F.lit("00" * 12))
            .when(F.col("user_id") % 3 == 0, F.lit("00FFAAFFFFFFFFFFFFFFFF00")).otherwise(F.lit(SYNC_HEX)))
    raw = F.concat(sync, pad(F.floor(F.col("event_id") / 4500) % 100), F.lpad(F.hex(F.col("event_id") % 256), 2, "0"),
                   pad(F.col("event_id") % 75), pad(F.col("event_id") % 4))
    out = cl.decode_header(e.withColumn("raw", raw))
    return out.select("event_id", F.col("sync_errors").cast("bigint").alias("sync_errors"), "header_pos",
                      F.col("mode").cast("bigint").alias("mode"), "is_audio")


def bits(spark, d):
    e = c.table(spark, d, "events").select("event_id", (F.col("event_id") % 256).alias("b"))
    out = cl.decode_bits(e, "b").withColumn("submode_ok", cl.submode_valid(F.col("b")))
    return out.withColumn("coding_ok", cl.coding_valid(F.col("b"))).drop("b")


def copies(spark, d):
    t = c.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("qty1"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc1"))
    t = t.withColumn("qty2", F.when(F.col("l_linenumber") > 4, F.col("qty1") + F.col("l_linenumber")).otherwise(F.col("qty1")))
    t = t.withColumn("disc2", F.when(F.col("qty1") % 3 == 0, F.col("disc1") - 2).otherwise(F.col("disc1")))
    return cl.reconcile_copies(t, [cl.Copies("quantity", "qty1", "qty2", lambda x: x <= 50),
                                   cl.Copies("discount", "disc1", "disc2", lambda x: x.between(0, 9))])


def redundancy(spark, d):
    v = c.table(spark, d, "embeddings")
    sign = lambda start: F.transform(F.slice("embedding", start, 32), lambda x: x > 0)
    return cl.redundancy_score(v, sign(1), sign(33), 32).select("vec_id", "errors", "probability")


def constant(spark, d):
    v = c.table(spark, d, "embeddings")
    loud = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) > 0.25, 1).otherwise(0))
    return v.select("vec_id", cl.is_constant(loud).alias("silent"))


def _rules():
    return [
        cl.Rule("null promo", (F.col("p_type") == "PROMO") & (F.col("p_size") > 40), produces=False),
        cl.Rule("promo", F.col("p_type") == "PROMO", probability=90),
        cl.Rule("large", F.col("p_size") >= 25, probability=F.col("p_size") * 2),
        cl.Rule("never", F.col("p_size") < 25, probability=0),
        cl.Rule("cold", F.col("p_name").startswith("cold"), probability=50, fields={"brand": F.col("p_brand")}),
    ]


def classified(spark, d):
    part = c.table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    return cl.classify(part, _rules()).select("p_partkey", "claim", "class", "probability", "brand")


def class_counts(spark, d):
    e = c.table(spark, d, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("class"))
    return cl.count_classes(e)


def lookups(spark, d):
    t = c.table(spark, d, "lineitem")
    mark = F.element_at(F.array(*[F.lit(x) for x in ("", "@", "#", " @", "x", "#", "")]), F.col("l_linenumber"))
    text = F.concat(mark, F.col("l_orderkey").cast("string"),
                    F.when(F.col("l_returnflag") == "R", F.concat(F.lit("."), F.col("l_linenumber").cast("string")))
                    .when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.lit(".")))
    out = t.select(text.alias("text")).withColumn("p", cl.parse_number_lookup(F.col("text")))
    return out.groupBy("text").agg(F.min("p.system").alias("system"), F.min("p.value").alias("value"), F.min("p.dup").alias("dup"),
                                   F.count(F.lit(1)).alias("rows"))


def fractions(spark, d):
    o = c.table(spark, d, "orders").select(
        "o_orderkey", ra.rational(F.round(F.col("o_totalprice") * 100).cast("bigint"), F.col("o_custkey") + 1).alias("a"),
        ra.rational(-F.col("o_orderkey"), F.lit(-12).cast("bigint")).alias("b"))
    out = o.select("o_orderkey", "a", "b", ra.add(F.col("a"), F.col("b")).alias("sum"),
                   ra.multiply(F.col("a"), F.col("b")).alias("product"),
                   ra.subtract(F.col("a"), F.col("b")).alias("difference"),
                   ra.divide(F.col("b"), F.col("a")).alias("quotient"),
                   ra.compare(F.col("a"), F.col("b")).alias("order"), ra.nearest(F.col("a")).alias("nearest"))
    text = lambda x: F.concat_ws("/", F.col(f"{x}.num").cast("string"), F.col(f"{x}.den").cast("string"))
    return out.select("o_orderkey", *[text(x).alias(x) for x in ("a", "b", "sum", "product", "difference", "quotient")],
                      F.col("order").cast("bigint").alias("order"), "nearest")


def exported(spark, d):
    t = c.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return records.export_range(t, 100, 900, "l_orderkey")


def listing(spark, d):
    e = c.table(spark, d, "events").select(F.col("user_id").alias("src"), F.col("event_id").alias("pos"),
                                           F.when(F.col("event_type") != "error", F.col("event_type")).alias("class"), "props")
    return export.export_listing(e, detail=F.col("props"))


def manifest(spark, d):
    doc = c.table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    out = export.artifact_manifest(doc, base=F.col("source"), extension=F.col("lang"), content=F.col("text"),
                                   width=F.col("n_chars"), height=F.length("text"), number=F.col("doc_id"))
    return out.select("doc_id", "artifact", "digest")


def _index_lines(spark, d):
    """Events as index lines, some of them damaged according to their type and value."""
    e = c.table(spark, d, "events")
    ident, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    good = F.concat(F.lit("#:"), ident, F.lit("|ID:u"), user, F.lit("|Type:"), F.col("event_type"), F.lit("|Sectors:"),
                    user, F.lit("-"), ident, F.lit("|Rate:"), ident, F.lit("/7|Loop:"),
                    F.when(F.col("user_id") % 2 == 0, "YES").otherwise("no"))
    line = (F.when((F.col("event_type") == "error") & (F.col("value") < 20), F.concat(F.lit(";"), good))
            .when((F.col("event_type") == "error") & (F.col("value") < 40), F.concat(F.lit("Filename:"), user))
            .when((F.col("event_type") == "error") & (F.col("value") < 60), F.lit("  "))
            .when((F.col("event_type") == "click") & (F.col("value") < 20), F.concat(good, F.lit("|ID:again")))
            .when((F.col("event_type") == "click") & (F.col("value") < 40), F.concat(good, F.lit("|broken")))
            .when((F.col("event_type") == "click") & (F.col("value") < 60), F.concat(good, F.lit("|:nokey")))
            .when((F.col("event_type") == "view") & (F.col("value") < 30), F.concat(F.lit("#:"), ident, F.lit("|Type:view")))
            .when((F.col("event_type") == "view") & (F.col("value") < 60), F.regexp_replace(good, "/7", "-7"))
            .otherwise(good))
    return e.select("event_id", line.alias("line"))


INDEX_LINES = """good AS (
  SELECT *, '#:' || event_id || '|ID:u' || user_id || '|Type:' || event_type || '|Sectors:' || user_id || '-' || event_id ||
            '|Rate:' || event_id || '/7|Loop:' || CASE WHEN user_id % 2 = 0 THEN 'YES' ELSE 'no' END AS g FROM events),
kinds AS (
  SELECT *, CASE WHEN event_type = 'error' AND value < 20 THEN 'comment' WHEN event_type = 'error' AND value < 40 THEN 'source'
                 WHEN event_type = 'error' AND value < 60 THEN 'blank'
                 WHEN (event_type = 'click' AND value < 60) OR (event_type = 'view' AND value < 30) THEN 'bad' ELSE 'item' END AS kind,
         CASE WHEN event_type = 'click' AND value < 20 THEN 'duplicate key' WHEN event_type = 'click' AND value < 40 THEN 'field'
              WHEN event_type = 'click' AND value < 60 THEN 'empty key' WHEN event_type = 'view' AND value < 30 THEN 'missing key' END AS reason
  FROM good)"""


def index_read(spark, d):
    out = index_text.parse_lines(_index_lines(spark, d))
    return out.select("event_id", "kind", "reason", F.size(F.map_keys("fields")).cast("bigint").alias("keys"),
                      F.try_element_at("fields", F.lit("Sectors")).alias("sectors"))


def typed(spark, d):
    items = index_text.parse_lines(_index_lines(spark, d)).where("kind = 'item'")
    out = index_text.typed_fields(items, {"#": "long", "Sectors": "range", "Rate": "fraction", "Loop": "yes_no"})
    return out.select("event_id", F.col("#").alias("number"), F.col("Sectors_1").alias("low"), F.col("Sectors_2").alias("high"),
                      F.col("Rate_1").alias("num"), F.col("Rate_2").alias("den"), F.col("Loop").alias("looped"), "error")


def _rendered(spark, d):
    orders = c.order_items_table(spark, d).join(
        c.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prio"),
                                           "o_totalprice"), "id")
    items = it.order_items(orders.withColumn("src", F.substring("prio", 1, 1)).withColumn(
        "start", F.when(F.col("o_totalprice") < 5000, F.lit(-1).cast("bigint")).otherwise(F.col("start"))),
        rows=c.ITEMS_PER_BLOCK)
    items = items.withColumn("item_id", F.concat(F.lit("order["), F.col("id").cast("string"), F.lit("]")))
    note = F.when(F.col("o_totalprice") > 400000, F.lit("a|b")).when(F.col("o_totalprice") > 300000, F.lit("high"))
    return index_text.render_items(items, [("Priority", F.col("prio")), ("Note", note)])


def index_written(spark, d):
    """Writes the index of all orders and reads it back."""
    path = scratch_path(spark, "index")
    index_text.write_index(_rendered(spark, d), path)
    items, _ = index_text.read_index(spark, path)
    return items.select(F.col("src").cast("bigint").alias("src"), "line", F.col("fields")["ID"].alias("item_id"))


def index_refused(spark, d):
    return _rendered(spark, d).where("problem is not null").select("id", "problem")


RENDERED = """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY "start",
           CASE kind WHEN 'file' THEN 1 WHEN 'video' THEN 2 ELSE 3 END, kind, "end" DESC, id) - 1 AS number
  FROM (SELECT i.id, i."end", i.kind, CASE WHEN o_totalprice < 5000 THEN -1 ELSE i."start" END AS "start",
               CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS src, o_orderpriority AS prio, o_totalprice
        FROM order_items i JOIN orders ON o_orderkey = i.id)),
rendered AS (
  SELECT *, 'order[' || id || ']' AS item_id,
         CASE WHEN "start" < 0 THEN 'negative range' WHEN o_totalprice > 400000 THEN 'illegal character' END AS problem,
         '#:' || number || '|ID:order[' || id || ']|Type:' || kind || '|Sectors:' || "start" || '-' || "end" ||
         '|Priority:' || prio || CASE WHEN o_totalprice > 300000 THEN '|Note:high' ELSE '' END AS line
  FROM ordered)"""

RECORD_WIDTH = 64


def records_read(spark, d):
    """Writes all events as fixed-width records, reads the files back and decodes them."""
    e = c.table(spark, d, "events")
    pad = lambda col, n: F.rpad(col.cast("string"), n, " ")
    raw = F.concat(pad(F.col("event_id"), 16), pad(F.col("user_id"), 16), pad(F.col("event_type"), 32))
    path = scratch_path(spark, "records")
    records.write_records(e.select(raw.cast("binary").alias("raw"), "event_id"), "raw", path, order=["event_id"], width=RECORD_WIDTH)
    got = records.read_records(spark, path, RECORD_WIDTH, split_bytes=1 << 20)
    part = lambda i, n: F.rtrim(F.substring("raw", i, n).cast("string"))
    return got.select(part(1, 16).cast("bigint").alias("event_id"), part(17, 16).cast("bigint").alias("user_id"),
                      part(33, 32).alias("event_type"))


LAYOUTS = {"en": 2352, "de": 2448, "fr": 2336}


def layouts(spark, d):
    """Writes all documents as record files of four layouts and detects them."""
    docs = c.table(spark, d, "documents").select("lang", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"))
    # A lead in of sync and header, of two sub-headers, or none; the digest; zeros; newline.
    lead = {"en": SYNC_HEX + "00020001", "de": SYNC_HEX + "00020002", "fr": "0100640001006400"}
    raw = None
    for lang, width in [*LAYOUTS.items(), (None, 2048)]:
        front = lead.get(lang, "")
        zeros = width - len(front) // 2 - 16 - 1
        body = F.concat(F.unhex(F.lit(front)), F.unhex(F.lit("00" * zeros)), F.col("digest"), F.unhex(F.lit("0A")))
        if lang is None:
            raw = raw.otherwise(body)
        else:
            raw = (F if raw is None else raw).when(F.col("lang") == lang, body)
    path = scratch_path(spark, "layouts")
    records.write_records(docs.withColumn("raw", raw), "raw", path, partition_by="lang")
    files = spark.createDataFrame([(p,) for p, _ in records.list_files(path)], "path string")
    found = layout.detect_layout(files)
    return (found.groupBy(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), "width", "offset")
            .agg(F.sum(F.floor((F.col("size") - F.col("offset")) / F.col("width"))).alias("records")))


QUERIES = {
    "decode_header": headers,
    "decode_bits": bits,
    "reconcile_copies": copies,
    "redundancy_score": redundancy,
    "is_constant": constant,
    "classify": classified,
    "count_classes": class_counts,
    "parse_number_lookup": lookups,
    "rational": fractions,
    "export_range": exported,
    "export_listing": listing,
    "artifact_manifest": manifest,
    "read_index": index_read,
    "typed_fields": typed,
    "write_index": index_written,
    "write_index_refused": index_refused,
    "read_records": records_read,
    "detect_layout": layouts,
}

_FLAGS = ", ".join(f"(event_id % 256 >> {s}) & 1 AS {n}" for n, (s, _) in cl.SUBMODE_BITS.items())

ORACLES = {
    "decode_header": """
WITH h AS (SELECT event_id, user_id, event_id % 256 AS b, event_id % 75 AS f, event_id // 4500 % 100 AS m FROM events)
SELECT event_id, CAST(CASE WHEN user_id % 11 = 0 THEN 10 WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS sync_errors,
       CASE WHEN b % 16 <= 9 AND b // 16 <= 9 THEN m * 4500 + (b // 16 * 10 + b % 16) * 75 + f - 150 END AS header_pos,
       event_id % 4 AS mode, event_id % 4 NOT IN (1, 2) OR user_id % 11 = 0 AS is_audio FROM h""",
    "decode_bits": f"""
SELECT event_id, {_FLAGS},
       ((event_id >> 1) & 1) + ((event_id >> 2) & 1) + ((event_id >> 3) & 1) <= 1 AS submode_ok,
       (event_id % 256 & 42) = 0 AS coding_ok FROM events""",
    "reconcile_copies": """
WITH t AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty1, CAST(round(l_discount * 100) AS BIGINT) AS disc1,
         CASE WHEN l_linenumber > 4 THEN CAST(l_quantity AS BIGINT) + l_linenumber ELSE CAST(l_quantity AS BIGINT) END AS qty2,
         CASE WHEN CAST(l_quantity AS BIGINT) % 3 = 0 THEN CAST(round(l_discount * 100) AS BIGINT) - 2
              ELSE CAST(round(l_discount * 100) AS BIGINT) END AS disc2 FROM lineitem),
v AS (SELECT *, qty1 <= 50 AS q1, qty2 <= 50 AS q2, disc1 BETWEEN 0 AND 9 AS d1, disc2 BETWEEN 0 AND 9 AS d2 FROM t),
b AS (SELECT *, CASE WHEN qty1 = qty2 OR q1 = q2 THEN 0 WHEN q1 THEN 1 ELSE -1 END +
                CASE WHEN disc1 = disc2 OR d1 = d2 THEN 0 WHEN d1 THEN 1 ELSE -1 END AS balance FROM v)
SELECT l_orderkey, l_linenumber, qty1, disc1, qty2, disc2,
       CASE WHEN qty1 = qty2 THEN qty1 WHEN q1 <> q2 THEN CASE WHEN q1 THEN qty1 ELSE qty2 END
            WHEN balance >= 0 THEN qty1 ELSE qty2 END AS quantity,
       CASE WHEN disc1 = disc2 THEN disc1 WHEN d1 <> d2 THEN CASE WHEN d1 THEN disc1 ELSE disc2 END
            WHEN balance >= 0 THEN disc1 ELSE disc2 END AS discount,
       CAST(CASE WHEN qty1 = qty2 THEN 0 ELSE 1 END + CASE WHEN disc1 = disc2 THEN 0 ELSE 1 END AS BIGINT) AS issues
FROM b""",
    "redundancy_score": """
WITH cells AS (SELECT vec_id, unnest(embedding) > 0 AS pos, generate_subscripts(embedding, 1) AS i FROM embeddings),
e AS (SELECT a.vec_id, count(*) FILTER (a.pos <> b.pos) AS errors FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND b.i = a.i + 32
      GROUP BY 1)
SELECT vec_id, errors, 100 - errors * 100 // 32 AS probability FROM e""",
    "is_constant": """
SELECT vec_id, bool_and(abs(CAST(x AS DOUBLE)) <= 0.25) AS silent
FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1""",
    "classify": """
SELECT p_partkey,
       CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN 'null promo' WHEN p_type = 'PROMO' THEN 'promo' WHEN p_size >= 25 THEN 'large'
            WHEN p_name LIKE 'cold%' THEN 'cold' END AS claim,
       CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN NULL WHEN p_type = 'PROMO' THEN 'promo' WHEN p_size >= 25 THEN 'large'
            WHEN p_name LIKE 'cold%' THEN 'cold' END AS class,
       CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN 100 WHEN p_type = 'PROMO' THEN 90 WHEN p_size >= 25 THEN p_size * 2
            WHEN p_name LIKE 'cold%' THEN 50 END AS probability,
       CASE WHEN p_type <> 'PROMO' AND p_size < 25 AND p_name LIKE 'cold%' THEN p_brand END AS brand FROM part""",
    "count_classes": """
SELECT CASE WHEN event_type = 'error' THEN 'Unknown' ELSE event_type END AS class, count(*) AS records FROM events GROUP BY 1""",
    "parse_number_lookup": """
WITH t AS (
  SELECT ['', '@', '#', ' @', 'x', '#', ''][l_linenumber] || l_orderkey ||
         CASE l_returnflag WHEN 'R' THEN '.' || l_linenumber WHEN 'A' THEN '' ELSE '.' END AS text,
         CASE l_linenumber WHEN 2 THEN 'sector' WHEN 4 THEN 'sector' WHEN 3 THEN 'header' WHEN 6 THEN 'header' ELSE 'index' END AS system,
         l_orderkey AS value, CASE l_returnflag WHEN 'R' THEN CAST(l_linenumber AS BIGINT) ELSE 0 END AS dup,
         l_linenumber <> 5 AND l_returnflag <> 'N' AS ok FROM lineitem)
SELECT text, min(system) FILTER (ok) AS system, min(value) FILTER (ok) AS value, min(dup) FILTER (ok) AS dup, count(*) AS "rows"
FROM t GROUP BY 1""",
    "rational": """
WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p, o_custkey + 1 AS q FROM orders),
r AS (SELECT o_orderkey, p // gcd(p, q) AS an, q // gcd(p, q) AS ad, o_orderkey // greatest(gcd(o_orderkey, 12), 1) AS bn,
             12 // greatest(gcd(o_orderkey, 12), 1) AS bd FROM o),
w AS (SELECT *, an * bd + bn * ad AS sn, ad * bd AS sd, an * bn AS pn, an * bd - bn * ad AS dn, bn * ad AS qn, bd * an AS qd FROM r)
SELECT o_orderkey, an || '/' || ad AS a, bn || '/' || bd AS b,
       sn // gcd(sn, sd) || '/' || sd // gcd(sn, sd) AS "sum", pn // gcd(pn, sd) || '/' || sd // gcd(pn, sd) AS product,
       dn // gcd(dn, sd) || '/' || sd // gcd(dn, sd) AS difference, qn // gcd(qn, qd) || '/' || qd // gcd(qn, qd) AS quotient,
       CAST(sign(dn) AS BIGINT) AS "order", (2 * an + ad) // (2 * ad) AS nearest FROM w""",
    "export_range": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900",
    "export_listing": """
SELECT user_id AS src, event_id AS pos, '[' || user_id || ':' || event_id || '] ' ||
       CASE WHEN event_type = 'error' THEN 'Unknown' ELSE event_type END || ' ' || props AS line FROM events""",
    "artifact_manifest": """
SELECT doc_id, source || '_' || n_chars || 'x' || length(text) || '[' || doc_id || '].' || lang AS artifact, md5(text) AS digest
FROM documents""",
    "read_index": c.with_(INDEX_LINES) + """
SELECT event_id, kind, reason, CASE WHEN kind = 'item' THEN CAST(6 AS BIGINT) END AS keys,
       CASE WHEN kind = 'item' THEN user_id || '-' || event_id END AS sectors FROM kinds""",
    "typed_fields": c.with_(INDEX_LINES) + """
, i AS (SELECT *, event_type = 'view' AND value < 60 AS spoiled FROM kinds WHERE kind = 'item')
SELECT event_id, event_id AS number, user_id AS low, event_id AS high, CASE WHEN NOT spoiled THEN event_id END AS num,
       CASE WHEN NOT spoiled THEN CAST(7 AS BIGINT) END AS den, user_id % 2 = 0 AS looped,
       CASE WHEN spoiled THEN 'Rate: not fraction: ' || event_id || '-7' END AS error FROM i""",
    "write_index": c.with_(c.ORDER_ITEMS, RENDERED) + "SELECT src, line, item_id FROM rendered WHERE problem IS NULL",
    "write_index_refused": c.with_(c.ORDER_ITEMS, RENDERED) + "SELECT id, problem FROM rendered WHERE problem IS NOT NULL",
    "read_records": "SELECT event_id, user_id, event_type FROM events",
    "detect_layout": """
SELECT lang, CAST(CASE lang WHEN 'en' THEN 2352 WHEN 'de' THEN 2448 WHEN 'fr' THEN 2336 ELSE 2048 END AS INTEGER) AS width,
       CAST(0 AS INTEGER) AS "offset", count(*) AS records FROM documents GROUP BY 1""",
}
