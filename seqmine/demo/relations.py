"""Queries for intervals, trees, rates, items and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqmine.demo import conventions as c
from seqmine.demo import segments
from seqmine.operators import classify, intervals as iv, items as it, patch, rates
from seqmine.plans.blocks import Run, by_position
from seqmine.session import cut

SOURCE_DAYS = 2400
TEMPLATES = (
    rates.Template("five of six", 6, 5, tuple((i, i) for i in range(5)), 6),
    rates.Template("nine of ten", 10, 9, tuple((i, i) for i in range(9)), 10),
    rates.Template("day shift", 14, 4, tuple((i, i + 1) for i in range(1, 22)), 24),
    rates.Template("first week", 15, 2, tuple((i, i) for i in range(168) if i % 5)),
)


def _items(spark, d):
    """The order items, written once because every relation reads them several times."""
    return cut(c.order_items_table(spark, d))


def _kind(items, kind):
    return items.where(F.col("kind") == kind)


def overlaps(spark, d):
    items = _items(spark, d)
    a = _kind(items, "video").select("src", F.col("id").alias("a_id"), F.col("start").alias("a_start"),
                                        F.col("end").alias("a_end"))
    b = _kind(items, "audio").select("src", F.col("id").alias("b_id"), F.col("start").alias("b_start"),
                                        F.col("end").alias("b_end"))
    return iv.overlap_join(a, b, ["src"], ("a_start", "a_end"), ("b_start", "b_end"))


def ordered(spark, d):
    return it.order_items(c.order_items_table(spark, d), rows=c.ITEMS_PER_BLOCK)


ORDERED = """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY "start",
           CASE kind WHEN 'file' THEN 1 WHEN 'video' THEN 2 WHEN 'audio' THEN 3 ELSE 4 END, kind, "end" DESC, id) - 1 AS number
  FROM order_items)"""


def parented(spark, d):
    return _parented(cut(ordered(spark, d)))


def _parented(items):
    children = items.select("src", F.col("id").alias("c_id"), F.col("start").alias("c_start"),
                            F.col("end").alias("c_end"), F.col("kind").alias("c_kind")).where("c_kind = 'audio'")
    return iv.assign_parent(children, _parents(items), width=c.POSITIONS_PER_BLOCK, rows=c.ITEMS_PER_BLOCK, few=c.FEW)


def parented_by_channel(spark, d):
    """Videos of every third order hold audio of any channel, the others that of their own."""
    items = cut(ordered(spark, d)).withColumn("channel", F.col("id") % 2)
    children = _kind(items, "audio").select("src", F.col("id").alias("c_id"), F.col("start").alias("c_start"), F.col("end").alias("c_end"),
                                            F.col("kind").alias("c_kind"), "channel")
    parents = _parents(items, F.when(F.col("id") % 3 > 0, F.col("channel")).alias("channel"))
    return iv.assign_parent(children, parents, channel="channel", width=c.POSITIONS_PER_BLOCK, rows=c.ITEMS_PER_BLOCK, few=c.FEW)


def _parents(items, *more):
    return items.where(F.col("kind") != "audio").select(
        "src", F.col("id").alias("p_id"), F.col("number").alias("p_order"), F.col("start").alias("p_start"),
        F.col("end").alias("p_end"), F.col("kind").alias("p_kind"), *more)


PARENTED = """rated AS (
  SELECT a.src, a.id AS c_id, p.id AS p_id, p.number, p.kind,
         (least(a."end", p."end") - greatest(a."start", p."start") + 1) * 100 // (a."end" - a."start" + 1) AS pct
  FROM ordered a JOIN ordered p ON a.src = p.src AND a.kind = 'audio' AND p.kind <> 'audio'
       AND a."start" <= p."end" AND p."start" <= a."end"),
best AS (
  SELECT src, c_id, p_id, pct + CASE WHEN kind = 'video' THEN 100 ELSE 0 END AS rating
  FROM rated WHERE pct > 0
  QUALIFY row_number() OVER (PARTITION BY src, c_id
          ORDER BY pct + CASE WHEN kind = 'video' THEN 100 ELSE 0 END DESC, number) = 1),
parented AS (
  SELECT o.src, o.id AS c_id, o."start" AS c_start, o."end" AS c_end, o.kind AS c_kind, b.p_id AS parent_id,
         coalesce(b.rating, 0) AS rating
  FROM ordered o LEFT JOIN best b ON b.src = o.src AND b.c_id = o.id WHERE o.kind = 'audio')"""


def selected(spark, d):
    items = cut(ordered(spark, d))
    held = _parented(items)
    parents = _parents(items).where("p_kind = 'video'")
    in_video = held.join(parents.select("src", F.col("p_id").alias("parent_id")), ["src", "parent_id"])
    return classify.select_items(items.drop("number"), kind="audio",
                                 parents=in_video.select("src", F.col("c_id").alias("id")))


def content(spark, d):
    return iv.flag_content(_items(spark, d), c.customer_lines(spark, d),
                           {"has_open": F.col("l_linestatus") == "O", "has_full": F.col("l_quantity") == 50},
                           width=c.POSITIONS_PER_BLOCK, size=c.line_count(spark, d))


def violations(spark, d):
    sources = c.table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.lit(SOURCE_DAYS).alias("records"))
    items = cut(ordered(spark, d))
    return iv.boundary_violations(cut(_parented(items)), _parents(items), sources)


def splits(spark, d):
    items = _items(spark, d)
    audio = _kind(items, "audio").withColumn("stride", 1 + F.col("id") % 7)
    return iv.split_intervals(audio, _kind(items, "video"), few=c.FEW, size=c.line_count(spark, d))


SPLITS = """pieces AS (
  SELECT src, id, 1 + id % 7 AS stride, "start" AS s, "end" AS e, 0 AS n FROM order_items WHERE kind = 'audio'
  UNION ALL
  SELECT p.src, p.id, p.stride, v + p.stride - 1 - (v - p.s - 1) % p.stride, p.e, p.n + 1
  FROM (SELECT p.src, p.id, p.stride, p.s, p.e, p.n, min(o."start") AS v
        FROM pieces p JOIN order_items o ON o.src = p.src AND o.kind = 'video'
             AND p.s < o."start" - 32 AND p.e >= o."start" + 32
        GROUP BY ALL) p),
cuts AS (
  SELECT src, id, stride, s, e, n, lead(s) OVER (PARTITION BY src, id ORDER BY n) AS following FROM pieces),
split AS (
  SELECT src, id, stride, s AS "start", coalesce(following - stride, e) AS "end" FROM cuts)"""


def channel_splits(spark, d):
    """The other rule: same channel only, any end past the video's start, cut one before it."""
    items = _items(spark, d).withColumn("channel", F.col("id") % 2)
    audio = _kind(items, "audio").withColumn("stride", 1 + F.col("id") % 7)
    on_grid = F.col("end") - F.pmod(F.col("end") - F.col("start"), F.col("stride"))
    return iv.split_intervals(audio.withColumn("end", on_grid), _kind(items, "video"), on=("src", "channel"), tail=0, offset=1,
                              few=c.FEW, size=c.line_count(spark, d))


CHANNEL_SPLITS = """pieces AS (
  SELECT src, id, 1 + id % 7 AS stride, "start" AS s, "end" - ("end" - "start") % (1 + id % 7) AS e, 0 AS n
  FROM order_items WHERE kind = 'audio'
  UNION ALL
  SELECT p.src, p.id, p.stride, v - 1 + p.stride - 1 - (v - 1 - p.s - 1) % p.stride, p.e, p.n + 1
  FROM (SELECT p.src, p.id, p.stride, p.s, p.e, p.n, min(o."start") AS v
        FROM pieces p JOIN order_items o ON o.src = p.src AND o.id % 2 = p.id % 2 AND o.kind = 'video'
             AND p.s < o."start" - 32 AND p.e >= o."start"
        GROUP BY ALL) p),
cuts AS (
  SELECT src, id, stride, s, e, n, lead(s) OVER (PARTITION BY src, id ORDER BY n) AS following FROM pieces)
SELECT src, id, id % 2 AS channel, stride, s AS "start", coalesce(following - stride, e) AS "end" FROM cuts"""


def silent_pieces(spark, d):
    sounding = c.customer_lines(spark, d).where("l_quantity < 40").select("src", F.col("l_orderkey").alias("id"), "pos")
    return iv.mark_silent_pieces(cut(splits(spark, d)), sounding, width=c.POSITIONS_PER_BLOCK, size=c.line_count(spark, d))


def orphans(spark, d):
    cust = c.table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") < 5000).alias("silent"))
    held = c.table(spark, d, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey"))
    return iv.drop_silent_orphans(cust, held, ["c_custkey"])


def tree(spark, d):
    t = c.turns(spark, d).select(
        "src", F.col("pos").alias("node"), F.when(F.col("pos") > 0, F.col("pos") - 1).alias("parent"),
        F.concat(F.col("role"), F.col("pos").cast("string")).alias("name"), (F.col("pos") * 10 + 1).alias("start"),
        (F.length("text") * 10).cast("bigint").alias("size"))
    return iv.resolve_tree(t, correction=2)


def extents(spark, d):
    """A disc per region: nations are folders of two records, customers files in them, some in a record that no folder has."""
    region, nation, cust = (c.table(spark, d, n) for n in ("region", "nation", "customer"))
    big = lambda e: F.expr(e).cast("bigint")
    roots = region.select(big("r_regionkey").alias("src"), big("0").alias("node"), big("null").alias("record"), F.lit("disc").alias("name"),
                          big("16").alias("start"), big("2048").alias("size"), F.lit(True).alias("folder"))
    folders = nation.select(big("n_regionkey").alias("src"), big("1 + n_nationkey").alias("node"), big("18").alias("record"),
                            F.col("n_name").alias("name"), big("100 + 10 * n_nationkey").alias("start"), big("4100").alias("size"), F.lit(True).alias("folder"))
    files = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        big("n_regionkey").alias("src"), big("1000 + c_custkey").alias("node"), big("102 + 10 * n_nationkey + c_custkey % 3").alias("record"),
        F.expr("if(c_custkey % 13 = 0, '.', c_name)").alias("name"), big("1000 + c_custkey * 10").alias("start"),
        big("case when c_custkey % 7 = 0 then 0 when c_custkey % 11 = 0 then 4398046511104 else c_custkey * 1000 end").alias("size"), F.lit(False).alias("folder"))
    return iv.resolve_extents(roots.unionByName(folders).unionByName(files), correction=2)


def tree_ids(spark, d):
    region, nation, cust = (c.table(spark, d, n) for n in ("region", "nation", "customer"))
    big = lambda *cols: F.array(*[F.col(x).cast("bigint") for x in cols])
    items = (region.where("r_name <> 'ASIA'").select(big("r_regionkey").alias("tree"))
             .unionByName(nation.select(big("n_regionkey", "n_nationkey").alias("tree")))
             .unionByName(cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                          .select(big("n_regionkey", "n_nationkey", "c_custkey").alias("tree"))))
    out = iv.resolve_parents_by_id(items.withColumn("path", F.lit("world")))
    text = lambda x: F.array_join(F.col(x).cast("array<string>"), ".")
    return out.select("path", text("tree").alias("tree"), text("parent_tree").alias("parent_tree"), "has_parent")


def agreed(spark, d):
    o = c.table(spark, d, "orders")
    return iv.consensus(o, ["o_custkey"], "o_orderstatus")


def disjoint(spark, d):
    items = c.order_items_table(spark, d).select(
        F.col("src").alias("parent"), "id", "start", "end", F.col("kind").alias("fmt"), (F.col("id") % 3).alias("past"))
    return iv.longest_disjoint(items)


DISJOINT = """once AS (
  SELECT src AS parent, kind AS fmt, "start", "end", id, id % 3 AS past FROM order_items
  QUALIFY row_number() OVER (PARTITION BY src, kind, "end" ORDER BY "start", id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent, fmt ORDER BY "end") AS rn FROM once),
walk AS (
  SELECT parent, fmt, rn, "start", "end", id, true AS taken, "end" + past AS upto FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.parent, r.fmt, r.rn, r."start", r."end", r.id, r."start" > w.upto,
         CASE WHEN r."start" > w.upto THEN r."end" + r.past ELSE w.upto END
  FROM walk w JOIN ranked r ON r.parent = w.parent AND r.fmt = w.fmt AND r.rn = w.rn + 1),
totals AS (SELECT parent, fmt, sum("end" - "start" + 1) AS total FROM walk WHERE taken GROUP BY 1, 2),
heads AS (SELECT parent, fmt, min("start") AS s, arg_min(id, ("start", id)) AS i FROM once GROUP BY 1, 2),
chosen AS (
  SELECT parent, fmt FROM totals JOIN heads USING (parent, fmt)
  QUALIFY row_number() OVER (PARTITION BY parent ORDER BY total DESC, s, i) = 1)"""


def most_open(spark, d):
    return iv.max_overlap(c.order_items_table(spark, d), width=c.POSITIONS_PER_BLOCK)


def open_steps(spark, d):
    return iv.open_counts(c.order_items_table(spark, d), width=c.POSITIONS_PER_BLOCK)


def lanes(spark, d):
    return iv.assign_lanes(_items(spark, d), width=c.POSITIONS_PER_BLOCK)


def single(spark, d):
    return iv.require_single(_kind(_items(spark, d), "video"), ["src"])


def sliced(spark, d):
    lines = c.customer_lines(spark, d).select("src", "pos", "l_orderkey", "l_linenumber")
    found = classify.slice_items(lines, _kind(_items(spark, d), "file").select("src", "id", "start", "end"), ["src"])
    return found.groupBy("src", "id").agg(F.count(F.lit(1)).alias("records"), F.min("pos").alias("first"),
                                          F.max("pos").alias("last"), F.sum("l_orderkey").alias("key_sum"))


def _frames(spark, d):
    """Hours of one user's events of one type as one-hour frames."""
    f = (c.table(spark, d, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("kind"),
                                            c.hours().alias("start")).distinct().withColumn("end", F.col("start")))
    return by_position(f, ["src", "kind"], "start", c.POSITIONS_PER_BLOCK)[0], Run(("src", "kind"), ("start",))


TYPE_FRAMES = """type_frames AS (
  SELECT DISTINCT user_id AS src, event_type AS kind, epoch_us(ts) // 3600000000 - 473352 AS pos FROM events)"""


def intervals_found(spark, d):
    df, run = c.blocks(c.hour_events(spark, d).select("src", F.col("pos").alias("start"), F.col("pos").alias("end")),
                       ["src"], "start")
    return rates.infer_interval(df, run=Run(run.keys, ("start",)))


def _interval_sql(frames: str, keys: str) -> str:
    return f"""spaced AS (
  SELECT {keys}, lag(pos) OVER w + 1 AS lo, pos AS hi, row_number() OVER w - 1 AS n
  FROM {frames} WINDOW w AS (PARTITION BY {keys} ORDER BY pos)),
third AS (SELECT {keys}, hi AS top FROM spaced WHERE n = 2),
starts AS (SELECT {keys}, unnest(generate_series(lo, hi)) AS p FROM spaced WHERE n = 1),
guesses AS (SELECT {keys}, p, unnest(generate_series(2, top - p)) AS g FROM starts JOIN third USING ({keys})),
alive AS (
  SELECT {keys}, p, g FROM guesses JOIN spaced USING ({keys}) WHERE n >= 2
  GROUP BY {keys}, p, g HAVING bool_and(((hi - p) // g) * g >= lo - p)),
found AS (
  SELECT {keys}, coalesce(max(g), 1) AS "interval" FROM third LEFT JOIN alive USING ({keys}) GROUP BY {keys})"""


def template_matches(spark, d):
    frames, _ = _frames(spark, d)
    first = frames.groupBy("src", "kind").agg(F.min("start").alias("_s"))
    rel = frames.join(first, ["src", "kind"]).select("src", "kind", (F.col("start") - F.col("_s")).alias("start"),
                                                     (F.col("end") - F.col("_s")).alias("end"))
    return rates.match_template(rel, TEMPLATES, keys=["src", "kind"])


_VALUES = ", ".join(f"('{t.name}', {t.num}, {t.den}, {t.loop or 'NULL'}, {a}, {b})"
                    for t in TEMPLATES for a, b in t.slots)
MATCHES = f"""slots(template, num, den, lp, a, b) AS (VALUES {_VALUES}),
heads AS (SELECT DISTINCT template, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den, CAST(lp AS BIGINT) AS lp FROM slots),
relative AS (SELECT src, kind, pos - min(pos) OVER (PARTITION BY src, kind) AS rel FROM type_frames),
fits AS (
  SELECT r.src, r.kind, h.template, h.num, h.den FROM relative r, heads h WHERE r.rel > 0
  GROUP BY ALL
  HAVING bool_and(EXISTS (SELECT 1 FROM slots s WHERE s.template = h.template
                          AND s.a = CASE WHEN h.lp IS NULL THEN r.rel ELSE r.rel % h.lp END
                          AND s.b >= CASE WHEN h.lp IS NULL THEN r.rel ELSE r.rel % h.lp END))),
matched AS (SELECT src, kind, num, den, template FROM fits
            QUALIFY row_number() OVER (PARTITION BY src, kind ORDER BY num, den, template) = 1)"""


def chosen_rates(spark, d):
    frames, run = _frames(spark, d)
    return rates.choose_rate(frames, run, TEMPLATES)


def ids(spark, d):
    region, nation, sup = (c.table(spark, d, n) for n in ("region", "nation", "supplier"))
    none = F.lit(None).cast("bigint")
    files = region.select(F.col("r_regionkey").cast("bigint").alias("src"), F.col("r_regionkey").cast("bigint").alias("id"),
                          F.lit("file").alias("kind"), F.col("r_name").alias("path"), none.alias("parent_id"))
    videos = nation.select(F.col("n_regionkey").cast("bigint").alias("src"), (F.col("n_nationkey") + 1000).cast("bigint").alias("id"),
                           F.lit("video").alias("kind"), F.lit(None).cast("string").alias("path"),
                           F.col("n_regionkey").cast("bigint").alias("parent_id"))
    audio = sup.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").cast("bigint").alias("src"), (F.col("s_suppkey") + 100000).alias("id"),
        F.lit("audio").alias("kind"), F.lit(None).cast("string").alias("path"),
        F.when(F.col("s_acctbal") > 1000, F.col("s_nationkey").cast("bigint") + 1000).alias("parent_id"))
    items = files.unionByName(videos).unionByName(audio).withColumn("number", F.col("id"))
    return it.assign_ids(items, width=1 << 20).select("src", "id", "kind", "item_id")


def merged(spark, d):
    frames = c.hour_events(spark, d).select("src", "pos", "event_id")
    packets = c.order_items_table(spark, d).select("src", F.col("start").alias("pos"), F.col("id").alias("order_id"))
    return it.merge_streams(frames, packets)


def timelines(spark, d):
    return it.timeline_range(merged(spark, d))


def unions(spark, d):
    items = c.order_items_table(spark, d).select(
        "src", F.col("kind").alias("grp"), "start", "end", "id", (F.col("id") % 2).alias("fmt"),
        F.when(F.col("id") % 5 > 0, 1 + F.col("id") % 2).alias("speed"), (F.col("start") - 1).alias("first"))
    return it.union_disjoint(items, keys=("src", "grp"), rows=c.ITEMS_PER_BLOCK)


def anomalies(spark, d):
    gaps = it.anomalies("gap", segments.continuity(spark, d), src="src", pos="pos", detail=F.col("previous"))
    holes = it.anomalies("missing chunk", segments.missing(spark, d), src="l_orderkey", pos="missing", detail=F.col("missing"))
    faults = it.anomalies("boundary", violations(spark, d), src="src", pos="c_start", detail=F.col("fault"))
    corrupt = it.anomalies("corrupt", segments.frames(spark, d).where("corrupt"), src="src", pos="start", detail=F.col("frame"))
    return it.anomaly_counts(it.anomaly_report([gaps, holes, faults, corrupt]))


def fault_rows(spark, d):
    """Every fault as a row of its own; frames are checked against counts that some of them exceed."""
    big = lambda df, src: df.withColumn("src_", F.col(src).cast("bigint"))
    gaps = it.anomalies("gap", big(segments.continuity(spark, d), "src"), src="src_", pos="pos", detail=F.col("previous"))
    holes = it.anomalies("missing chunk", big(segments.missing(spark, d), "l_orderkey"), src="src_", pos="missing", detail=F.col("missing"))
    faults = it.anomalies("boundary", big(violations(spark, d), "src"), src="src_", pos="c_start", detail=F.col("fault"))
    formats = it.anomalies("format", big(segments.minority(spark, d), "src"), src="src_", pos="pos", detail=F.col("major_before"))
    corrupt = it.anomalies("corrupt", big(segments.short_frames(spark, d).where("corrupt"), "src"), src="src_", pos="start", detail=F.col("frame"))
    return it.anomaly_report([gaps, holes, faults, formats, corrupt])


def _replacements(spark, d):
    p = c.table(spark, d, "part")
    first = p.where("p_size > 40").select("p_partkey", F.lit(1).alias("entry"), (F.col("p_retailprice") * 2).alias("price"))
    second = p.where("p_type = 'PROMO'").select("p_partkey", F.lit(2).alias("entry"), (F.col("p_retailprice") * 3).alias("price"))
    return first.unionByName(second)


def replaced(spark, d):
    part = c.table(spark, d, "part").select("p_partkey", "p_retailprice")
    return patch.replace_rows(part, _replacements(spark, d), ["p_partkey"], "p_retailprice", "price")


def unmatched(spark, d):
    repl = c.table(spark, d, "customer").select(F.col("c_custkey").alias("p_partkey"), "c_acctbal")
    part = c.table(spark, d, "part").where("p_size > 25")
    return patch.unmatched_replacements(part, repl, ["p_partkey"])


def _patches(spark, d):
    doc = c.table(spark, d, "documents").withColumn("n", F.length("text"))
    at = lambda entry, offset, new: doc.where("n >= 4").select(
        "doc_id", F.lit(entry).alias("entry"), offset.cast("bigint").alias("offset"), F.lit(new).alias("bytes"))
    return at(1, F.lit(0), "@@"), at(2, F.floor(F.col("n") / 2), "##"), at(3, F.col("n") - 1, "CC"), at(4, F.lit(1), "x")


def patched(spark, d):
    one, two, _, _ = _patches(spark, d)
    docs = c.table(spark, d, "documents").select("doc_id", F.col("text").alias("data"))
    out = patch.apply_patches(docs, one.unionByName(two), key=["doc_id"])
    return out.select("doc_id", "patches", F.md5("data").alias("digest"))


def refused(spark, d):
    one, two, three, four = _patches(spark, d)
    docs = c.table(spark, d, "documents").where("lang <> 'fr'").select("doc_id", F.col("text").alias("data"))
    return patch.check_patches(docs, one.unionByName(two).unionByName(three).unionByName(four), key=["doc_id"],
                               rows=c.ITEMS_PER_BLOCK)


def _zip(spark, d):
    items = _items(spark, d)
    side = lambda kind: _kind(items, kind).select("src", "start", "id", F.lit(1).alias("rate"))
    return patch.zip_positional(side("video"), side("audio"), ["src"], ["start", "id"], same=["rate"], rows=c.ITEMS_PER_BLOCK)


def zipped(spark, d):
    return _zip(spark, d)[0].select("src", "n", "a_id", "b_id")


def zip_refused(spark, d):
    return _zip(spark, d)[1]


def block_diff(spark, d):
    v = c.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("cell", "v"))
    v = v.select(F.floor(F.col("vec_id") / 2).alias("id"), (F.col("vec_id") % 2).alias("side"), "cell",
                 F.col("v").cast("double").alias("v"))
    return patch.diff_blocks(v.where("side = 0").drop("side"), v.where("side = 1").drop("side"),
                             block=F.floor(F.col("cell") / 8), components=["v"], tolerance=0.3,
                             mask=F.col("cell").between(4, 59))


def diff_verdicts(spark, d):
    return patch.diff_verdict(block_diff(spark, d))


DIFF = """cells AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS cell FROM embeddings),
diff AS (
  SELECT a.vec_id // 2 AS id, a.cell // 8 AS block, abs(CAST(a.v AS DOUBLE) - CAST(b.v AS DOUBLE)) AS gap
  FROM cells a JOIN cells b ON b.vec_id = a.vec_id + 1 AND a.cell = b.cell AND a.vec_id % 2 = 0
  WHERE a.cell BETWEEN 4 AND 59),
blocks AS (
  SELECT id, block, count(*) AS cells, count(*) FILTER (gap > 0.3) AS changed, max(gap) AS largest,
         count(*) FILTER (gap > 0.3) > 0 AS differs
  FROM diff GROUP BY 1, 2)"""

_VIOLATIONS = f"""violations AS (
  SELECT 'outside parent' AS fault, c.src, c.c_id, c.c_start, c.c_end
  FROM parented c JOIN ordered p ON p.src = c.src AND p.id = c.parent_id
  WHERE c.c_start < p."start" OR c.c_end > p."end"
  UNION ALL
  SELECT 'past end', src, c_id, c_start, c_end FROM parented WHERE c_end >= {SOURCE_DAYS})"""

QUERIES = {
    "overlap_join": overlaps,
    "order_items": ordered,
    "assign_parent": parented,
    "assign_parent_by_channel": parented_by_channel,
    "select_items": selected,
    "flag_content": content,
    "boundary_violations": violations,
    "split_intervals": splits,
    "split_intervals_by_channel": channel_splits,
    "mark_silent_pieces": silent_pieces,
    "drop_silent_orphans": orphans,
    "resolve_tree": tree,
    "resolve_extents": extents,
    "resolve_parents_by_id": tree_ids,
    "consensus": agreed,
    "longest_disjoint": disjoint,
    "max_overlap": most_open,
    "open_counts": open_steps,
    "assign_lanes": lanes,
    "require_single": single,
    "slice_items": sliced,
    "infer_interval": intervals_found,
    "match_template": template_matches,
    "choose_rate": chosen_rates,
    "assign_ids": ids,
    "merge_streams": merged,
    "timeline_range": timelines,
    "union_disjoint": unions,
    "anomaly_report": anomalies,
    "anomaly_rows": fault_rows,
    "replace_rows": replaced,
    "unmatched_replacements": unmatched,
    "apply_patches": patched,
    "check_patches": refused,
    "zip_positional": zipped,
    "zip_positional_refused": zip_refused,
    "diff_blocks": block_diff,
    "diff_verdict": diff_verdicts,
}

ORACLES = {
    "overlap_join": c.with_(c.ORDER_ITEMS) + """
SELECT a.src, a.id AS a_id, a."start" AS a_start, a."end" AS a_end, b.id AS b_id, b."start" AS b_start, b."end" AS b_end,
       least(a."end", b."end") - greatest(a."start", b."start") + 1 AS overlap
FROM order_items a JOIN order_items b ON a.src = b.src AND a.kind = 'video' AND b.kind = 'audio'
     AND a."start" <= b."end" AND b."start" <= a."end\"""",
    "order_items": c.with_(c.ORDER_ITEMS, ORDERED) + "SELECT * FROM ordered",
    "assign_parent": c.with_(c.ORDER_ITEMS, ORDERED, PARENTED) + "SELECT * FROM parented",
    "assign_parent_by_channel": c.with_(c.ORDER_ITEMS, ORDERED) + """
, rated AS (
  SELECT a.src, a.id AS c_id, p.id AS p_id, p.number, CASE WHEN p.kind = 'video' THEN 100 ELSE 0 END AS bonus,
         (least(a."end", p."end") - greatest(a."start", p."start") + 1) * 100 // (a."end" - a."start" + 1) AS pct
  FROM ordered a JOIN ordered p ON a.src = p.src AND a.kind = 'audio' AND p.kind <> 'audio'
       AND a."start" <= p."end" AND p."start" <= a."end"
  WHERE p.kind <> 'video' OR p.id % 3 = 0 OR p.id % 2 = a.id % 2),
best AS (SELECT * FROM rated WHERE pct > 0 QUALIFY row_number() OVER (PARTITION BY src, c_id ORDER BY pct + bonus DESC, number) = 1)
SELECT o.src, o.id AS c_id, o."start" AS c_start, o."end" AS c_end, o.kind AS c_kind, o.id % 2 AS channel, b.p_id AS parent_id,
       coalesce(b.pct + b.bonus, 0) AS rating
FROM ordered o LEFT JOIN best b ON b.src = o.src AND b.c_id = o.id WHERE o.kind = 'audio'""",
    "select_items": c.with_(c.ORDER_ITEMS, ORDERED, PARENTED) + """
SELECT * FROM order_items o WHERE kind = 'audio' AND NOT EXISTS (
  SELECT 1 FROM parented p JOIN order_items v ON v.src = p.src AND v.id = p.parent_id AND v.kind = 'video'
  WHERE p.src = o.src AND p.c_id = o.id)""",
    "flag_content": c.with_(c.ORDER_ITEMS, c.CUSTOMER_LINES) + """
SELECT o.*, EXISTS (SELECT 1 FROM customer_lines l WHERE l.src = o.src AND l.pos BETWEEN o."start" AND o."end"
                    AND l_linestatus = 'O') AS has_open,
       EXISTS (SELECT 1 FROM customer_lines l WHERE l.src = o.src AND l.pos BETWEEN o."start" AND o."end"
               AND l_quantity = 50) AS has_full
FROM order_items o""",
    "boundary_violations": c.with_(c.ORDER_ITEMS, ORDERED, PARENTED, _VIOLATIONS) + "SELECT * FROM violations",
    "split_intervals": c.with_(c.ORDER_ITEMS, SPLITS, recursive=True) + "SELECT * FROM split",
    "split_intervals_by_channel": c.with_(c.ORDER_ITEMS, CHANNEL_SPLITS, recursive=True),
    "mark_silent_pieces": c.with_(c.ORDER_ITEMS, c.CUSTOMER_LINES, SPLITS, recursive=True) + """
SELECT s.*, NOT EXISTS (SELECT 1 FROM customer_lines l WHERE l.src = s.src AND l.l_orderkey = s.id
                        AND l.l_quantity < 40 AND l.pos BETWEEN s."start" AND s."end") AS silent FROM split s""",
    "drop_silent_orphans": """
SELECT c_custkey, c_acctbal < 5000 AS silent FROM customer
WHERE c_acctbal >= 5000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')""",
    "resolve_tree": c.with_(c.TURNS, """nodes AS (
  SELECT src, pos AS node, CASE WHEN pos > 0 THEN pos - 1 END AS parent, role || pos AS name, pos * 10 + 1 AS st,
         length(text) * 10 AS size FROM turns),
walk AS (
  SELECT *, name AS path, CAST(1 AS BIGINT) AS depth FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.*, w.path || '/' || n.name, w.depth + 1 FROM walk w JOIN nodes n ON n.src = w.src AND n.parent = w.node)""",
                            recursive=True) + """
SELECT src, node, parent, name, st + 2 AS "start", size, path, depth,
       st + 2 + greatest(CAST(ceil(size / 2048) AS BIGINT), 1) - 1 AS "end" FROM walk""",
    "resolve_extents": """
WITH folders AS (SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(1 + n_nationkey AS BIGINT) AS node, n_name AS name,
                        CAST(102 + 10 * n_nationkey AS BIGINT) AS st FROM nation),
files AS (SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(1000 + c_custkey AS BIGINT) AS node,
                 CAST(102 + 10 * n_nationkey + c_custkey % 3 AS BIGINT) AS record, c_name AS name, CAST(1002 + c_custkey * 10 AS BIGINT) AS st,
                 CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 11 = 0 THEN 4398046511104 ELSE c_custkey * 1000 END AS BIGINT) AS size
          FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 13 <> 0)
SELECT CAST(r_regionkey AS BIGINT) AS src, CAST(0 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS record, 'disc' AS name, CAST(18 AS BIGINT) AS "start",
       CAST(2048 AS BIGINT) AS size, true AS folder, '' AS path, CAST(0 AS BIGINT) AS depth, CAST(NULL AS VARCHAR) AS fault, CAST(18 AS BIGINT) AS "end"
FROM region
UNION ALL SELECT src, node, 18, name, st, 4100, true, name, 1, NULL, st + 2 FROM folders
UNION ALL SELECT f.src, f.node, record, f.name, f.st, size, false, d.name || '/' || f.name, 2,
                 CASE WHEN size > 4398046509056 THEN 'impossible size' END,
                 CASE WHEN size <= 4398046509056 THEN f.st + greatest((size + 2047) // 2048, 1) - 1 END
FROM files f JOIN folders d ON f.src = d.src AND record BETWEEN d.st AND d.st + 1""",
    "resolve_parents_by_id": """
WITH items AS (
  SELECT CAST(r_regionkey AS VARCHAR) AS tree, '' AS up FROM region WHERE r_name <> 'ASIA'
  UNION ALL SELECT n_regionkey || '.' || n_nationkey, CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT n_regionkey || '.' || n_nationkey || '.' || c_custkey, n_regionkey || '.' || n_nationkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'world' AS path, i.tree, p.tree AS parent_tree, p.tree IS NOT NULL AS has_parent
FROM items i LEFT JOIN items p ON p.tree = i.up""",
    "consensus": """
SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN any_value(o_orderstatus) END AS o_orderstatus,
       count(*) AS children FROM orders GROUP BY 1""",
    "longest_disjoint": c.with_(c.ORDER_ITEMS, DISJOINT, recursive=True) + """
SELECT parent, fmt, "start", "end", id FROM walk JOIN chosen USING (parent, fmt) WHERE taken""",
    "max_overlap": c.with_(c.ORDER_ITEMS) + """
SELECT src, max(n) AS max_open
FROM (SELECT a.src, a.id, count(*) AS n FROM order_items a
      JOIN order_items b ON b.src = a.src AND b."start" <= a."start" AND b."end" >= a."start" GROUP BY 1, 2)
GROUP BY src""",
    "open_counts": c.with_(c.ORDER_ITEMS) + """
, steps AS (SELECT src, pos, sum(delta) AS delta
            FROM (SELECT src, "start" AS pos, 1 AS delta FROM order_items UNION ALL SELECT src, "end" + 1, -1 FROM order_items)
            GROUP BY 1, 2 HAVING sum(delta) <> 0)
SELECT s.src, s.pos, (SELECT count(*) FROM order_items o WHERE o.src = s.src AND s.pos BETWEEN o."start" AND o."end") AS "open"
FROM steps s""",
    "assign_lanes": c.with_(c.ORDER_ITEMS, """r AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY "start", id) AS rn FROM order_items),
walk AS (
  SELECT src, rn, id, "start" AS s, "end" AS e, 1 AS k, ["end"] AS busy FROM r WHERE rn = 1
  UNION ALL
  SELECT src, rn, id, s, e, k, list_concat(list_concat(busy[:k - 1], [e]), busy[k + 1:])
  FROM (SELECT r.src, r.rn, r.id, r."start" AS s, r."end" AS e, w.busy,
               coalesce(nullif(list_position(list_transform(w.busy, lambda x: x < r."start"), true), 0), len(w.busy) + 1) AS k
        FROM walk w JOIN r ON r.src = w.src AND r.rn = w.rn + 1))""", recursive=True) + """
SELECT src, id, s AS "start", e AS "end", CAST(k - 1 AS BIGINT) AS lane FROM walk""",
    "require_single": c.with_(c.ORDER_ITEMS) + """
SELECT * FROM order_items WHERE kind = 'video' QUALIFY count(*) OVER (PARTITION BY src) = 1""",
    "slice_items": c.with_(c.ORDER_ITEMS, c.CUSTOMER_LINES) + """
SELECT o.src, o.id, count(*) AS records, min(l.pos) AS "first", max(l.pos) AS "last", CAST(sum(l_orderkey) AS BIGINT) AS key_sum
FROM order_items o JOIN customer_lines l ON l.src = o.src AND l.pos BETWEEN o."start" AND o."end"
WHERE o.kind = 'file' GROUP BY 1, 2""",
    "infer_interval": c.with_(c.HOUR_EVENTS, _interval_sql("hour_events", "src")) + "SELECT * FROM found",
    "match_template": c.with_(TYPE_FRAMES, MATCHES) + "SELECT * FROM matched",
    "choose_rate": c.with_(TYPE_FRAMES, MATCHES, _interval_sql("type_frames", "src, kind"), """total AS (
  SELECT src, kind, count(*) AS frames, max(pos) - min(pos) + 1 AS length FROM type_frames GROUP BY 1, 2),
picked AS (
  SELECT t.*, CASE WHEN frames = length THEN 'each' WHEN frames = 1 THEN 'single' WHEN m.num IS NOT NULL THEN 'template'
                   WHEN f."interval" > 1 THEN 'interval' ELSE 'average' END AS method, m.num AS tn, m.den AS td, f."interval" AS n
  FROM total t LEFT JOIN matched m USING (src, kind) LEFT JOIN found f USING (src, kind))""") + """
SELECT src, kind, frames, length, method,
       CASE method WHEN 'each' THEN 1 WHEN 'single' THEN length WHEN 'template' THEN tn // gcd(tn, td)
            WHEN 'interval' THEN n ELSE length // gcd(length, frames) END AS num,
       CASE method WHEN 'template' THEN td // gcd(tn, td) WHEN 'average' THEN frames // gcd(length, frames) ELSE 1 END AS den
FROM picked""",
    "assign_ids": """
WITH audio AS (
  SELECT CAST(n_regionkey AS BIGINT) AS src, s_suppkey + 100000 AS id, s_acctbal > 1000 AS held, n_nationkey, n_regionkey, r_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
video AS (
  SELECT n_nationkey, n_regionkey, r_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i
  FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CAST(r_regionkey AS BIGINT) AS src, CAST(r_regionkey AS BIGINT) AS id, 'file' AS kind, r_name AS item_id FROM region
UNION ALL SELECT n_regionkey, n_nationkey + 1000, 'video', r_name || '[' || i || ']' FROM video
UNION ALL SELECT a.src, a.id, 'audio', a.r_name || '[' || v.i || '.' || (row_number() OVER (PARTITION BY a.n_nationkey ORDER BY a.id) - 1) || ']'
FROM audio a JOIN video v ON v.n_nationkey = a.n_nationkey WHERE held
UNION ALL SELECT src, id, 'audio', '?[' || (row_number() OVER (PARTITION BY src ORDER BY id) - 1) || ']' FROM audio WHERE NOT held""",
    "merge_streams": c.with_(c.HOUR_EVENTS, c.ORDER_ITEMS) + """
SELECT src, pos, event_id, 'frame' AS kind, CAST(NULL AS BIGINT) AS order_id FROM hour_events
UNION ALL SELECT src, "start", NULL, 'audio', id FROM order_items""",
    "timeline_range": c.with_(c.HOUR_EVENTS, c.ORDER_ITEMS) + """
, line AS (SELECT src, pos, true AS frame FROM hour_events UNION ALL SELECT src, "start", false FROM order_items)
SELECT src, min(pos) AS "start", max(pos) AS "end", count(*) FILTER (frame) AS frames, count(*) FILTER (NOT frame) AS packets,
       min(pos) FILTER (frame) AS first_frame, max(pos) FILTER (frame) AS last_frame FROM line GROUP BY src""",
    "union_disjoint": c.with_(c.ORDER_ITEMS) + """
, i AS (SELECT src, kind AS grp, "start", "end", id, id % 2 AS fmt, CASE WHEN id % 5 > 0 THEN 1 + id % 2 END AS speed FROM order_items),
l AS (SELECT *, EXISTS (SELECT 1 FROM i b WHERE b.src = i.src AND b.grp = i.grp
              AND (b."start" < i."start" OR (b."start" = i."start" AND b.id < i.id)) AND b."end" >= i."start") AS late FROM i)
SELECT src, grp, count(*) AS streams, min("start") AS "start", max("end") AS "end", min("start") - 1 AS "first",
       count(*) FILTER (late) AS overlaps, count(DISTINCT fmt) > 1 AS mixed_format, count(DISTINCT speed) > 1 AS mixed_speed,
       count(*) FILTER (late) = 0 AND count(DISTINCT fmt) = 1 AND count(DISTINCT speed) <= 1 AS accepted
FROM l GROUP BY 1, 2""",
    "anomaly_report": c.with_(c.HOUR_EVENTS, c.DISC_LINES, segments.FRAMES, c.ORDER_ITEMS, ORDERED, PARENTED, _VIOLATIONS) + f"""
, report AS (
  SELECT 'gap' AS kind, src, pos FROM (
    SELECT src, pos, header_pos, lag(header_pos) OVER (PARTITION BY src ORDER BY pos) AS previous
    FROM (SELECT *, CASE WHEN event_type <> 'error' THEN event_id END AS header_pos FROM hour_events))
  WHERE header_pos IS NOT NULL AND previous IS NOT NULL AND header_pos <> previous + 1
  UNION ALL SELECT 'missing chunk', l_orderkey, missing FROM ({segments.ORACLES["missing_members"]})
  UNION ALL SELECT 'boundary', src, c_start FROM violations
  UNION ALL SELECT 'corrupt', src, "start" FROM frames WHERE corrupt)
SELECT kind, src, count(*) AS faults, min(pos) AS first_pos FROM report GROUP BY 1, 2""",
    "anomaly_rows": c.with_(c.HOUR_EVENTS, c.DISC_LINES, segments.SHORT_FRAMES, c.ORDER_ITEMS, ORDERED, PARENTED, _VIOLATIONS) + f"""
SELECT 'gap' AS kind, CAST(src AS BIGINT) AS src, CAST(pos AS BIGINT) AS pos, CAST(previous AS VARCHAR) AS detail FROM (
  SELECT src, pos, header_pos, lag(header_pos) OVER (PARTITION BY src ORDER BY pos) AS previous
  FROM (SELECT *, CASE WHEN event_type <> 'error' THEN event_id END AS header_pos FROM hour_events))
WHERE header_pos IS NOT NULL AND previous IS NOT NULL AND header_pos <> previous + 1
UNION ALL SELECT 'missing chunk', l_orderkey, missing, CAST(missing AS VARCHAR) FROM ({segments.ORACLES["missing_members"]})
UNION ALL SELECT 'boundary', src, c_start, fault FROM violations
UNION ALL SELECT 'format', src, pos, CAST(major_before AS VARCHAR) FROM ({segments.ORACLES["minority_kind"]})
UNION ALL SELECT 'corrupt', src, "start", CAST(frame AS VARCHAR) FROM frames WHERE corrupt""",
    "replace_rows": """
SELECT p_partkey, CASE WHEN p_size > 40 THEN p_retailprice * 2 WHEN p_type = 'PROMO' THEN p_retailprice * 3
                       ELSE p_retailprice END AS p_retailprice, p_size > 40 OR p_type = 'PROMO' AS replaced FROM part""",
    "unmatched_replacements": """
SELECT c_custkey AS p_partkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""",
    "apply_patches": """
SELECT doc_id, CAST(CASE WHEN length(text) >= 4 THEN 2 ELSE 0 END AS BIGINT) AS patches,
       md5(CASE WHEN length(text) >= 4 THEN '@@' || substr(text, 3, length(text) // 2 - 2) || '##' ||
                substr(text, length(text) // 2 + 3) ELSE text END) AS digest FROM documents""",
    "check_patches": """
WITH p AS (SELECT doc_id, lang, length(text) AS n, unnest([1, 2, 3, 4]) AS entry FROM documents WHERE length(text) >= 4),
o AS (SELECT *, CASE entry WHEN 1 THEN 0 WHEN 2 THEN n // 2 WHEN 3 THEN n - 1 ELSE 1 END AS "offset" FROM p),
e AS (SELECT *, "offset" + CASE entry WHEN 4 THEN 1 ELSE 2 END AS stop FROM o),
r AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY "offset", entry
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
SELECT doc_id, entry, "offset", CASE WHEN lang = 'fr' THEN 'no record' WHEN stop > n THEN 'past end' ELSE 'overlap' END AS fault
FROM r WHERE lang = 'fr' OR stop > n OR "offset" < reach""",
    "zip_positional": c.with_(c.ORDER_ITEMS) + """
, s AS (SELECT src, kind, id, row_number() OVER (PARTITION BY src, kind ORDER BY "start", id) - 1 AS n,
               count(*) OVER (PARTITION BY src, kind) AS total FROM order_items)
SELECT a.src, a.n, a.id AS a_id, b.id AS b_id
FROM s a JOIN s b ON a.src = b.src AND a.n = b.n AND a.total = b.total AND a.kind = 'video' AND b.kind = 'audio'""",
    "zip_positional_refused": c.with_(c.ORDER_ITEMS) + """
, s AS (SELECT src, nullif(count(*) FILTER (kind = 'video'), 0) AS a_count, nullif(count(*) FILTER (kind = 'audio'), 0) AS b_count
        FROM order_items WHERE kind <> 'file' GROUP BY src)
SELECT src, a_count, b_count, CASE WHEN a_count IS NULL OR b_count IS NULL THEN 'missing side' ELSE 'count' END AS reason
FROM s WHERE a_count IS DISTINCT FROM b_count""",
    "diff_blocks": c.with_(DIFF) + "SELECT * FROM blocks",
    "diff_verdict": c.with_(DIFF) + """
SELECT id, count(*) AS blocks, count(*) FILTER (differs) AS changed_blocks,
       CASE WHEN count(*) FILTER (differs) = 0 THEN 'skip' WHEN bool_and(differs) THEN 'all' ELSE 'partial' END AS verdict
FROM blocks GROUP BY 1""",
}
