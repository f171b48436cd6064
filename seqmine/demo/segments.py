"""Queries for segmentation, numbering and clock alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqmine.demo import conventions as c
from seqmine.operators import align, carving, classify, segment as seg
from seqmine.plans.blocks import by_position, rekeyed


def constant_stride(spark, d):
    return seg.segment_constant_stride(c.day_events(spark, d), legal=c.LEGAL_STRIDES,
                                       width=c.POSITIONS_PER_BLOCK)


STRIDE_WALK = """rows AS (
  SELECT *, row_number() OVER (PARTITION BY src, channel ORDER BY pos) AS rn FROM day_events),
walk AS (
  SELECT src, channel, rn, pos, stream, fmt, silent, stream AS is_open, pos AS first_pos,
         CAST(NULL AS BIGINT) AS stride
  FROM rows WHERE rn = 1
  UNION ALL
  SELECT r.src, r.channel, r.rn, r.pos, r.stream, CASE WHEN r.stream THEN r.fmt ELSE w.fmt END, r.silent, r.stream,
         CASE WHEN r.stream AND w.is_open AND r.fmt = w.fmt AND r.pos - w.pos BETWEEN 1 AND 8
                   AND coalesce(w.stride, r.pos - w.pos) = r.pos - w.pos THEN w.first_pos ELSE r.pos END,
         CASE WHEN r.stream AND w.is_open AND r.fmt = w.fmt AND r.pos - w.pos BETWEEN 1 AND 8
                   AND coalesce(w.stride, r.pos - w.pos) = r.pos - w.pos THEN r.pos - w.pos END
  FROM walk w JOIN rows r ON r.src = w.src AND r.channel = w.channel AND r.rn = w.rn + 1),
streams AS (
  SELECT src, channel, first_pos AS "start", max(pos) AS "end", count(*) AS records, max(stride) AS stride,
         min(fmt) AS fmt, CAST(count(*) FILTER (NOT silent) AS BIGINT) AS sounding
  FROM walk WHERE stream GROUP BY src, channel, first_pos
  HAVING count(*) > 1 OR count(*) FILTER (NOT silent) > 0)"""


def durations(spark, d):
    return classify.derive_durations(constant_stride(spark, d), samples_per_record=2016, rate=37800,
                                     channels=2, bits=4).drop("fmt")


def gap_segments(spark, d):
    df, run = c.blocks(c.hour_events(spark, d), ["src"])
    rows = seg.segment_by_gap(df, run, gap=12)
    return seg.summarise_segments(rows, ["src", "seg"]).drop("seg")


def summaries(spark, d):
    df, run = c.blocks(c.hour_events(spark, d), ["src"])
    rows = seg.segment_by_gap(df.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
                              .withColumn("quiet", F.col("value") < 50), run, gap=24, same=["quiet"])
    return seg.summarise_segments(rows, ["src", "seg"], number="event_id", total="cents").drop("seg")


def unclaimed_islands(spark, d):
    df, run = c.blocks(c.hour_events(spark, d).withColumn("claimed", F.col("event_type") == "view"), ["src"])
    return seg.islands(df, run, "claimed")


def continuity(spark, d):
    df, run = c.blocks(c.hour_events(spark, d).withColumn(
        "header_pos", F.when(F.col("event_type") != "error", F.col("event_id"))), ["src"])
    return align.check_continuity(df, run).select("src", "pos", "header_pos", "previous")


def minority(spark, d):
    rows, run = c.supplier_lines(spark, d)
    out = align.minority_kind(rows, run, minor=F.col("l_returnflag") == "A", major=F.col("l_returnflag") == "N")
    return out.select("src", "pos", "minor_before", "major_before")


def frames(spark, d):
    rows, run = c.disc_lines(spark, d)
    return seg.assemble_groups(rows, run)


def short_frames(spark, d):
    """Frames that expect two to five chunks, whatever they have."""
    rows, run = c.disc_lines(spark, d)
    return seg.assemble_groups(rows.withColumn("expected", 2 + F.col("frame") % 4), run)


FRAMES = """breaks AS (
  SELECT *, CASE WHEN lag(frame) OVER w IS NULL OR frame <> lag(frame) OVER w OR chunk <= lag(chunk) OVER w
                   OR expected <> lag(expected) OVER w OR pos - lag(pos) OVER w >= 50 OR chunk >= expected
                   OR lag(chunk) OVER w >= lag(expected) OVER w - 1 THEN 1 ELSE 0 END AS brk
  FROM disc_lines WINDOW w AS (PARTITION BY src ORDER BY pos)),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY src ORDER BY pos) AS seg FROM breaks),
frames AS (
  SELECT src, min(pos) AS "start", max(pos) AS "end", min(frame) AS frame, min(expected) AS expected,
         count(*) AS chunks, min(chunk) AS first_chunk, max(chunk) AS last_chunk,
         min(chunk) >= min(expected) AS corrupt
  FROM numbered GROUP BY src, seg)"""
SHORT_FRAMES = "short_lines AS (SELECT * REPLACE (2 + frame % 4 AS expected) FROM disc_lines),\n" + FRAMES.replace("disc_lines", "short_lines")


def videos(spark, d):
    f = (frames(spark, d).withColumn("number", F.col("frame") % 20)
         .withColumn("special", F.col("chunks") <= 4))
    df, run = by_position(f, ["src"], "start", c.POSITIONS_PER_BLOCK)
    return seg.stitch_groups(df, run, number="number", gap=2)


VIDEOS = """usable AS (
  SELECT *, frame % 20 AS number, chunks <= 4 AS special,
         row_number() OVER (PARTITION BY src ORDER BY "start") AS rn
  FROM frames),
walk AS (
  SELECT src, rn, "start", "end", number, special, rn AS seg, special AS sticky FROM usable WHERE rn = 1
  UNION ALL
  SELECT u.src, u.rn, u."start", u."end", u.number, u.special,
         CASE WHEN u."start" > w."end" + 2 OR u.number < w.number OR u.number > w.number + 1000
                   OR (w.sticky AND NOT u.special) THEN u.rn ELSE w.seg END,
         CASE WHEN u."start" > w."end" + 2 OR u.number < w.number OR u.number > w.number + 1000
                   OR (w.sticky AND NOT u.special) THEN u.special ELSE w.sticky END
  FROM walk w JOIN usable u ON u.src = w.src AND u.rn = w.rn + 1)
SELECT src, min("start") AS "start", max("end") AS "end", min(number) AS first_number, max(number) AS last_number,
       count(*) AS frames
FROM walk GROUP BY src, seg"""


def video_summaries(spark, d):
    """Frames joined over small gaps and summarised."""
    f = frames(spark, d)
    df, run = by_position(f, ["src"], "start", c.POSITIONS_PER_BLOCK)
    rows = seg.segment_by_gap(df, run, pos="start", end="end", gap=2)
    return seg.summarise_segments(rows, ["src", "seg"], pos="start", end="end", number="frame", total="chunks").drop("seg")


def countdown(spark, d):
    rows, run = c.disc_lines(spark, d)
    keyed = rows.withColumn("channel", F.col("l_returnflag")).withColumn("number", 8 - F.col("l_linenumber").cast("bigint"))
    keyed, run = rekeyed(keyed, run, ["src", "channel"])
    out = seg.stitch_countdown(keyed, run, start="pos", end="pos", gap=5)
    return out.select("src", "channel", "pos", "number", "seg", "first_number", "renumbered")


def succession(spark, d):
    rows, run = c.disc_lines(spark, d)
    rows = (rows.withColumn("wanted", F.col("l_returnflag") == "R")
            .withColumn("size", F.floor(F.col("l_quantity") / 25)))
    return seg.segment_by_succession(rows, run, number="chunk")


def marker_segments(spark, d):
    df, run = c.blocks(c.hour_events(spark, d).withColumn("marker", F.col("event_type") == "signup"), ["src"])
    return seg.segment_by_marker(
        df, run, fields=["event_type"], payload=F.col("event_type") == "purchase",
        bad=lambda prev, cur: (prev("event_type") == "error") & (cur("event_type") == "error"))


def pairs(spark, d):
    t = c.turns(spark, d)
    side = F.when(F.col("role") == "user", "left").when(F.col("role") == "assistant", "right")
    df, run = c.blocks(t.select("src", "pos", side.alias("side"), F.length("text").cast("bigint").alias("value")), ["src"])
    return seg.pair_adjacent(df, run)


def increasing(spark, d):
    rows, run = c.part_lines(spark, d)
    rows = (rows.withColumn("number", F.col("l_linenumber").cast("bigint")).withColumn("rate", F.col("l_linestatus"))
            .withColumn("start", c.days("l_shipdate")).withColumn("end", F.col("start"))
            .withColumn("units", F.col("l_quantity").cast("bigint")))
    return seg.segment_increasing(rows, run)


def carved(spark, d):
    """Words that begin with th and a to e in lines that nothing claims, also over the ends of lines; claimed lines are gaps."""
    docs = c.table(spark, d, "documents").select(F.col("doc_id").alias("src"),
                                                 F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    free = docs.where(F.length("line") % 7 != 3)
    df, run = c.blocks(free.withColumn("pos", F.col("pos").cast("bigint")), ["src"])
    return carving.carve(df, run, text="line", pattern="th[a-e][a-z]*")


def valid_runs(spark, d):
    e = (c.hour_events(spark, d).withColumn("valid", F.col("event_type") != "error")
         .withColumn("last", F.col("event_type") == "purchase").withColumn("zero", F.col("value") < 50))
    return seg.validated_runs(e, min_len=2, width=c.POSITIONS_PER_BLOCK)


def missing(spark, d):
    t = c.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("chunk"),
                                             F.lit(7).alias("expected"))
    return seg.missing_members(t, ["l_orderkey"])


def payloads(spark, d):
    df, run = c.blocks(c.turns(spark, d), ["src"])
    out = seg.concat_payload(df, run, payload="text", first_trim=2, last_trim=1)
    return out.select("src", "start", "end", "size", "legal", F.md5("text").alias("digest"))


def located(spark, d):
    t = c.turns(spark, d).withColumn("len", F.length("text").cast("bigint"))
    asked = t.select("src", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (0, 150, 1000)], F.col("len"))).alias("at"))
    return seg.locate_offset(t.select("src", "pos", "len"), asked.distinct(), ["src"], width=c.POSITIONS_PER_BLOCK)


def lookahead(spark, d):
    rows, run = c.disc_lines(spark, d)
    rows = (rows.withColumn("first", F.col("chunk") == 0).withColumn("last", F.col("chunk") >= 5)
            .withColumn("member", F.col("l_returnflag") != "A"))
    return seg.claim_lookahead(rows, run, first="first", member="member", last="last").select(
        "src", "pos", "group_start")


def whole_groups(spark, d):
    """Groups of at least four lines whose numbers leave no hole."""
    rows, run = c.disc_lines(spark, d)
    rows = (rows.withColumn("first", F.col("chunk") == 0).withColumn("last", F.col("chunk") >= 3)
            .withColumn("member", F.col("l_returnflag") != "A"))
    return seg.claim_lookahead(rows, run, first="first", member="member", last="last", number="chunk", least=4).select(
        "src", "pos", "group_start")


def numbered(spark, d):
    rows, run = c.disc_lines(spark, d)
    rows = rows.withColumn("start", F.floor(F.col("pos") / 3))
    return align.number_frames(rows, run).select("src", "pos", "frame", "index", "header_dup", "start_dup")


NUMBERED = """runs AS (
  SELECT src, pos, frame, pos // 3 AS st, pos - 1 AS "index",
         sum(CASE WHEN frame IS DISTINCT FROM pf THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY pos) AS hrun,
         sum(CASE WHEN pos // 3 IS DISTINCT FROM ps THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY pos) AS srun
  FROM (SELECT *, lag(frame) OVER (PARTITION BY src ORDER BY pos) AS pf,
               lag(pos // 3) OVER (PARTITION BY src ORDER BY pos) AS ps FROM disc_lines)),
numbered AS (
  SELECT src, pos, frame, "index",
         row_number() OVER (PARTITION BY src, hrun ORDER BY pos) - 1 AS header_dup,
         row_number() OVER (PARTITION BY src, srun ORDER BY pos) - 1 AS start_dup
  FROM runs)"""


def formats(spark, d):
    return align.number_format(numbered(spark, d), ["src"])


def number_range(spark, d):
    return classify.filter_number_range(numbered(spark, d), "#100.1", "#5000",
                                        {"header": ("frame", "header_dup")}).select("src", "pos", "frame", "header_dup")


def audio_fill(spark, d):
    e = c.hour_events(spark, d).withColumn("samples", F.floor("value"))
    df, run = c.blocks(e, ["src"])
    df = align.with_first(df, run, "pos")
    return align.fill_audio(df, run, rate=40, speed=3).select("src", "pos", "samples", "silence", "written")


def video_fill(spark, d):
    df, run = c.blocks(c.hour_events(spark, d), ["src"])
    df = align.with_first(df, run, "pos")
    return align.fill_video(df, run, spf_num=19, spf_den=2).select("src", "pos", "repeats", "ahead", "written")


def offsets(spark, d):
    items = c.order_items_table(spark, d)
    return align.initial_offset(items, video_first="end", audio_first="start", rate=441, speed=75, spf_num=7,
                                spf_den=2).select("id", "frame_delay", "sample_delay").unionByName(
        align.initial_offset(items, video_first="start", audio_first="end", rate=441, speed=75, spf_num=7,
                             spf_den=2).select("id", "frame_delay", "sample_delay"))


QUERIES = {
    "segment_constant_stride": constant_stride,
    "derive_durations": durations,
    "segment_by_gap": gap_segments,
    "summarise_segments": summaries,
    "summarise_frames": video_summaries,
    "islands": unclaimed_islands,
    "check_continuity": continuity,
    "minority_kind": minority,
    "assemble_groups": frames,
    "stitch_groups": videos,
    "stitch_countdown": countdown,
    "segment_by_succession": succession,
    "segment_by_marker": marker_segments,
    "pair_adjacent": pairs,
    "segment_increasing": increasing,
    "carve": carved,
    "validated_runs": valid_runs,
    "missing_members": missing,
    "concat_payload": payloads,
    "locate_offset": located,
    "classify_lookahead": lookahead,
    "classify_lookahead_complete": whole_groups,
    "number_frames": numbered,
    "number_format": formats,
    "filter_number_range": number_range,
    "fill_audio": audio_fill,
    "fill_video": video_fill,
    "initial_offset": offsets,
}

ORACLES = {
    "segment_constant_stride": c.with_(c.DAY_EVENTS, STRIDE_WALK, recursive=True) + "SELECT * FROM streams",
    "derive_durations": c.with_(c.DAY_EVENTS, STRIDE_WALK, recursive=True) + """
SELECT src, channel, "start", "end", records, stride, sounding, "end" - "start" + 1 AS length,
       CASE WHEN "end" = "start" THEN 1 ELSE ("end" - "start" + 1) // stride + 1 END AS record_count,
       2016 * (CASE WHEN "end" = "start" THEN 1 ELSE ("end" - "start" + 1) // stride + 1 END) AS samples,
       CAST(CASE stride WHEN 4 THEN 1 WHEN 8 THEN 2 END AS INTEGER) AS speed,
       greatest(("end" - "start" + 1) // (CASE stride WHEN 4 THEN 75 ELSE 150 END), 1) AS seconds
FROM streams""",
    "segment_by_gap": c.with_(c.HOUR_EVENTS) + """
SELECT src, min(pos) AS "start", max(pos) AS "end", count(*) AS records, max(pos) - min(pos) + 1 AS length
FROM (SELECT src, pos, sum(brk) OVER (PARTITION BY src ORDER BY pos) AS seg
      FROM (SELECT src, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY src ORDER BY pos) + 12 THEN 1 ELSE 0 END AS brk
            FROM hour_events))
GROUP BY src, seg""",
    "summarise_segments": c.with_(c.HOUR_EVENTS) + """
SELECT src, min(pos) AS "start", max(pos) AS "end", count(*) AS records, min(event_id) AS first_number,
       max(event_id) AS last_number, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total,
       max(pos) - min(pos) + 1 AS length
FROM (SELECT *, sum(brk) OVER (PARTITION BY src ORDER BY pos) AS seg
      FROM (SELECT *, CASE WHEN pos > lag(pos) OVER w + 24 OR (value < 50) <> lag(value < 50) OVER w THEN 1 ELSE 0 END AS brk
            FROM hour_events WINDOW w AS (PARTITION BY src ORDER BY pos)))
GROUP BY src, seg""",
    "summarise_frames": c.with_(c.DISC_LINES, FRAMES) + """
, g AS (SELECT *, CASE WHEN "start" > lag("end") OVER (PARTITION BY src ORDER BY "start") + 2 THEN 1 ELSE 0 END AS brk
        FROM frames),
n AS (SELECT *, sum(brk) OVER (PARTITION BY src ORDER BY "start") AS video FROM g)
SELECT src, min("start") AS "start", max("end") AS "end", count(*) AS records,
       arg_min("end", "start") - min("start") AS first_offset, min(frame) AS first_number, max(frame) AS last_number,
       CAST(sum(chunks) AS BIGINT) AS total, max("end") - min("start") + 1 AS length
FROM n GROUP BY src, video""",
    "islands": c.with_(c.HOUR_EVENTS) + """
SELECT src, min(pos) AS "start", max(pos) AS "end", count(*) AS records
FROM (SELECT src, pos, event_type, count(*) FILTER (event_type = 'view') OVER (PARTITION BY src ORDER BY pos) AS grp
      FROM hour_events)
WHERE event_type <> 'view' GROUP BY src, grp""",
    "check_continuity": c.with_(c.HOUR_EVENTS) + """
SELECT src, pos, header_pos, previous
FROM (SELECT src, pos, header_pos, lag(header_pos) OVER (PARTITION BY src ORDER BY pos) AS previous
      FROM (SELECT *, CASE WHEN event_type <> 'error' THEN event_id END AS header_pos FROM hour_events))
WHERE header_pos IS NOT NULL AND previous IS NOT NULL AND header_pos <> previous + 1""",
    "minority_kind": c.with_(c.SUPPLIER_LINES) + """
SELECT src, pos, minor_before, major_before
FROM (SELECT src, pos, l_returnflag,
             count(*) FILTER (l_returnflag = 'A') OVER w AS minor_before,
             count(*) FILTER (l_returnflag = 'N') OVER w AS major_before
      FROM supplier_lines
      WINDOW w AS (PARTITION BY src ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE l_returnflag = 'A' AND minor_before < major_before""",
    "assemble_groups": c.with_(c.DISC_LINES, FRAMES) + "SELECT * FROM frames",
    "stitch_groups": c.with_(c.DISC_LINES, FRAMES, VIDEOS, recursive=True),
    "stitch_countdown": c.with_(c.DISC_LINES) + """
, flagged AS (
  SELECT src, l_returnflag AS channel, pos, 8 - CAST(l_linenumber AS BIGINT) AS number,
         CASE WHEN lag(pos) OVER w IS NULL OR l_linenumber < lag(l_linenumber) OVER w
                   OR pos > lag(pos) OVER w + 5 THEN 1 ELSE 0 END AS brk
  FROM disc_lines WINDOW w AS (PARTITION BY src, l_returnflag ORDER BY pos)),
grouped AS (SELECT *, sum(brk) OVER (PARTITION BY src, channel ORDER BY pos) AS g FROM flagged)
SELECT src, channel, pos, number, min(pos) OVER (PARTITION BY src, channel, g) AS seg,
       max(number) OVER (PARTITION BY src, channel, g) AS first_number,
       max(number) OVER (PARTITION BY src, channel, g) - number AS renumbered
FROM grouped""",
    "segment_by_succession": c.with_(c.DISC_LINES) + """
, g AS (SELECT *, pos - chunk AS diag FROM disc_lines)
SELECT src, min(pos) AS "start", max(pos) AS "end", count(*) AS records, min(chunk) AS first_number,
       max(chunk) AS last_number, count(*) FILTER (l_returnflag = 'R') AS payloads,
       CAST(min(floor(l_quantity / 25)) FILTER (l_returnflag = 'R') AS BIGINT) AS size
FROM (SELECT *, sum(b) OVER (PARTITION BY src ORDER BY pos) AS seg
      FROM (SELECT *, CASE WHEN diag = lag(diag) OVER (PARTITION BY src ORDER BY pos) THEN 0 ELSE 1 END AS b FROM g))
GROUP BY src, seg
HAVING min(chunk) = 0 AND count(*) FILTER (l_returnflag = 'R') > 0
   AND min(floor(l_quantity / 25)) FILTER (l_returnflag = 'R') = max(floor(l_quantity / 25)) FILTER (l_returnflag = 'R')""",
    "segment_by_marker": c.with_(c.HOUR_EVENTS) + """
, s AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY src ORDER BY pos) AS seg FROM hour_events),
b AS (SELECT *, max(CASE WHEN event_type = 'error' AND before = 'error' THEN 1 ELSE 0 END)
                OVER (PARTITION BY src, seg ORDER BY pos) AS spoiled
      FROM (SELECT *, lag(event_type) OVER (PARTITION BY src, seg ORDER BY pos) AS before FROM s))
SELECT src, min(pos) AS "start", max(pos) AS "end", count(*) AS records,
       count(*) FILTER (event_type = 'purchase') AS payloads
FROM b WHERE seg > 0 AND spoiled = 0 GROUP BY src, seg
HAVING count(*) FILTER (event_type = 'purchase') > 0""",
    "pair_adjacent": c.with_(c.TURNS) + """
, s AS (SELECT src, pos, role, length(text) AS value FROM turns WHERE role IN ('user', 'assistant'))
SELECT l.src, l.pos AS left_pos, r.pos AS right_pos, l.value AS left_value, r.value AS right_value
FROM (SELECT * FROM s WHERE role = 'user') l
LEFT JOIN (SELECT * FROM s WHERE role = 'assistant') r ON r.src = l.src AND r.pos = l.pos + 1
UNION ALL
SELECT r.src, NULL, r.pos, NULL, r.value
FROM (SELECT * FROM s WHERE role = 'assistant') r
WHERE NOT EXISTS (SELECT 1 FROM s l WHERE l.role = 'user' AND l.src = r.src AND l.pos = r.pos - 1)""",
    "segment_increasing": c.with_(c.PART_LINES) + """
, f AS (SELECT src, pos, l_linenumber AS number, l_linestatus AS rate, CAST(l_quantity AS BIGINT) AS units,
               date_diff('day', DATE '1995-01-01', l_shipdate) AS st FROM part_lines),
g AS (SELECT *, CASE WHEN rate = lag(rate) OVER w AND number > lag(number) OVER w THEN 0 ELSE 1 END AS brk,
             st - lag(st) OVER w AS gap FROM f WINDOW w AS (PARTITION BY src ORDER BY pos))
SELECT src, min(st) AS "start", max(st) AS "end", count(*) AS pairs, CAST(sum(units) AS BIGINT) AS units,
       min(rate) AS rate, coalesce(min(gap) FILTER (brk = 0), 1) AS min_gap
FROM (SELECT *, sum(brk) OVER (PARTITION BY src ORDER BY pos) AS seg FROM g) GROUP BY src, seg""",
    "carve": """
WITH lines AS (
  SELECT doc_id AS src, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
free AS (SELECT *, pos - row_number() OVER (PARTITION BY src ORDER BY pos) AS isle FROM lines WHERE length(line) % 7 <> 3),
placed AS (SELECT *, CAST(sum(length(line)) OVER (PARTITION BY src, isle ORDER BY pos) AS BIGINT) AS stop FROM free),
joined AS (SELECT src, isle, string_agg(line, '' ORDER BY pos) AS whole FROM free GROUP BY ALL),
spots AS (SELECT *, unnest(generate_series(0, length(whole) - 1, 4)) AS o FROM joined),
hits AS (SELECT src, isle, o, regexp_extract(substr(whole, o + 1), '^th[a-e][a-z]*') AS found FROM spots
         WHERE substr(whole, o + 1, 2) = 'th')
SELECT h.src, s.pos AS "start", o - s.stop + length(s.line) AS "offset", e.pos AS "end", found
FROM hits h
JOIN placed s ON s.src = h.src AND s.isle = h.isle AND o < s.stop AND o >= s.stop - length(s.line)
JOIN placed e ON e.src = h.src AND e.isle = h.isle AND o + length(found) - 1 < e.stop
     AND o + length(found) - 1 >= e.stop - length(e.line)
WHERE found <> ''""",
    "validated_runs": c.with_(c.HOUR_EVENTS) + """
, v AS (SELECT src, pos, pos % 4 AS phase, event_type = 'purchase' AS last, value < 50 AS zero,
               event_type <> 'error' AS valid FROM hour_events),
g AS (SELECT *, CASE WHEN lag(valid) OVER w AND NOT lag(last) OVER w AND pos = lag(pos) OVER w + 4 THEN 0 ELSE 1 END AS brk
      FROM v WINDOW w AS (PARTITION BY src, phase ORDER BY pos))
SELECT src, phase, min(pos) AS "start", max(pos) AS "end", count(*) AS units
FROM (SELECT *, sum(brk) OVER (PARTITION BY src, phase ORDER BY pos) AS seg FROM g)
WHERE valid GROUP BY src, phase, seg
HAVING bool_or(last) AND NOT bool_and(zero) AND count(*) >= 2""",
    "missing_members": """
SELECT l_orderkey, m AS missing FROM (SELECT DISTINCT l_orderkey FROM lineitem), range(7) r(m)
WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = lineitem.l_orderkey AND x.l_linenumber - 1 = m)"""
        .replace("(SELECT DISTINCT l_orderkey FROM lineitem),", "(SELECT DISTINCT l_orderkey FROM lineitem) k,")
        .replace("lineitem.l_orderkey AND", "k.l_orderkey AND"),
    "concat_payload": c.with_(c.TURNS) + """
, t AS (SELECT *, pos = min(pos) OVER (PARTITION BY src) AS is_first, pos = max(pos) OVER (PARTITION BY src) AS is_last
        FROM turns),
cutted AS (SELECT src, pos, substr(text, CASE WHEN is_first THEN 3 ELSE 1 END,
             length(text) - CASE WHEN is_first THEN 2 ELSE 0 END - CASE WHEN is_last THEN 1 ELSE 0 END) AS piece FROM t)
SELECT src, min(pos) AS "start", max(pos) AS "end", CAST(sum(length(piece)) AS BIGINT) AS size, true AS legal,
       md5(string_agg(piece, '' ORDER BY pos)) AS digest
FROM cutted GROUP BY src""",
    "locate_offset": c.with_(c.TURNS) + """
, p AS (SELECT src, pos, length(text) AS len,
               coalesce(sum(length(text)) OVER (PARTITION BY src ORDER BY pos
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM turns),
q AS (SELECT DISTINCT src, "at" FROM (SELECT src, unnest([0, 150, length(text), 1000]) AS "at" FROM turns))
SELECT q.src, q."at", p.pos, CAST(q."at" - p.off AS BIGINT) AS "inner"
FROM q JOIN p ON p.src = q.src AND q."at" >= p.off AND q."at" < p.off + p.len""",
    "classify_lookahead": c.with_(c.DISC_LINES) + """
, o AS (SELECT *, max(CASE WHEN chunk = 0 THEN pos END) OVER (PARTITION BY src ORDER BY pos) AS group_start FROM disc_lines),
done AS (SELECT src, group_start, min(pos) AS stop FROM o
         WHERE chunk >= 5 AND pos <= group_start + 15 GROUP BY 1, 2)
SELECT o.src, o.pos, o.group_start FROM o JOIN done USING (src, group_start)
WHERE o.pos <= stop AND (chunk = 0 OR chunk >= 5 OR l_returnflag <> 'A')""",
    "classify_lookahead_complete": c.with_(c.DISC_LINES) + """
, o AS (SELECT *, max(CASE WHEN chunk = 0 THEN pos END) OVER (PARTITION BY src ORDER BY pos) AS group_start FROM disc_lines),
done AS (SELECT src, group_start, min(pos) AS stop FROM o
         WHERE chunk >= 3 AND pos <= group_start + 15 GROUP BY 1, 2),
held AS (SELECT o.src, o.pos, o.group_start, o.chunk FROM o JOIN done USING (src, group_start)
         WHERE o.pos <= stop AND (chunk = 0 OR chunk >= 3 OR l_returnflag <> 'A')),
lists AS (SELECT src, group_start, list(chunk ORDER BY pos) AS chunks FROM held GROUP BY 1, 2)
SELECT src, pos, group_start FROM held JOIN lists USING (src, group_start)
WHERE len(chunks) >= 4 AND chunks = list_transform(range(len(chunks)), lambda i: CAST(i AS BIGINT))""",
    "number_frames": c.with_(c.DISC_LINES, NUMBERED) + "SELECT * FROM numbered",
    "number_format": c.with_(c.DISC_LINES, NUMBERED) + """
SELECT src, min(frame) AS "first", max(frame) AS "last", arg_max(header_dup, pos) AS last_dup, max(header_dup) AS max_dup,
       min(frame) || '-' || max(frame) || CASE WHEN max(header_dup) > 0
         THEN '.' || arg_max(header_dup, pos) || '/' || max(header_dup) ELSE '' END AS text,
       CASE WHEN max(frame) = 0 THEN 0 ELSE length(CAST(max(frame) AS VARCHAR)) END AS digits,
       false AS backwards
FROM numbered GROUP BY src""",
    "filter_number_range": c.with_(c.DISC_LINES, NUMBERED) + """
SELECT src, pos, frame, header_dup FROM numbered
WHERE (frame > 100 OR (frame = 100 AND header_dup >= 1)) AND (frame < 5000 OR (frame = 5000 AND header_dup <= 0))""",
    "fill_audio": c.with_(c.HOUR_EVENTS, """r AS (
  SELECT src, pos, CAST(floor(value) AS BIGINT) AS samples, row_number() OVER (PARTITION BY src ORDER BY pos) AS rn,
         (2 * 40 * (pos - min(pos) OVER (PARTITION BY src)) + 3) // 6 AS target FROM hour_events),
walk AS (
  SELECT src, rn, pos, samples, greatest(0, target) AS silence, CAST(0 AS BIGINT) AS written FROM r WHERE rn = 1
  UNION ALL
  SELECT r.src, r.rn, r.pos, r.samples, greatest(0, r.target - (w.written + w.silence + w.samples)),
         w.written + w.silence + w.samples
  FROM walk w JOIN r ON r.src = w.src AND r.rn = w.rn + 1)""", recursive=True)
    + "SELECT src, pos, samples, silence, written FROM walk",
    "fill_video": c.with_(c.HOUR_EVENTS, """r AS (
  SELECT src, pos, row_number() OVER (PARTITION BY src ORDER BY pos) AS rn,
         (pos - min(pos) OVER (PARTITION BY src)) AS gone FROM hour_events),
walk AS (
  SELECT src, rn, pos, CAST(0 AS BIGINT) AS repeats, CAST(0 AS BIGINT) AS ahead, CAST(0 AS BIGINT) AS written
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.src, r.rn, r.pos, greatest(0, CAST(floor(gone * 2 / 19.0 - (w.written + w.repeats + 1) + 0.5) AS BIGINT)),
         CASE WHEN 10 * gone - 95 * (w.written + w.repeats + 1) <= -76
              THEN -CAST(floor(gone * 2 / 19.0 - (w.written + w.repeats + 1) + 0.5) AS BIGINT) ELSE 0 END,
         w.written + w.repeats + 1
  FROM walk w JOIN r ON r.src = w.src AND r.rn = w.rn + 1)""", recursive=True)
    + "SELECT src, pos, repeats, ahead, written FROM walk",
    "initial_offset": c.with_(c.ORDER_ITEMS) + """
, d AS (SELECT id, "start" - "end" AS diff FROM order_items UNION ALL SELECT id, "end" - "start" FROM order_items),
f AS (SELECT id, diff, CASE WHEN diff < 0 THEN CAST(-floor(diff * 2 / 7.0) AS BIGINT) ELSE 0 END AS frame_delay FROM d)
SELECT id, frame_delay, CAST(floor((882 * diff + frame_delay * 3087) / 150.0 + 0.5) AS BIGINT) AS sample_delay FROM f""",
}
