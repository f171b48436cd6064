"""How the driver tables are read as runs, streams, frames and items.

Each convention exists twice: as a DataFrame and as the SQL text the check uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmine.plans.blocks import Run, by_density, by_position, catch_up, dense_index, spread

ROWS_PER_BLOCK = 1 << 14
POSITIONS_PER_BLOCK = 1 << 14
ITEMS_PER_BLOCK = 1 << 18
FEW = 64

LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
LEGAL_STRIDES = tuple(range(1, 9))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def blocks(df: DataFrame, keys: list[str], pos: str = "pos") -> tuple[DataFrame, Run]:
    return by_position(df, keys, pos, POSITIONS_PER_BLOCK)


def hours(ts: str = "ts"):
    return F.expr(f"timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', {ts})")


def days(col: str, since: str = "1995-01-01"):
    return F.datediff(F.col(col), F.lit(since).cast("date")).cast("bigint")


def _own_positions(events: DataFrame, keys: list[str], unit) -> DataFrame:
    """Every event at a position of its own: that of its hour or day, or the next one free after the event before it."""
    cells, run = blocks(events.withColumn("_at", unit), keys, "_at")
    run = Run(run.keys, ("ts", "event_id"), run.block)
    rows = catch_up(cells, run, F.col("_at"), F.lit(1).cast("bigint"), "_free")
    return rows.withColumn("pos", F.col("written") + F.col("_free"))


def hour_events(spark: SparkSession, d: str) -> DataFrame:
    """All events of a user, one position each: ``src, pos, event_id, event_type, value``."""
    e = table(spark, d, "events").select(F.col("user_id").alias("src"), "ts", "event_id", "event_type", "value")
    return _own_positions(e, ["src"], hours()).select("src", "pos", "event_id", "event_type", "value")


def day_events(spark: SparkSession, d: str) -> DataFrame:
    """All events of a user and channel, one position each, with the stream columns."""
    e = table(spark, d, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 2).alias("channel"),
                                         "ts", "event_id", "event_type", "value")
    rows = _own_positions(e, ["src", "channel"], F.expr("timestampdiff(DAY, timestamp_ntz'2024-01-01 00:00:00', ts)"))
    kind = F.col("event_type")
    return rows.select("src", "channel", "pos", (kind != "purchase").alias("stream"), (kind == "purchase").alias("end_mark"),
                       (kind == "error").alias("fmt"), (F.col("value") < 50).alias("silent"))


def _lines(spark: SparkSession, d: str, keys: dict, order: tuple[str, ...], coarse, fine: str):
    t = table(spark, d, "lineitem").select(*LINE_ORDER)
    t = t.withColumns(keys).withColumn("_coarse", coarse)
    cells, block = by_density(t, list(keys), "_coarse", fine, ROWS_PER_BLOCK)
    run = Run(tuple(keys), order, block)
    rows = dense_index(cells, run, "pos", start=1)
    return rows, Run(tuple(keys), ("pos",), block)


def disc_lines(spark: SparkSession, d: str) -> tuple[DataFrame, Run]:
    """Lines in order of their orders; 64 order keys make one source.

    ``frame`` is the order, ``chunk`` the line number from 0, ``expected`` 7.
    """
    order = ("l_orderkey", "l_linenumber", *[c for c in LINE_ORDER if c not in ("l_orderkey", "l_linenumber")])
    rows, run = _lines(spark, d, {"src": F.floor(F.col("l_orderkey") / 64)}, order,
                       F.col("l_orderkey"), "l_linenumber")
    return (rows.withColumn("frame", F.col("l_orderkey"))
            .withColumn("chunk", F.col("l_linenumber").cast("bigint") - 1)
            .withColumn("expected", F.lit(7).cast("bigint"))), run


def supplier_lines(spark: SparkSession, d: str) -> tuple[DataFrame, Run]:
    return _lines(spark, d, {"src": F.col("l_suppkey")}, LINE_ORDER, days("l_shipdate"), "l_orderkey")


def part_lines(spark: SparkSession, d: str) -> tuple[DataFrame, Run]:
    return _lines(spark, d, {"src": F.col("l_partkey")}, LINE_ORDER, days("l_shipdate"), "l_orderkey")


def line_count(spark: SparkSession, d: str) -> int:
    """Rows of the largest table, by which joins with it are dealt."""
    return table(spark, d, "lineitem").count()


def order_items_table(spark: SparkSession, d: str) -> DataFrame:
    """One interval per order: ``src, id, start, end, kind``."""
    size = line_count(spark, d)
    ends = (spread(table(spark, d, "lineitem").select("l_orderkey", "l_shipdate"), size, "l_orderkey").groupBy("l_orderkey")
            .agg(F.max("l_shipdate").alias("_shipped")))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    o = spread(o, size, "o_orderkey").join(ends, F.col("o_orderkey") == F.col("l_orderkey"))
    start = days("o_orderdate")
    kind = (F.when(F.col("o_orderstatus") == "F", "file").when(F.col("o_orderstatus") == "O", "video")
            .otherwise("audio"))
    return o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("id"), start.alias("start"),
                    F.greatest(start, days("_shipped")).alias("end"), kind.alias("kind"))


def customer_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items on the time line of their customer: ``src, pos`` and line columns."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag",
                                              "l_linestatus", "l_shipdate")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), "o_orderkey")
    size = line_count(spark, d)
    return (spread(line, size, "l_orderkey").join(spread(o, size, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumn("pos", days("l_shipdate")).drop("o_orderkey", "l_shipdate"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumnRenamed("conv_id", "src").withColumnRenamed("turn", "pos")


HOUR_EVENTS = """hour_events AS (
  SELECT src, n - 1 + greatest(0, max(unit - n + 1) OVER (PARTITION BY src ORDER BY n)) AS pos, event_id, event_type, value
  FROM (SELECT user_id AS src, epoch_us(ts) // 3600000000 - 473352 AS unit, event_id, event_type, value,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))"""

DAY_EVENTS = """day_events AS (
  SELECT src, channel, n - 1 + greatest(0, max(unit - n + 1) OVER (PARTITION BY src, channel ORDER BY n)) AS pos,
         event_type <> 'purchase' AS stream, event_type = 'purchase' AS end_mark,
         event_type = 'error' AS fmt, value < 50 AS silent
  FROM (SELECT user_id AS src, event_id % 2 AS channel, epoch_us(ts) // 86400000000 - 19723 AS unit, event_type, value,
               row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS n FROM events))"""

_ALL = ", ".join(LINE_ORDER)
_DISC = ", ".join(("l_orderkey", "l_linenumber",
                   *[c for c in LINE_ORDER if c not in ("l_orderkey", "l_linenumber")]))

DISC_LINES = f"""disc_lines AS (
  SELECT *, l_orderkey // 64 AS src, l_orderkey AS frame, CAST(l_linenumber AS BIGINT) - 1 AS chunk,
         CAST(7 AS BIGINT) AS expected,
         row_number() OVER (PARTITION BY l_orderkey // 64 ORDER BY {_DISC}) AS pos
  FROM lineitem)"""

SUPPLIER_LINES = f"""supplier_lines AS (
  SELECT *, l_suppkey AS src, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ALL}) AS pos
  FROM lineitem)"""

PART_LINES = f"""part_lines AS (
  SELECT *, l_partkey AS src, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ALL}) AS pos
  FROM lineitem)"""

ORDER_ITEMS = """order_items AS (
  SELECT o_custkey AS src, o_orderkey AS id, date_diff('day', DATE '1995-01-01', o_orderdate) AS "start",
         greatest(date_diff('day', DATE '1995-01-01', o_orderdate),
                  date_diff('day', DATE '1995-01-01', shipped)) AS "end",
         CASE o_orderstatus WHEN 'F' THEN 'file' WHEN 'O' THEN 'video' ELSE 'audio' END AS kind
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1)
       ON o_orderkey = l_orderkey)"""

CUSTOMER_LINES = """customer_lines AS (
  SELECT o_custkey AS src, date_diff('day', DATE '1995-01-01', l_shipdate) AS pos,
         l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

TURNS = "turns AS (SELECT conv_id AS src, turn AS pos, role, text FROM conversations)"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
