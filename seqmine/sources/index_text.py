"""Items as lines of ``key:value`` pairs joined by ``|``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The text form of an index.
REQUIRED_KEYS = ("#", "ID", "Type", "Sectors")
COMMENT = ";"
SOURCE_START = "Filename:"
HEADER = "[ordered item index v1]"


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``kind`` (comment, blank, source, item, bad), ``reason`` and ``fields``.

    A bad line keeps its text and a reason; nothing is thrown.
    """
    text = F.col(line)
    parts = F.transform(F.split(text, r"\|"), lambda p: F.split(F.regexp_replace(p, ":+$", ""), ":"))
    well_formed = F.forall(parts, lambda p: F.size(p) == 2)
    keys = F.transform(parts, lambda p: F.element_at(p, 1))
    out = lines.withColumn("_parts", parts).withColumn("_keys", keys)
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.col("_keys"))) > 0
    reason = (F.when(~well_formed, "field")
              .when(F.size(F.array_distinct("_keys")) < F.size("_keys"), "duplicate key")
              .when(F.exists("_keys", lambda k: k == ""), "empty key")
              .when(missing, "missing key"))
    kind = (F.when(text.startswith(COMMENT), "comment").when(F.trim(text) == "", "blank")
            .when(text.startswith(SOURCE_START), "source"))
    out = out.withColumn("_kind", kind).withColumn("reason", F.when(kind.isNull(), reason))
    entries = F.transform("_parts", lambda p: F.struct(F.element_at(p, 1), F.element_at(p, 2)))
    return (out.withColumn("kind", F.coalesce("_kind", F.when(F.col("reason").isNull(), "item").otherwise("bad")))
            .withColumn("fields", F.when(F.col("kind") == "item", F.map_from_entries(entries)))
            .drop("_parts", "_keys", "_kind"))


def read_index(spark: SparkSession, path: str, src: str = "src") -> tuple[DataFrame, DataFrame]:
    """Items and bad lines of the indexes below ``path``.

    ``write_index`` keeps each source in a folder ``src=...``; where there is no such
    folder the file name stands for the source.  Every source must hold the header
    line once and exactly one source line.
    """
    text = spark.read.text(path)
    name = F.col(src).cast("string") if src in text.columns else F.input_file_name()
    lines = text.select(name.alias(src), F.col("value").alias("line"))
    parsed = parse_lines(lines.where(F.col("line") != HEADER))
    heads = lines.groupBy(src).agg(F.count_if(F.col("line") == HEADER).alias("headers"),
                                   F.count_if(F.col("line").startswith(SOURCE_START)).alias("sources"))
    valid = heads.where("headers = 1 and sources = 1").select(src)
    faulty = heads.where("headers <> 1 or sources <> 1").select(
        src, F.lit(None).cast("string").alias("line"),
        F.when(F.col("headers") != 1, "no header").when(F.col("sources") == 0, "no source")
        .otherwise("several sources").alias("reason"))
    items = parsed.where("kind = 'item'").join(valid, src, "left_semi").select(src, "line", "fields")
    bad = parsed.where("kind = 'bad'").select(src, "line", "reason").unionByName(faulty)
    return items, bad


_TYPES = {"int": r"^-?[0-9]+$", "long": r"^-?[0-9]+$", "yes_no": r"^(?i:yes|no)$",
          "range": r"^([0-9]+)-([0-9]+)$", "fraction": r"^([0-9]+)/([0-9]+)$", "string": r"(?s)^.*$"}


def typed_fields(df: DataFrame, spec: dict[str, str], fields: str = "fields") -> DataFrame:
    """Typed columns from the field map, and ``error`` naming the first field that fails.

    Types: ``int``, ``long``, ``yes_no``, ``range`` and ``fraction`` (two columns
    each, ``_1`` and ``_2``) and ``string``.  A missing key is an error.
    """
    out, errors = {}, []
    for name, kind in spec.items():
        value = F.try_element_at(F.col(fields), F.lit(name))
        ok = value.rlike(_TYPES[kind])
        if kind in ("range", "fraction"):
            one, two = (F.when(ok, F.regexp_extract(value, _TYPES[kind], i).try_cast("bigint")) for i in (1, 2))
            out[f"{name}_1"], out[f"{name}_2"] = one, two
            failed = one.isNull() | two.isNull()
        elif kind == "yes_no":
            out[name] = F.when(ok, F.lower(value) == "yes")
            failed = ~ok
        elif kind == "string":
            out[name] = value
            failed = value.isNull()
        else:
            out[name] = F.when(ok, value.try_cast("int" if kind == "int" else "bigint"))
            failed = out[name].isNull()
        errors.append(F.when(value.isNull(), F.lit(f"{name}: missing"))
                      .when(F.coalesce(failed, F.lit(True)), F.concat(F.lit(f"{name}: not {kind}: "), value)))
    return df.withColumns({**out, "error": F.coalesce(*errors)})


def render_items(items: DataFrame, fields: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds ``line`` and ``problem``; a refused item has a null line.

    Items need ``number, item_id, kind, start, end``.  Keys must be distinct and not
    empty, keys and values may not hold ``:`` or ``|``, ranges may not be negative.
    """
    names = [n for n, _ in fields]
    if len(set(names) | set(REQUIRED_KEYS)) < len(names) + len(REQUIRED_KEYS):
        raise ValueError("duplicate or required key")
    if any(n == "" or ":" in n or "|" in n for n in names):
        raise ValueError("illegal key")
    span = F.concat_ws("-", "start", "end")
    values = [("#", F.col("number").cast("string")), ("ID", F.col("item_id")), ("Type", F.col("kind")),
              ("Sectors", span), *[(n, c.cast("string")) for n, c in fields]]
    illegal = F.lit(False)
    for _, value in values:
        illegal = illegal | F.coalesce(value.rlike(r"[:|]"), F.lit(False))
    problem = (F.when((F.col("start") < 0) | (F.col("end") < 0), "negative range")
               .when(illegal, "illegal character"))
    line = F.concat_ws("|", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}:"), v)) for k, v in values])
    return items.withColumn("problem", problem).withColumn("line", F.when(problem.isNull(), line))


def write_index(rendered: DataFrame, path: str, src: str = "src", number: str = "number") -> None:
    """One folder per source; its part files in order hold header, source line and items.

    Lines are spread by range of ``(src, number)``, so a large source fills several
    part files instead of one task.
    """
    body = rendered.where(F.col("line").isNotNull()).select(src, F.col(number).alias("_n"), "line")
    head = lambda n, line: F.struct(F.lit(n).cast("bigint").alias("_n"), line.alias("line"))
    heads = (body.select(src).distinct()
             .select(src, F.explode(F.array(
                 head(-2, F.lit(HEADER)), head(-1, F.concat(F.lit(SOURCE_START), F.col(src).cast("string"))))).alias("_h"))
             .select(src, "_h._n", "_h.line"))
    (body.unionByName(heads).repartitionByRange(src, "_n").sortWithinPartitions(src, "_n")
     .select(src, F.col("line").alias("value")).write.partitionBy(src).text(path))
