"""URL filters: fixed host and path rules first, then association rules mined from labelled urls.

FP-growth finds combinations of url tokens that go with a bad label.  Rules below a confidence or count are not mined, and of the
others only the shortest stay: a rule whose tokens include another's adds nothing.  Each rule is filed under its rarest token, an
inverted index: a url looks up its tokens there and checks the few rules it finds.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmine.llm.storage import small_side, written

#: A rule must hold for so many labelled bad urls, however many there are in all; fewer are chance.
MIN_COUNT = 10
MIN_CONFIDENCE = 0.8
BAD = "=bad"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host`` (A-Z lower-cased), ``path`` and ``query``; all empty for null or without ``://``."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    out = df.withColumn("rest_", rest).withColumn("raw_", F.regexp_extract("rest_", r"^[^/?#]*", 0))
    out = out.withColumn("tail_", F.expr("substring(rest_, length(raw_) + 1)"))
    return (out.withColumn("host", F.translate("raw_", UPPER, LOWER)).withColumn("path", F.regexp_extract("tail_", r"^[^?#]*", 0))
            .withColumn("query", F.expr("regexp_extract(substring(tail_, length(path) + 1), '^[^#]*', 0)")).drop("rest_", "raw_", "tail_"))


def fixed_rule(rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fixed rule that fits ``host`` and ``path``; null if none does."""
    name = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens() -> Column:
    """Distinct tokens of ``host``, ``path`` and ``query``; runs of digits are made equal."""
    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.concat(F.lit(kind), F.regexp_replace(F.lower(x), "[0-9]+", "0")))

    return F.array_sort(F.array_distinct(F.concat(
        of("h:", F.regexp_extract_all("host", F.lit(r"([^.\-:@]+)"))), of("p:", F.regexp_extract_all("path", F.lit(r"([^/._\-]+)"))),
        of("q:", F.regexp_extract_all("query", F.lit(r"[?&]([^=&]+)"))))))


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", min_count: int = MIN_COUNT,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from urls with a Boolean ``bad``: ``anchor``, ``wanted`` (tokens), ``confidence``, ``support``.

    All labelled urls count.  Null urls and labels are left out; repeated rows count as often as they come.  Without labelled rows, and where
    tokens say nothing of the label, there are no rules.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col(url).isNotNull() & F.col(bad).isNotNull()).select(F.col(url).alias("url"), F.col(bad).alias("bad"))
    baskets = split_url(known).select(F.array_union(tokens(), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    schema = "anchor string, wanted array<string>, confidence double, support double"
    baskets = written(baskets, "baskets")
    n = baskets.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_count - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    rules = (model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
             .select(F.array_sort("antecedent").alias("wanted"), "confidence", "support"))
    rules = written(rules, "mined").withColumn("id", F.array_join("wanted", " "))
    # Shortest rules only: those that hold no other one.  Rules meet by a token of the shorter one.
    short = rules.select(F.col("wanted").alias("w"), F.element_at("wanted", 1).alias("token"), F.col("id").alias("other"))
    long = rules.where(F.size("wanted") > 1).select("id", "wanted", F.explode("wanted").alias("token"))
    covered = (long.join(short, "token").where((F.size("w") < F.size("wanted")) & (F.size(F.array_intersect("w", "wanted")) == F.size("w")))
               .select("id").distinct())
    rules = rules.join(covered, "id", "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    anchors = (rules.select("id", F.explode("wanted").alias("token")).join(single, "token")
               .groupBy("id").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor")))
    return written(rules.join(anchors, "id").select("anchor", "wanted", "confidence", "support"), "rules")


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Of token sets (``id``, ``tokens``) the ids that some rule fits, by the inverted index, with the best ``confidence``."""
    at = sets.select("id", "tokens", F.explode("tokens").alias("anchor"))
    fits = F.size(F.array_intersect("wanted", "tokens")) == F.size("wanted")
    return at.join(rules, "anchor").where(fits).groupBy("id").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", fixed=RULES) -> DataFrame:
    """One row per page: key, ``host``, ``path``, ``rule``, ``verdict``, ``confidence`` (of the mined rule that blocks, else null).

    A url that is null or has no ``://`` has an empty host and path and is allowed unless a mined rule needs no token, which none does.
    Repeated rows come out repeatedly; an empty table gives no rows; other columns are not read.  Pages meet mined rules as distinct sets of
    tokens, so a host with a third of all pages is looked up a few times only.
    """
    kind = pages.schema[key].dataType.simpleString()
    name, verdict = fixed_rule(fixed)
    found = split_url(pages.select(F.col(key).cast(kind).alias("k"), F.col(url).alias("url")))
    found = found.withColumn("rule", name).withColumn("fixed", verdict).withColumn("tokens", tokens())
    found = found.withColumn("id", F.array_join("tokens", " "))
    sets = found.where("rule is null").groupBy("id").agg(F.min("tokens").alias("tokens"))
    # Sets that a rule fits are few as a rule; small_side counts them, so pages are not shuffled for them.
    hit = small_side(written(matches(sets, rules), "hits"))
    out = found.join(hit, "id", "left")
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("fixed", mined).alias("verdict"),
                      F.when(F.col("fixed").isNull(), F.col("confidence")).alias("confidence"))
