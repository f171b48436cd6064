"""A quality classifier trained by co-training on two views of a document.

The content view sees the text (shares of symbols, capitals, digits, repeated words and so on), the metadata view the other columns
(length, language, source).  Each round both views score a pool of unlabelled documents; those of which one view is most confident,
as many good as bad ones by their shares, become labelled examples for the other.  Afterwards both views are calibrated and
combined on labelled documents that no round has seen, and the result scores all documents in one pass over their text.

Training sees a bounded sample, ``TRAIN_ROWS`` labelled and ``POOL_ROWS`` unlabelled documents chosen by a hash of their key.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmine.llm.storage import small_side, written

TRAIN_ROWS = 20_000
POOL_ROWS = 20_000
ROUNDS = 3
#: Pool documents that a view labels for the other in a round, at most, if it is at least this sure of them.
HANDED = 1000
SURE = 0.95
#: One labelled document in so many is kept for calibration, as many again for measuring.
FOLDS = 5
SOURCE_BINS = 16

CONTENT = ("symbols", "capitals", "digits", "exclamations", "punctuation", "other_bytes", "distinct_words", "repeated_neighbours",
           "word_length", "log_words", "distinct_lines", "long_words")
_SYMBOLS, _CAPITALS, _DIGITS = b"#*$%&|<>^~{}\\=_+", bytes(range(65, 91)), b"0123456789"
_PUNCTUATION, _SPACE = b".,;:?'\"-()", b" \t\n\x0b\x0c\r"
_HIGH = bytes(range(128, 256))


def content(text: str | None) -> list[float]:
    """Numbers that describe a text; a null or empty one has only zeros."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(CONTENT)
    solid = sum(map(len, words))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / solid
    lines = [line for line in raw.split(b"\n") if line.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [share(_SYMBOLS), share(_CAPITALS), share(_DIGITS), share(b"!"), share(_PUNCTUATION), share(_HIGH), len(set(words)) / n, same / n,
            solid / n / 10, math.log1p(n) / 10, len(set(lines)) / len(lines), max(map(len, words)) / 100]


def metadata(length: float | None, lang: str | None, source: str | None) -> list[float]:
    """Length, and language and source as hashed categories; nulls are categories of their own."""
    out = [math.log1p(max(0.0, float(length or 0))) / 10, float(length is None)]
    for value, bins in ((lang, 8), (source, SOURCE_BINS)):
        hot = [0.0] * bins
        hot[zlib.crc32(b"\x00" if value is None else value.encode()) % bins] = 1.0
        out += hot
    return out


@dataclass(frozen=True)
class Model:
    """Weights (last one: constant) of the two views and of the log-odds that they give."""

    content: tuple[float, ...]
    metadata: tuple[float, ...]
    combined: tuple[float, float, float]

    def score(self, content_view: np.ndarray, metadata_view: np.ndarray) -> np.ndarray:
        a, b = (np.clip(x @ np.array(w[:-1]) + w[-1], -30, 30) for x, w in ((content_view, self.content), (metadata_view, self.metadata)))
        return 1 / (1 + np.exp(-(a * self.combined[0] + b * self.combined[1] + self.combined[2])))


def features(docs: DataFrame, key: str, text: str, length: str, lang: str, source: str) -> DataFrame:
    """``k``, ``content`` and ``metadata`` (arrays) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, t, n, a, s = (batch.column(c) for c in ("k", "t", "n", "lang", "source"))
            yield pa.RecordBatch.from_arrays(
                [k, pa.array(map(content, t.to_pylist()), pa.list_(pa.float64())),
                 pa.array(map(metadata, n.to_pylist(), a.to_pylist(), s.to_pylist()), pa.list_(pa.float64()))], ["k", "content", "metadata"])

    return _columns(docs, key, text, length, lang, source).mapInArrow(run, "k long, content array<double>, metadata array<double>")


def _columns(docs: DataFrame, key: str, text: str, length: str, lang: str, source: str) -> DataFrame:
    """The columns that the views read; one that ``docs`` lacks is null."""
    def column(name: str, kind: str):
        return F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)

    return docs.select(F.col(key).cast("long").alias("k"), column(text, "string").alias("t"), column(length, "double").alias("n"),
                       column(lang, "string").alias("lang"), column(source, "string").alias("source"))


def _fit(rows: DataFrame, view: str) -> tuple[float, ...] | None:
    """Logistic regression on a view; None if the rows hold one class only."""
    ready = rows.select(F.col("y").cast("double").alias("label"), array_to_vector(view).alias("features"))
    if ready.select("label").distinct().count() < 2:
        return None
    model = LogisticRegression(maxIter=50, regParam=1e-3, aggregationDepth=2).fit(ready)
    return (*model.coefficients.toArray().tolist(), float(model.intercept))


def _logit(view: str, weights: tuple[float, ...]):
    """Log-odds as a native expression, clipped so that a combination stays finite."""
    products = F.zip_with(view, F.array(*map(F.lit, weights[:-1])), lambda x, w: x * w)
    return F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.aggregate(products, F.lit(float(weights[-1])), lambda a, x: a + x)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", lang: str = "lang",
          source: str = "source", label: str = "quality", rounds: int = ROUNDS, train_rows: int = TRAIN_ROWS, pool_rows: int = POOL_ROWS) -> Model | None:
    """A model, or None if labelled documents of both classes are missing.

    Several labels of one document count as their majority, a tie as bad; null keys and labels are left out.
    """
    known = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("k"))
             .agg((F.avg(F.col(label).cast("double")) > 0.5).cast("int").alias("y")))
    known = written(known, "labels")
    n_known, n_docs = known.count(), docs.count()
    share = lambda rows, of: int(min(1.0, rows / max(1, of)) * (1 << 20))
    place = F.pmod(F.xxhash64("k", F.lit(3)), F.lit(1 << 20))
    chosen = known.where(place < share(train_rows, n_known))
    keys = docs.select(F.col(key).cast("long").alias("k")).where("k is not null")
    pool = keys.join(known, "k", "left_anti").where(place < share(pool_rows, n_docs)).distinct().withColumn("y", F.lit(None).cast("int"))
    wanted = written(chosen.unionByName(pool), "training-keys")
    picked = docs.join(small_side(wanted.select("k")), F.col(key).cast("long") == F.col("k"), "left_semi")
    seen = features(picked, key, text, length, lang, source).join(wanted, "k")
    seen = written(seen.withColumn("fold", F.when(F.col("y").isNotNull(), F.pmod(F.xxhash64("k", F.lit(4)), F.lit(FOLDS)))), "training")
    base, held = seen.where("fold > 1"), seen.where("fold = 0")
    pool, columns = seen.where("y is null"), ["k", "content", "metadata", "y"]
    own = {"content": base.select(*columns), "metadata": base.select(*columns)}
    weights = {view: _fit(rows, view) for view, rows in own.items()}
    if None in weights.values():
        return None
    good = base.agg(F.avg("y")).first()[0]
    for _ in range(rounds):
        handed = {}
        for view, other in (("content", "metadata"), ("metadata", "content")):
            scored = pool.withColumn("p", 1 / (1 + F.exp(-_logit(view, weights[view]))))
            sure = [scored.where(F.col("p") >= SURE).withColumn("y", F.lit(1)).orderBy(F.desc("p"), "k").limit(round(HANDED * good)),
                    scored.where(F.col("p") <= 1 - SURE).withColumn("y", F.lit(0)).orderBy("p", "k").limit(round(HANDED * (1 - good)))]
            handed[other] = sure[0].unionByName(sure[1]).select(*columns)
        for view, rows in handed.items():
            own[view] = written(base.select(*columns).unionByName(rows), "co-training")
        weights = {view: _fit(rows, view) or weights[view] for view, rows in own.items()}
    views = held.select("y", F.array(_logit("content", weights["content"]), _logit("metadata", weights["metadata"])).alias("views"))
    combined = _fit(written(views, "calibration"), "views") or (1.0, 0.0, 0.0)
    return Model(weights["content"], weights["metadata"], combined)


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", length: str = "n_chars", lang: str = "lang",
          source: str = "source", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``quality_score`` (chance to be good) and ``kept`` (not below ``threshold``).

    Rows are scored one by one, repeated ones alike; null and empty texts are scored by what the views make of them.  Without a
    model the score is null and every row is kept.  Columns of these two names are replaced; an empty table gives no rows.
    """
    docs = docs.drop("quality_score", "kept")
    if model is None:
        return docs.withColumn("quality_score", F.lit(None).cast("double")).withColumn("kept", F.lit(True))

    @F.pandas_udf("double")
    def rate(t: pd.Series, n: pd.Series, a: pd.Series, s: pd.Series) -> pd.Series:
        if not len(t):
            return pd.Series([], dtype=float)
        length_ = [None if v is None or v != v else v for v in n.tolist()]
        x = np.array([content(v) for v in t.tolist()])
        m = np.array([metadata(*v) for v in zip(length_, a.tolist(), s.tolist())])
        return pd.Series(model.score(x, m))

    def column(name: str, kind: str):
        return F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)

    rated = rate(column(text, "string"), column(length, "double"), column(lang, "string"), column(source, "string"))
    return docs.withColumn("quality_score", rated).withColumn("kept", F.col("quality_score") >= threshold)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Trains on ``labels`` and scores all of ``docs``."""
    return score(docs, train(docs, labels, **options))
