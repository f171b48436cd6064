"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Each document is reduced to the set of its word shingles, as 64-bit hashes.  One hash of a shingle gives both its bin (top
bits) and its value; an empty bin takes the value of the first non-empty one in a random order of bins of its own, the
same for all documents.  Groups of bins are bands, and documents that agree in a band share a bucket.

Documents with equal sets form classes first, each stands in buckets once.  A bucket of m classes gives m - 1 candidate edges,
from its centre to the others, never all pairs.  The centre is the member first in a random order, the same for all
buckets of a round, so members of one group meet the same centre in most of their buckets and are compared with it
once.  Candidates are confirmed on the full sets of shingles.  A second round takes only buckets whose members lie in more than
one component, with new centres, and tests a set against one centre of each foreign component.  A round's links are between components:
they are united among themselves, and members take over the new names.

Sets in buckets that are mixed even then are compared exactly: linked sets share one of their rarest shingles, and pairs that do, fit in size
and leave room for enough common shingles are confirmed like the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmine.llm.components import components
from seqmine.llm.storage import small_side, written

WORDS = 5
SIMILARITY = 80  # per cent
BINS = 128
#: Bins per band.  Sets with similarity s share a given band with chance s**4: of 32 bands, 0.8 meets in 13, and none with chance 5e-8.
ROWS = 4
#: Rounds of stars before the exact join takes what they left mixed.
ROUNDS = 2
#: Slots of shingle counts that order a set's shingles by rarity; slots that share counts cost time, not links.
SLOTS = 1 << 20
#: Bits of a set's map; two sets differ in at least as many shingles as their maps differ in bits.
MAP_BITS = 1024
#: Sets of a square block that meet in one rare shingle.
SQUARE = 512
WORD_TABLE = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers evenly (the finisher of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes; keeps a table of word hashes for its worker."""

    def __init__(self, words: int):
        self.words = words
        self._known: dict[bytes, int] = {}
        # Odd factors make a shingle's hash depend on the order of its words.
        self.factors = _mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self._known.get, words))
        if None in found:
            if len(self._known) > WORD_TABLE:
                self._known.clear()
            for k, h in enumerate(found):
                if h is None:
                    w = words[k]
                    h = self._known.get(w)
                    if h is None:
                        h = self._known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
                    found[k] = h
        return np.array(found, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Lower-cases A-Z and splits at ASCII white space, as bytes methods do; fewer words than a shingle's make one."""
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        h = self._hashes(words)
        n = min(len(h), self.words)
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out += h[k:len(h) - n + 1 + k] * self.factors[k]
        return np.unique(_mix(out + np.uint64(n)))


class Sketcher:
    """Band hashes of a sorted set of shingle hashes."""

    def __init__(self, bins: int, rows: int, seed: int):
        self.bins, self.rows, self.bands = bins, rows, bins // rows
        self.shift = np.uint64(64 - (bins - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.turn = np.argsort(rng.random((bins, bins)), axis=1).argsort(axis=1)  # place of each bin in each bin's order
        self.edges = (np.arange(bins, dtype=np.uint64) << self.shift)
        self.salts = _mix(np.arange(1, self.bands + 1, dtype=np.uint64) << np.uint64(32))
        self.factors = _mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def bands_of(self, found: np.ndarray) -> np.ndarray:
        at = np.searchsorted(found, self.edges)
        ends = np.append(at[1:], len(found))
        filled = np.flatnonzero(at < ends)
        values = np.empty(self.bins, np.uint64)
        values[filled] = found[at[filled]]
        empty = np.flatnonzero(at == ends)
        if len(empty):
            values[empty] = values[filled[self.turn[np.ix_(empty, filled)].argmin(axis=1)]]
        return _mix((_mix(values).reshape(self.bands, self.rows) * self.factors).sum(axis=1, dtype=np.uint64) + self.salts)


def sketches(docs: DataFrame, key: str, text: str, words: int, bins: int, rows: int, seed: int) -> DataFrame:
    """key ``k``, ``n_shingles``, ``digest`` of the set (null if empty), ``bands``."""
    schema = "k long, n_shingles long, digest binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketcher = Shingler(words), Sketcher(bins, rows, seed)
        for batch in batches:
            sizes, digests, bands = [], [], []
            for t in batch.column("t").to_pylist():
                found = shingler.shingles(t)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                if len(found):
                    bands.append(sketcher.bands_of(found).view(np.int64))
            lengths = np.where(np.array(sizes, dtype=np.int64) > 0, sketcher.bands, 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(offsets, flat)], ["k", "n_shingles", "digest", "bands"])

    rows_ = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows_.mapInArrow(run, schema)


def _confirmed(edges: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Pairs of components (``x``, ``y``) of the candidate edges (``a``, ``b``) whose full sets are similar enough; ``texts`` has ``k``, ``t``."""
    pairs = (edges.join(texts, F.col("b") == F.col("k")).select("a", "b", "x", "y", F.col("t").alias("tb"))
             .join(texts, F.col("a") == F.col("k")).select("a", F.col("t").alias("ta"), "tb", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, centre = Shingler(words), None, None
        for batch in batches:
            ta, tb = (batch.column(c).to_pylist() for c in ("ta", "tb"))
            good = []
            for k in range(len(ta)):
                if ta[k] is not last:  # edges of one centre mostly follow each other
                    if ta[k] != last:
                        centre = shingler.shingles(ta[k])
                    last = ta[k]
                other = shingler.shingles(tb[k])
                both = np.concatenate([centre, other])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= similarity * (len(both) - common) and common > 0)
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "x long, y long").distinct()


def _rare_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many texts have a shingle of each slot (the shingle's low bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(words), np.zeros(SLOTS, np.int64)
        for batch in batches:
            # Slots of a batch are counted together: a text costs what its shingles cost, not the table of slots.
            found = [shingler.shingles(t) for t in batch.column("t").to_pylist()]
            if found:
                slots, n = np.unique((np.concatenate(found) & np.uint64(SLOTS - 1)).astype(np.int64), return_counts=True)
                counts[slots] += n
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    found = texts.select("t").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    counts = np.ones(SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def _bit_map(found: np.ndarray) -> np.ndarray:
    """The slots that a set's shingles fall into, as 64-bit words."""
    bits = np.zeros(MAP_BITS, np.uint8)
    bits[(_mix(found) % np.uint64(MAP_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _rare_pairs(texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Pairs of different components (``a``, ``b``, ``x``, ``y``) among ``texts`` (``k``, ``c``, ``t``), all that can be linked among them."""
    counts = _rare_counts(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for k, c, t in zip(batch.column("k").to_pylist(), batch.column("c").to_pylist(), batch.column("t").to_pylist()):
                found = shingler.shingles(t)
                often = counts[(found & np.uint64(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((found, often))[:len(found) - -(-similarity * len(found) // 100) + 1]
                place = np.flatnonzero(often[order] > 1)  # the others are in no second text
                if len(place):
                    n = len(place)
                    maps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (MAP_BITS // 64)), pa.array(np.tile(_bit_map(found), n)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[order[place]].view(np.int64)), pa.array(np.full(n, k, np.int64)), pa.array(np.full(n, c, np.int64)),
                         pa.array(np.full(n, len(found), np.int64)), pa.array(len(found) - place), maps], ["s", "k", "c", "n", "room", "map"])

    rare = written(texts.select("k", "c", "t").mapInArrow(run, "s long, k long, c long, n long, room long, map array<long>"), "rare")
    meet = rare.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
    parts = F.ceil(F.col("m") / SQUARE).cast("int")
    rare = written(rare.join(meet.select("s", parts.alias("parts")), "s").withColumn("i", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")), "meeting")
    rare = rare.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    one, two = (rare.select(*[F.col(c).alias(c + side) for c in rare.columns]) for side in "12")
    # A linked pair's first common shingle has room for all others behind it on both sides.
    fits = ((F.col("s1") == F.col("s2")) & (F.col("i1") == F.col("j2")) & (F.col("j1") == F.col("i2")) & (F.col("k1") < F.col("k2"))
            & (F.col("c1") != F.col("c2"))
            & (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * similarity)
            & (F.least("room1", "room2") * (100 + similarity) >= (F.col("n1") + F.col("n2")) * similarity)
            # Enough common shingles leave at most so many in one set alone, and so many bits in one map alone.
            & (F.expr("aggregate(zip_with(map1, map2, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)") * (100 + similarity)
               <= (F.col("n1") + F.col("n2")) * (100 - similarity)))
    pairs = one.join(two, fits)
    return (pairs.groupBy(F.col("k1").alias("a"), F.col("k2").alias("b"))
            .agg(F.min(F.least("c1", "c2")).alias("x"), F.min(F.greatest("c1", "c2")).alias("y")))


def _renamed(df: DataFrame, column: str, united: DataFrame) -> DataFrame:
    """``df`` with the components in ``column`` under their names in ``united`` (``node``, ``root``)."""
    names = united.select(F.col("node").alias("old_"), F.col("root").alias("new_"))
    return df.join(names, F.col(column) == F.col("old_"), "left").withColumn(column, F.coalesce("new_", column)).drop("old_", "new_")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    similarity: int = SIMILARITY, bins: int = BINS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if ``100 * common >= similarity * union`` of their distinct shingles.  ``component_id`` is the smallest key
    reachable by links, ``kept`` says that it is the row's own.  A null text or one without words has no shingles and links with nothing; fewer
    words than a shingle's make one shingle.  A row with a null key links with nothing, has a null component and is kept.  Rows that
    share a key are one document, linked if any of their texts is.  An empty table gives no rows; other columns are not read.
    """
    sketch = written(sketches(docs, key, text, words, bins, rows, seed), "sketches")
    usable = sketch.where("digest is not null and k is not null")
    reps = usable.groupBy("digest").agg(F.min("k").alias("rep"))
    classes = written(usable.join(reps, "digest").select("k", "rep", "n_shingles", F.xxhash64("digest").alias("d"),
                                                        F.when(F.col("k") == F.col("rep"), F.col("bands")).alias("bands")), "classes")
    banded = classes.where("bands is not null").select("k", "d", "n_shingles", F.explode("bands").alias("bucket")).distinct()
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    members = written(banded.join(shared, "bucket"), "buckets")

    inside = small_side(written(members.select("k").distinct(), "members"))
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    texts = written(texts.join(inside, "k", "left_semi"), "texts")

    # Copies that carry keys of their own, and keys that stand in several classes, are links as well.
    copies = classes.where("k != rep").select(F.col("rep").alias("a"), F.col("k").alias("b")).distinct()
    alone = inside.select(F.col("k").alias("node"), F.col("k").alias("root"))
    groups = written(components(copies).unionByName(alone).groupBy("node").agg(F.min("root").alias("root")), "components")
    members = members.join(groups, F.col("k") == F.col("node")).select("bucket", "k", "d", "n_shingles", F.col("root").alias("c"))
    tested = None
    for turn in range(ROUNDS):
        centre = F.min(F.struct(F.xxhash64("k", F.lit(turn)).alias("h"), F.col("k").alias("a"), F.col("n_shingles").alias("na"), F.col("c").alias("ca")))
        mixed = members.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), centre.alias("z")).where("lo != hi")
        # Buckets that lie in one component stay so and are left out from here on.
        live = written(members.join(mixed.select("bucket", "z"), "bucket"), "live")
        # Sets whose sizes differ too much cannot be similar enough.
        useful = (F.col("z.ca") != F.col("c")) & (
            F.least("z.na", "n_shingles") * 100 >= F.greatest("z.na", "n_shingles") * similarity)
        # A set meets a centre in many of its bands, and often several of one component: it is tested against the first of them.
        met = live.where(useful).groupBy("k", "d", "c", F.col("z.ca").alias("ca")).agg(F.min("z").alias("z"))
        edges = (met.select("k", "c", F.col("z.a").alias("a"), "ca")
                 .groupBy(F.least("a", "k").alias("a"), F.greatest("a", "k").alias("b"))
                 .agg(F.min(F.least("c", "ca")).alias("x"), F.min(F.greatest("c", "ca")).alias("y")))
        if tested is not None:
            edges = edges.join(tested, ["a", "b"], "left_anti")
        edges = written(edges, "candidates")
        links = written(_confirmed(edges, texts, words, similarity), "links")
        members, done = live.drop("z"), edges.select("a", "b")
        tested = done if tested is None else tested.unionByName(done)
        if not links.isEmpty():
            united = small_side(written(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "united"))
            groups = written(_renamed(groups, "root", united), "components")
            members = _renamed(members, "c", united)
    mixed = members.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
    live = written(members.join(mixed.select("bucket"), "bucket").select("k", "c").distinct(), "live")
    if not live.isEmpty():
        edges = written(_rare_pairs(texts.join(small_side(live), "k"), words, similarity).join(tested, ["a", "b"], "left_anti"), "candidates")
        links = written(_confirmed(edges, texts, words, similarity), "links")
        if not links.isEmpty():
            united = small_side(written(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "united"))
            groups = written(_renamed(groups, "root", united), "components")
    ids = sketch.select(F.col("k").alias(key), "n_shingles")
    out = ids.join(groups, (F.col(key) == F.col("node")), "left")
    component = F.coalesce(F.col("root"), F.col(key))
    return out.select(key, "n_shingles", component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"))
