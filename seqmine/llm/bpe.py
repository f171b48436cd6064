"""BPE encoding and decoding; long texts are encoded in parallel parts and joined in a tree.

A text longer than ``leaf`` characters is cut into parts of that length anywhere between two characters.  The
parts are spread over the cluster and encoded alone, then neighbours are joined pairwise, as a tree.  At each
join only a window around it is encoded again.  The window starts and ends at token borders of both sides and
grows until its first token is the left side's and its last token the right side's, and until both of its ends
are places where the text around cannot change the outcome:

* the end of the whole text,
* a place before a space or line feed that follows a visible character (always a border between pre-tokens), or
* a place inside a run of one pre-token, at least ``GUARD`` characters away from the run's ends.

A sequence of BPE tokens is the right one when each pair of neighbours is the right encoding of its own text;
pairs left and right of the window's first and last token are taken over, pairs inside come from the library,
so agreement in one token on each side makes the joined sequence exact.  A window that grows to both ends
is an encoding of the whole text, so the loop always ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmine.llm.tokens import Encoder, default_tokenizer, encoder, text_batches

LEAF_CHARS = 1 << 15
GUARD = 4
FIRST_WINDOW = 8


def _loose(text: str, at: int) -> bool:
    """True if the pre-tokens of ``text`` have a border at ``at`` whatever stands farther away."""
    return at in (0, len(text)) or (text[at] in " \n" and text[at - 1].isascii() and text[at - 1].isalnum())


def _inside(enc: Encoder, text: str, at: int) -> bool:
    """True if ``at`` lies deep inside one pre-token that does not start or end nearby."""
    around = text[max(0, at - GUARD):at + GUARD]
    if len(around) < 2 * GUARD or "'" in around or "<" in around or ">" in around or "|" in around:
        return False
    if not (around.isalpha() or around.isdigit()):
        return False
    return len(enc.library.pre_tokenizer.pre_tokenize_str(around)) == 1


def join(enc: Encoder, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
    """Text and ids of two neighbouring parts together, exactly as the library encodes the whole."""
    (lt, li), (rt, ri) = left, right
    text = lt + rt
    if not lt or not rt:
        return text, li if not rt else ri
    k = FIRST_WINDOW
    while True:
        a, b = max(0, len(li) - k), min(len(ri), k)
        head = b"".join(enc.token_bytes[i] for i in li[a:])
        tail = b"".join(enc.token_bytes[i] for i in ri[:b])
        whole = a == 0 and b == len(ri)
        # A window may not start or end inside a character.
        clean = (not head or head[0] & 0xC0 != 0x80) and (b == len(ri) or _starts_character(enc, ri[b]))
        if whole:
            return text, _ids(enc, text)
        if clean:
            start, end = len(lt) - len(head.decode()), len(lt) + len(tail.decode())
            safe = all(_loose(text, p) or _inside(enc, text, p) for p in (start, end))
            if safe:
                mid = _ids(enc, text[start:end])
                first = a == 0 or _loose(text, start) or (len(mid) and mid[0] == li[a])
                last = b == len(ri) or _loose(text, end) or (len(mid) and mid[-1] == ri[b - 1])
                if first and last:
                    return text, np.concatenate([li[:a], mid, ri[b:]])
        k *= 2


def _starts_character(enc: Encoder, token: int) -> bool:
    return enc.token_bytes[token][0] & 0xC0 != 0x80


def _ids(enc: Encoder, text: str) -> np.ndarray:
    return np.frombuffer(enc.whole([text])[0], dtype="<u4")


def join_all(enc: Encoder, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Ids of all parts, joined pairwise level by level."""
    while len(parts) > 1:
        parts = [join(enc, *parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0][1]


def _spread(df: DataFrame, n: int | None, *cols: str) -> DataFrame:
    return df.repartition(n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
           leaf: int = LEAF_CHARS, parallel: int | None = None) -> DataFrame:
    """One row per row of ``docs``: the key and ``ids``, the token ids as little-endian 32-bit integers.

    A null text is an empty one and gives no ids; a null key stays null; repeated rows come out repeatedly; other
    columns are not read.  Short texts never leave their task.  Parts of a long one are shuffled once to be
    encoded and once more to be joined, a document's parts in one task.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    out = f"k {kind}, ids binary"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column("k"), batch.column("t").to_pylist()
            for part in text_batches(texts):
                ids = pa.array(enc.encode(texts[part]), pa.binary())
                yield pa.RecordBatch.from_arrays([keys.slice(part.start, len(ids)), ids], ["k", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("k")
            for row, (h, t) in enumerate(zip(batch.column("h").to_pylist(), batch.column("t").to_pylist())):
                at = range(0, len(t), leaf)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array([row] * len(at))), pa.array([h] * len(at)), pa.array(range(len(at)), pa.int64()),
                     pa.array([t[a:a + leaf] for a in at])], ["k", "h", "part", "t"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = pa.array(enc.encode(batch.column("t").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], ["k", "h", "part", "t", "ids"])

    def tree(group: pa.Table) -> pa.Table:
        enc = encoder(path)
        parts, copies = {}, 0
        for part, t, ids in zip(*(group.column(c).to_pylist() for c in ("part", "t", "ids"))):
            copies += part == 0  # repeated rows bring each of their parts as often
            parts[part] = (t, np.frombuffer(ids, dtype="<u4"))
        ids = join_all(enc, [parts[k] for k in sorted(parts)])
        key = group.column("k").combine_chunks().take(pa.array([0] * copies))
        return pa.table({"k": key, "ids": pa.array([ids.astype("<u4").tobytes()] * copies, pa.binary())})

    long = F.length("t") > leaf
    brief = rows.where(~long).mapInArrow(short, out)
    parts = (rows.where(long).withColumn("h", F.sha2("t", 256)).mapInArrow(cut, f"k {kind}, h string, part long, t string"))
    joined = (_spread(parts, parallel, "k", "h", "part")
              .mapInArrow(leaves, f"k {kind}, h string, part long, t string, ids binary")
              .groupBy("k", "h").applyInArrow(tree, out))
    return brief.unionByName(joined).withColumnRenamed("k", key)


def decode(encoded: DataFrame, key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """``encoded`` with ``text``: its ``ids`` decoded as the library does, special tokens included.  Null ids give null."""
    path = tokenizer or default_tokenizer()
    schema = f"{key} {encoded.schema[key].dataType.simpleString()}, ids binary, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if i is None else enc.decode(np.frombuffer(i, "<u4").tolist()) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [key, "ids", "text"])

    return encoded.select(key, "ids").mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Of each row of ids: key, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256`` (of the decoded text).

    It decodes as ``decode`` does, in the same task that hashes, so texts do not travel.  Null ids give nulls.
    """
    path = tokenizer or default_tokenizer()
    schema = f"{key} {encoded.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        decimal = list(map(str, range(len(enc.token_bytes))))
        for batch in batches:
            found = []
            for raw in batch.column("ids").to_pylist():
                if raw is None:
                    found.append((None, None, None))
                    continue
                ids = np.frombuffer(raw, dtype="<u4").tolist()
                spelled = ",".join(map(decimal.__getitem__, ids))
                found.append((len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()))
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select(key, "ids").mapInArrow(run, schema)
