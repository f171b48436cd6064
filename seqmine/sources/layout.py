"""Record width and first offset of files, found by looking at their beginning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from seqmine.functions.bits import CODING_RESERVED, SYNC_HEX
from seqmine.sources.records import open_filesystem

# Record widths with and without sync, sub-header and sub-channel bytes.
WIDTH_DATA, WIDTH_NO_SYNC, WIDTH_FULL, WIDTH_SUB = 2048, 2336, 2352, 2448
# Distances at which a second valid audio record is looked for.
SPANS = (2, 4, 8, 16, 32)
REPEATS = 3
SEARCHED = 32
SYNC = np.frombuffer(bytes.fromhex(SYNC_HEX), np.uint8)
# Sub-header size, sound groups per record, bytes per group.
SUB_HEADER, GROUPS, GROUP_BYTES = 8, 18, 128
# Sub-mode bits that decide (form, audio, data, video, real-time) and their wanted state.
MODE_MASK, MODE_WANTED = 0x20 | 0x04 | 0x08 | 0x02 | 0x40, 0x20 | 0x04 | 0x40
EIGHT_BIT = 0x10

SCHEMA = "path string, size bigint, width int, offset int"
PREFIX = WIDTH_NO_SYNC * (2 * SEARCHED + 1)


def _sync_starts(head: np.ndarray) -> np.ndarray:
    if len(head) < len(SYNC):
        return np.zeros(0, bool)
    hit = np.ones(len(head) - len(SYNC) + 1, bool)
    for i, value in enumerate(SYNC):
        hit &= head[i:len(hit) + i] == value
    return hit


def _by_sync(hit: np.ndarray, size: int, width: int) -> int | None:
    for start in np.flatnonzero(hit[:max(0, min(size - width, 2 * width))]):
        others = start + width * np.arange(1, REPEATS + 1)
        if others[-1] + len(SYNC) <= size and others[-1] < len(hit) and hit[others].all():
            return int(start) % width
    return None


def _audio_starts(head: np.ndarray) -> np.ndarray:
    """For each multiple of 4, whether a fully consistent audio record starts there."""
    n = max(0, (len(head) - WIDTH_NO_SYNC) // 4 + 1)
    at = 4 * np.arange(n)
    if n == 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for i in range(4):
        ok &= head[at + i] == head[at + i + 4]
    ok &= (head[at + 2] & MODE_MASK) == MODE_WANTED
    ok &= (head[at + 3] & CODING_RESERVED) == 0
    for i in np.flatnonzero(ok):
        body = head[at[i] + SUB_HEADER:at[i] + SUB_HEADER + GROUPS * GROUP_BYTES]
        params = body.reshape(GROUPS, GROUP_BYTES)[:, :16].reshape(GROUPS, 4, 4)
        if head[at[i] + 3] & EIGHT_BIT:
            ok[i] = (params == params[:, :1]).all()
        else:
            ok[i] = (params[:, 0] == params[:, 1]).all() and (params[:, 2] == params[:, 3]).all()
    return ok


def probe(head: bytes, size: int) -> tuple[int, int]:
    """Width and first offset from the first ``PREFIX`` bytes of a file of ``size`` bytes."""
    data = np.frombuffer(head, np.uint8)
    hit = _sync_starts(data)
    for width in (WIDTH_SUB, WIDTH_FULL):
        offset = _by_sync(hit, size, width)
        if offset is not None:
            return width, offset
    audio = _audio_starts(data)
    for i in np.flatnonzero(audio[:SEARCHED * WIDTH_NO_SYNC // 4 + 1]):
        for span in SPANS:
            other = i + span * WIDTH_NO_SYNC // 4
            if other < len(audio) and audio[other]:
                return WIDTH_NO_SYNC, int(4 * i) % WIDTH_NO_SYNC
    return WIDTH_DATA, 0


def detect_layout(paths: DataFrame, path: str = "path") -> DataFrame:
    """Width and offset of every file named in ``path``; files are probed in parallel."""
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch[path]:
                system, inner = open_filesystem(name)
                with system.open_input_file(inner) as handle:
                    size = handle.size()
                    rows.append((name, size, *probe(handle.read_at(min(size, PREFIX), 0), size)))
            yield pd.DataFrame(rows, columns=["path", "size", "width", "offset"])

    return paths.select(path).mapInPandas(look, SCHEMA)
