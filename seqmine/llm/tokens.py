"""Exact, fast encoding with a byte-level BPE file of the ``tokenizers`` library.

A pre-token of this kind of tokenizer holds at most one leading space besides its visible characters, so a
place before a space or a line feed that follows a visible character is always a border between pre-tokens,
and both sides can be encoded alone.  Text is cut there into units (mostly words); units repeat, so each task
keeps a table of their ids and hands the library only the units that it has not met, many in one call.
Texts with other white space than single spaces and line feeds go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

#: Units in a worker's table; it is emptied when full, which costs time and changes no result.
TABLE_UNITS = 600_000


def default_tokenizer() -> str:
    """Path of the 50k byte-level BPE file of the installed vocabulary package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.token_bytes = self._bytes_of_tokens()
        self.widths = np.fromiter(map(len, self.token_bytes), dtype=np.int64, count=len(self.token_bytes))
        self._units: dict[str, bytes] = {}

    def _bytes_of_tokens(self) -> list[bytes]:
        """Byte-level vocabularies spell each byte as one printable character: the printable Latin-1 ones
        stand for themselves, the others follow from 256 on in their order."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in plain}
        spelled |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        vocab = self.library.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            out[i] = added[i].encode() if i in added else bytes(spelled[c] for c in token)
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, by the library alone, as little-endian 32-bit integers."""
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, units: list[str]) -> None:
        """Adds units, encoded as one text: they end at borders, so byte widths cut the ids apart again."""
        if len(self._units) + len(units) > TABLE_UNITS:
            self._units.clear()
        for at in range(0, len(units), 4096):
            part = units[at:at + 4096]
            spelled = [u if u[0] == "\n" else " " + u for u in part]
            ids = np.frombuffer(self.whole(["".join(spelled)])[0], dtype="<u4")
            ends = np.cumsum(np.fromiter((len(s.encode()) for s in spelled), np.int64, len(spelled)))
            cuts = 4 * (np.searchsorted(np.cumsum(self.widths[ids]), ends, side="left") + 1)
            raw, start = ids.tobytes(), 0
            for unit, cut in zip(part, cuts.tolist()):
                self._units[unit] = raw[start:cut]
                start = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        units, ends = [], []
        for text in texts:  # "\n" before the first word gives it a border; its one id is cut off again
            units += ("\n" + text).replace("\n", " \n").split(" ")[1:] if text and not text[0].isspace() else [""]
            ends.append(len(units))
        ids = list(map(self._units.get, units))
        missing = [k for k, found in enumerate(ids) if found is None]
        if missing:
            new = {units[k] for k in missing}
            self._learn([u for u in new if u and not u[-1].isspace()])
            for k in missing:
                ids[k] = self._units.get(units[k])
        out, left, start = [], [], 0
        for k, end in enumerate(ends):
            try:
                out.append(b"".join(ids[start:end])[4:])
            except TypeError:  # white space in a row
                out.append(b"")
                left.append(k)
            start = end
        for k, found in zip(left, self.whole([texts[k] for k in left])):
            out[k] = found
        return out

    def forget(self) -> None:
        """Empties the table of units."""
        self._units = {}

    def decode(self, ids: list[int]) -> str:
        """Text of ids as the library decodes them, special tokens included; ids outside the vocabulary give nothing."""
        try:
            raw = b"".join(map(self.token_bytes.__getitem__, ids))
        except IndexError:
            raw = b"".join(self.token_bytes[i] for i in ids if i < len(self.token_bytes))
        return raw.decode("utf-8", "replace")


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, so its table of units serves many tasks."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def text_batches(texts: list[str], chars: int = 1 << 20):
    """Slices of a list with about ``chars`` characters each, one text at least."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > chars:
            yield slice(start, k)
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))
