"""Byte-level and word-level BPE ids of whole texts, with the public tokenizers library.

Both pre-tokenizers cut a text at white space without looking further back, so the ids of
a text are those of its units (a run of other characters with the space before it, or a
white-space run) one after another. Arrow tells the distinct units of some megabytes of text,
only those are looked up, and their ids are put back in place by numpy. Words repeat, so each
worker process keeps the ids of up to ``CACHE`` units from task to task; when half are new, the
older half goes. Texts that hold a special token go to the library whole.

Python workers read the vocabulary file from ``path``, which every node must have.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 1_400_000
#: Bytes of text that are encoded at once, about; a longer text is taken alone.
AT_ONCE = 8 << 20
#: Unicode's White_Space, which is what the tokenizers' patterns mean by white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that never join a letter's run, the apostrophe left out.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of lower-case Latin letters that no normaliser changes, and words of Latin letters after a space.
_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_SPACED = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_UNITS = {
    "byte": re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"),
    "word": re.compile(f"[^{WHITE}]+"),
}


def vocabulary(name: str) -> str:
    """The default place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet's letters for bytes that don't stand for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(maxsize=4)
def bytes_of_ids(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    as_byte = {letter: b for b, letter in _byte_letters().items()}
    tok = tokenizer(path)
    special = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
    table = [b""] * tok.get_vocab_size()
    for token, i in tok.get_vocab().items():
        table[i] = special[i].encode() if i in special else bytes(as_byte.get(c, ord(c)) for c in token)
    return table


def slices(batch: pa.RecordBatch, column: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes in a column of texts, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


class Encoder:
    """Ids of texts as int32 arrays. kind: "byte" or "word"."""

    def __init__(self, path: str, kind: str, cache: int | None = None):
        self.cache = cache or CACHE
        self.tok, self.path, self.units, self.known = tokenizer(path), path, _UNITS[kind], {}
        self.older: dict[str, bytes] = {}
        self.lower = kind == "word"
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or r"(?!)")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, new: set[str]) -> None:
        """Ids of new units; a tail of marks after a letter is a token run of its own, and known from other words."""
        ends = {}
        for unit in new:
            base = unit.rstrip(_MARKS)
            if base and len(base) < len(unit) and base[-1].isascii() and base[-1].isalpha():
                ends[unit] = base
        known = self.known
        rest = []
        word, model, letters = (_WORD if self.lower else _SPACED).fullmatch, self.tok.model.tokenize, _byte_letters()
        for unit in (new - ends.keys()) | ({*ends.values(), *(u[len(b) :] for u, b in ends.items())} - known.keys()):
            if word(unit):  # one word of letters: no cutting and no normalising before the model
                spelt = unit if self.lower and unit.isascii() else unit.encode().decode("latin-1").translate(letters)
                known[unit] = array("i", [t.id for t in model(spelt)]).tobytes()
            else:
                rest.append(unit)
        for unit, got in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[unit] = array("i", got.ids).tobytes()
        for unit, base in ends.items():
            known[unit] = known[base] + known[unit[len(base) :]]

    def _ids(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units, learned where they are new."""
        got = list(map(self.known.get, units))
        new = {u for u, ids in zip(units, got, strict=True) if ids is None}
        if not new:
            return got
        if len(self.known) + len(new) > self.cache // 2:
            self.older, self.known, new = self.known, {}, set(units)
        again = new & self.older.keys()
        self.known.update((u, self.older[u]) for u in again)
        self._learn(new - again)
        return list(map(self.known.__getitem__, units))

    def _split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts one after another, and where each text's begin."""
        if self.lower:  # the library cuts units at other white space by itself
            parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
            return parts.values, parts.offsets.to_numpy()
        units = [self.units.findall(t) for t in texts]
        return pa.array([u for own in units for u in own], pa.large_string()), np.cumsum([0, *map(len, units)])

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if self.lower:  # the library lower-cases anyway, and so more units are alike
            low = [t.lower() if t.isascii() else t.encode().lower().decode() for t in texts]
        else:
            low = texts
        odd = [bool(self.special.search(t)) for t in low]
        units, begins = self._split(["" if o else t for t, o in zip(low, odd, strict=True)])
        coded = units.dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        index, width = coded.indices.to_numpy(), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, flat = np.cumsum(width) - width, np.frombuffer(b"".join(ids), np.int32)
        n = width[index]  # tokens of each unit
        ends = np.append(0, np.cumsum(n))
        out = flat[np.repeat(first[index] - ends[:-1], n) + np.arange(ends[-1])]
        cut = ends[begins].tolist()
        return [self.whole(t) if o else out[a:b] for t, o, a, b in zip(texts, odd, cut, cut[1:], strict=False)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False) of a byte-level vocabulary."""
        table = bytes_of_ids(self.path)
        try:
            return b"".join([table[i] for i in ids.tolist()]).decode()
        except UnicodeDecodeError:
            return self.tok.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path: str, kind: str, cache: int | None = None) -> Encoder:
    """The worker process's encoder: what it has learned in one task is known in the next."""
    return Encoder(path, kind, cache)
