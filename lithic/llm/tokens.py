"""Token ids from a tokenizer file, with a cache of pieces.

A byte-pair tokenizer cuts a text into pieces by a pattern and then merges inside
each piece, so the ids of a text are those of its pieces in a row. Words repeat:
looking pieces up is several times faster than encoding whole texts. The cutting
is done here only for texts whose characters all lie in a range where character
classes are the same in every Unicode version; any other text goes to the library whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import re
import unicodedata
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tab to carriage return, printable ASCII, Latin letters and common punctuation. U+0130 has a two-character lower case.
_RANGES = [(0x09, 0x0D), (0x20, 0x7E), (0xA0, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)]
def _members(kind: str) -> str:
    return "".join(re.escape(chr(c)) for a, b in _RANGES for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == kind)


_L, _N, _W = _members("L"), _members("N"), "\\t-\\r \xa0"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_PIECES = re.compile(rf"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

def _classes() -> np.ndarray:
    """For each code unit: w white space, n letter or digit, p stop or comma, o other, x out of range."""
    table = np.full(1 << 16, ord("x"), np.uint8)
    for c in chain.from_iterable(range(a, b + 1) for a, b in _RANGES):
        kind = unicodedata.category(chr(c))[0]
        table[c] = ord("w" if chr(c).isspace() else "n" if kind in "LN" else "p" if chr(c) in ".," else "o")
    return table


_CLASS = _classes()
_LATIN_CLASS = _CLASS[:256].tobytes()


def _class_of(text: str) -> bytes:
    """The class of every character, by table; of characters beyond 16 bits, two x."""
    try:
        return text.encode("latin-1").translate(_LATIN_CLASS)
    except UnicodeEncodeError:
        return _CLASS[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)].tobytes()


def _byte_units(text: str, kinds: bytes) -> str:
    """Parts that begin at piece boundaries, between zero characters: before each space, stop and
    comma and around each line end, unless white space meets white space there or a stop or comma
    follows anything but a letter or digit, which one piece could hold; then piece by piece."""
    if kinds[:1] == b"p" or any(x in kinds for x in (b"ww", b"wp", b"op", b"pp")):
        return "\0".join(_BYTE_PIECES.findall(text))
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(".", "\0.").replace(",", "\0,")


def _word_units(text: str, kinds: bytes) -> str:
    """This kind drops white space, and no piece spans it. Stops and commas part from a letter or
    digit before them, unless some follow a sign that could stand in one piece with them."""
    text = text.lower()
    if b"op" not in kinds and b"pp" not in kinds:
        text = text.replace(".", "\0.").replace(",", "\0,")
    for white in " \n\t\r\xa0":
        text = text.replace(white, "\0")
    return text


#: Pieces kept, about 200 bytes each; beyond it the cache starts anew, so memory is bounded.
CACHE_PIECES = 1_500_000


class Encoder:
    """ids(texts) -> one uint32 array per text. Strings of special tokens are ordinary text."""

    def __init__(self, path: str, cache_pieces: int | None = None):
        from tokenizers import Tokenizer

        self.cache_pieces = cache_pieces
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.units = self._rule(json.loads(self.library.to_str()))
        self._forget()
        if not self.units:
            return
        # Units that cannot stand beside the separator are encoded alone.
        self.gap, self.odd = ("\n", re.compile(r"(?!^ )\s|^ $")) if self.units is _byte_units else (" ~ ", re.compile(r"~|\s"))
        one = self._whole([self.gap])[0]
        if len(one) != 1:
            raise ValueError("the separator is not one id of this tokenizer")
        self.gap_id = one[0]

    def _forget(self) -> None:
        # The empty unit, which has no ids, is known from the start.
        self.number: dict[str, int] = {"": 0}
        self.flat, self.first, self.count = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    @staticmethod
    def _rule(spec: dict):
        """How to part a text, for files built like the two known kinds; None for others."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return _byte_units
        steps = pre.get("pretokenizers") or [{}]
        if [x.get("type") for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _WORD_SPLIT} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
            return _word_units
        return None

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        new, odd = [], []
        for u in units:
            (odd if self.odd.search(u) else new).append(u)
        for u in odd:
            self._store([u])
        for i in range(0, len(new), 4000):
            self._store(new[i : i + 4000])

    def _store(self, units: list[str]) -> None:
        """Encode many units as one text, which costs the library far less than one call for
        each, and part its ids at the separator's: a piece of its own that is in no unit."""
        ids = np.array(self._whole([self.gap.join(units)])[0], np.uint32)
        if len(units) > 1:
            gaps = np.flatnonzero(ids == self.gap_id)
            if len(gaps) != len(units) - 1:
                raise AssertionError("a unit holds the separator")
            count = np.diff(np.concatenate([[-1], gaps, [len(ids)]])) - 1
            ids = np.delete(ids, gaps)
        else:
            count = np.array([len(ids)])
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units))))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, ids])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """In groups of about four million characters, which bounds what is held besides the result."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > 1 << 22:
                out += self._group(group)
                group, size = [], 0
        out += self._group(group)
        trim()
        return out

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > (self.cache_pieces or CACHE_PIECES):
            self._forget()
        cut = [self._cut(t) for t in texts]
        lists = pc.split_pattern(pa.array([c for c in cut if c is not None], pa.large_string()), "\0")
        # Most units of a group repeat in it: each is looked up once.
        units = lists.flatten().dictionary_encode()
        known, index = units.dictionary.to_pylist(), units.indices.to_numpy()
        numbers = np.fromiter(map(self.number.get, known, repeat(-1)), np.int64, len(known))
        unknown = np.flatnonzero(numbers < 0).tolist()
        if unknown:
            self._learn([known[i] for i in unknown])
            numbers[unknown] = [self.number[known[i]] for i in unknown]
        count = self.count[numbers][index]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.first[numbers][index] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        # Where the units of each text end among the ids.
        bounds = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(lists).to_numpy())].tolist()
        out, at, k = [], 0, 0
        for c, t in zip(cut, texts):
            if c is None:
                out.append(np.array(self._whole([t])[0], dtype=np.uint32))
            else:
                out.append(ids[at : bounds[k]])
                at, k = bounds[k], k + 1
        return out

    def _cut(self, text: str) -> str | None:
        """The text's units between zero characters; None if it must be encoded whole."""
        kinds = _class_of(text) if self.units else b"x"
        return None if b"x" in kinds else self.units(text, kinds)


def trim() -> None:
    """Give free memory back to the system, which allocators keep otherwise; some milliseconds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, cache_pieces: int | None = None) -> Encoder:
    """One encoder for each file, size of cache and Python worker."""
    key = (path, cache_pieces)
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = Encoder(path, cache_pieces)
    return _encoders[key]


def release() -> None:
    """Drop this worker's encoders and give their memory back: workers are used again by other operators, which would keep them for nothing."""
    if _encoders:
        _encoders.clear()
        trim()
