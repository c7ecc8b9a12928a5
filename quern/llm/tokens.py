"""Whole-text encoding with a public byte-level tokenizer, through a cache of words.

Byte-level BPE never merges across its pre-tokens, and a single space between two non-space characters always
begins a pre-token. A text may thus be cut before every such space, and each piece encoded on its own; pieces
repeat, so a bounded cache answers most of them. The ids equal those of encoding the text as one string.

``Encoder.encode_all`` takes many texts at once: their bytes are cut at every boundary of pre-tokens that two or three
neighbouring characters show, equal pieces are found by Arrow, and the cache is asked once for each different one.
"""

from __future__ import annotations

import codecs
import ctypes
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property
from itertools import islice
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries an encoder's caches hold before they start anew: a bound on a worker's memory, some 200 bytes each.
CACHE_ENTRIES = 1_200_000
#: The same for an encoder that is lent to one task at a time, and how many of the first words it keeps between tasks.
LENT_ENTRIES, KEPT_ENTRIES = 500_000, 50_000
#: New words that the model is given in one string.
TOGETHER = 64
#: Longer units are encoded but not remembered.
LONGEST_KEY = 64
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters (those of Latin-1), then marks other than the apostrophe are two pre-tokens.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_alphabet() -> str:
    """Byte-level BPE writes bytes that are no printable Latin-1 characters as code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


#: Kinds of bytes: letters (ASCII, Latin-1), digits, marks, the apostrophe, space, other ASCII white space, bytes of
#: further characters that are no white space, and bytes of which nothing is said.
_LETTER, _DIGIT, _MARK, _APOSTROPHE, _SPACE, _BREAK, _HIGH, _OTHER = range(8)
_INKED, _BLANK = (_LETTER, _DIGIT, _MARK, _APOSTROPHE, _HIGH), (_SPACE, _BREAK)


def _kind(byte: int) -> int:
    if byte >= 128:
        return _HIGH
    char = chr(byte)
    if char.isalnum():
        return _LETTER if char.isalpha() else _DIGIT
    return _MARK if char in _MARKS else {"'": _APOSTROPHE, " ": _SPACE}.get(char, _BREAK if char in "\t\n\v\f\r" else _OTHER)


#: What two neighbours show: a boundary between them, two blanks, or a break before ink.
_CUT, _BLANKS, _BROKEN = 1, 2, 3


def _shown(a: int, b: int) -> int:
    if a in _INKED and b in _BLANK:
        return _CUT
    if a in _BLANK:
        return _BLANKS if b in _BLANK else _BROKEN if a == _BREAK and b in _INKED else 0
    words = (_LETTER, _DIGIT)
    split = a in words and b in (*words, _MARK, _APOSTROPHE) and a != b or a == _MARK and b in words
    return _CUT if split else 0


_KINDS = bytes(map(_kind, range(256)))
_PAIRS = bytes(_shown(pair >> 3, pair & 7) if pair < 64 else 0 for pair in range(256))
#: First bytes of the white space beyond ASCII, which has two or three bytes.
_WIDE_SPACE = {0xC2: "\x85\xa0", 0xE1: "\u1680", 0xE2: "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f", 0xE3: "\u3000"}
_WIDE_LEADS = bytes(b in _WIDE_SPACE for b in range(256))
_WIDE_CODES = np.array([int.from_bytes(c.encode().ljust(3, b"\0"), "big") for chars in _WIDE_SPACE.values() for c in chars])


def piece_starts(data: np.ndarray, starts: np.ndarray, uncut: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, which stand end to end in ``data`` (UTF-8) from ``starts`` (ascending, none empty).

    Every piece begins where a pre-token of its text does, and encoded on its own has the same pre-tokens: no pre-token
    goes from ink to blank, from a letter or digit to another kind, or from a mark but the apostrophe to a letter or digit.
    Of several blanks before ink the last is apart, and a break (a blank but the space) never joins what follows.
    ``uncut`` tells of each text whether it stays in one piece.
    """
    raw, n = data.tobytes(), len(data)
    kinds = np.frombuffer(bytearray(raw.translate(_KINDS)), np.uint8)
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kinds[at] = kinds[at + 1] = _LETTER
    at = np.flatnonzero(np.frombuffer(raw.translate(_WIDE_LEADS), np.uint8))
    if len(at):
        size = np.where(data[at] == 0xC2, 2, 3)
        code = sum(np.where(k < size, data.take(at + k, mode="clip").astype(np.int64), 0) << 8 * (2 - k) for k in range(3))
        wide = np.isin(code, _WIDE_CODES)
        for k in range(3):
            kinds[(at + k)[wide & (k < size)]] = _OTHER
    shown = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(_PAIRS), np.uint8)
    begins = np.zeros(n + 1, bool)
    begins[starts] = begins[n] = True
    cut = np.zeros(n, bool)
    cut[1:] = shown == _CUT
    last = np.flatnonzero(shown == _BLANKS) + 1  # of two blanks
    last = last[(last < n - 1) & ~begins[last + 1]]
    cut[last[np.isin(kinds[last + 1], _INKED)]] = True
    broken = np.flatnonzero(shown == _BROKEN)
    cut[broken[begins[broken] | (kinds[broken - 1] != _OTHER)] + 1] = True
    for k in np.flatnonzero(uncut):
        cut[starts[k] : starts[k + 1] if k + 1 < len(starts) else n] = False
    cut[starts] = True
    return np.flatnonzero(cut)


class _Crowded(Exception):
    """White space stands beside a space, so cutting at every space would be wrong."""


class _Cache(dict):
    """Ids of a lead (a space, or nothing) and the key, encoded when first asked for.

    Looking up is a plain dictionary access in C; only a miss runs Python.
    """

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead, self.tokenize = encoder, lead, encoder.model.tokenize
        self.shown = encoder.alphabet[32] if lead else ""

    def __missing__(self, unit: str) -> bytes:
        if unit.isascii() and unit.isalpha():
            ids = array("I", [t.id for t in self.tokenize(self.shown + unit)]).tobytes()
        else:
            ids = self._mixed(unit)
        if len(unit) <= LONGEST_KEY:
            if self.encoder.held() >= self.encoder.entries:
                self.encoder.forget()
            self[unit] = ids
        return ids

    def _mixed(self, unit: str) -> bytes:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise _Crowded
        word = unit.rstrip(_MARKS)
        if word.isalpha() and (word.isascii() or _LETTERS.fullmatch(word)):
            return self[word] + self.encoder.plain[unit[len(word) :]] if word != unit else self.encoder.letters(self.lead + unit)
        lines = unit.split("\n")
        if len(lines) > 1 and all(lines) and not any(c.isspace() for line in lines for c in line):
            # A lone line feed between other characters is a pre-token, and the next line starts another.
            return self[lines[0]] + b"".join([self.encoder.feed + self.encoder.plain[line] for line in lines[1:]])
        return self.encoder.whole(self.lead + unit)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The word cache stands before the model, whose own cache would only cost time.
        getattr(self.model, "_resize_cache", lambda size: None)(0)
        self.alphabet = _byte_alphabet()
        self.feed = self.whole("\n")
        self.entries = entries
        self.added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.spaced, self.plain, self.pieces = _Cache(self, " "), _Cache(self, ""), {}

    @cached_property
    def leads(self) -> np.ndarray | None:
        """Which ids begin with a space. None if some token goes from letters on into the space before the next word.

        If none does, words with a space before them have the same ids in one string as each alone.
        """
        vocabulary, blank = self.tokenizer.get_vocab(with_added_tokens=False), self.alphabet[32]
        letters = {blank, *self.alphabet[0x80:0xC0], self.alphabet[0xC3], *ascii_letters}
        if any(blank in token.lstrip(blank) and letters.issuperset(token) for token in vocabulary):
            return None
        leads = np.zeros(max(vocabulary.values()) + 1, bool)
        leads[[i for token, i in vocabulary.items() if token.startswith(blank)]] = True
        return leads

    def held(self) -> int:
        return len(self.spaced) + len(self.plain) + len(self.pieces)

    def forget(self, keep: int = 0) -> None:
        """Empties the caches but for the first ``keep`` words of either; frequent words come early."""
        for cache in (self.spaced, self.plain, self.pieces):
            first = dict(islice(cache.items(), keep))
            cache.clear()
            cache.update(first)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, word: str) -> bytes:
        """Letters, or a space and letters, are one pre-token, which the model takes in the byte alphabet."""
        shown, _ = codecs.charmap_decode(word.encode(), "strict", self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of different pieces: remembered, or encoded and remembered."""
        found = list(map(self.pieces.get, pieces))
        missing = [k for k, ids in enumerate(found) if ids is None]
        spaced = [k for k in missing if pieces[k][0] == " " and _LETTERS.fullmatch(pieces[k], 1)] if self.leads is not None else []
        for at in range(0, len(spaced), TOGETHER):
            some = spaced[at : at + TOGETHER]
            raw = self.letters("".join([pieces[k] for k in some]))
            starts = (4 * np.flatnonzero(self.leads[np.frombuffer(raw, "<u4")])).tolist()
            for k, start, end in zip(some, starts, [*starts[1:], len(raw)], strict=True):
                found[k] = raw[start:end]
        for k in missing:
            if found[k] is None:
                word = pieces[k].removeprefix(" ")
                found[k] = self.letters(pieces[k]) if _LETTERS.fullmatch(word) else self.whole(pieces[k])
        if self.held() + len(missing) > self.entries:
            self.forget()
        self.pieces.update([(pieces[k], found[k]) for k in missing if len(pieces[k]) <= LONGEST_KEY][: self.entries])
        return found

    def _added_in(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(from, to) of every added token; the tokenizer takes them out first, and what is between them is a text each.

        Of a text with an added token that asks for more than its characters: (from, to) of the text.
        """
        spans, contents = [], sorted({t.content for t in self.added}, key=len, reverse=True)
        odd = any(t.single_word or t.lstrip or t.rstrip for t in self.added)
        holds = np.zeros(len(texts), bool)
        for content in contents:
            holds |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(holds):
            low, high = offsets[k : k + 2].tolist()
            found = re.finditer("|".join(map(re.escape, contents)).encode(), data[low:high].tobytes())
            spans += [(low, high)] if odd else [(low + m.start(), low + m.end()) for m in found]
        return np.array(spans, np.int64).reshape(-1, 2)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings, none null), end to end, and where each text's end."""
        if not pc.any(pc.greater(pc.binary_length(texts), 0)).as_py():
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        _, held, data = texts.buffers()
        offsets = np.frombuffer(held, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data, offsets = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]
        apart = self._added_in(texts, data, offsets)
        edges = np.unique(np.concatenate([offsets[:-1], apart.ravel()]))
        edges = edges[edges < len(data)]
        starts = piece_starts(data, edges, np.isin(edges, apart[:, 0]))
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        coded = pa.StringArray.from_buffers(len(starts), bounds, pa.py_buffer(data)).dictionary_encode()
        found = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes, flat = np.fromiter(map(len, found), np.int64, len(found)) >> 2, np.frombuffer(b"".join(found), "<u4")
        first, codes = sizes.cumsum() - sizes, coded.indices.to_numpy()
        counts = sizes[codes]
        through = np.concatenate([[0], counts.cumsum()])
        ids = flat[np.arange(through[-1]) + np.repeat(first[codes] - through[:-1], counts)]
        return ids, through[np.searchsorted(starts, offsets[1:])]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        units = text.split(" ")
        try:
            if units[0] and units[0][-1].isspace():
                raise _Crowded
            return (self.whole(units[0]) if units[0] else b"") + b"".join(map(self.spaced.__getitem__, units[1:]))
        except _Crowded:
            first, *rest = _SAFE_CUT.split(text)
            return self.whole(first) + b"".join(self._piece(unit) for unit in rest)

    def _piece(self, unit: str) -> bytes:
        """A unit after a safe cut; white space within or at the end of it is encoded in place."""
        return self.whole(" " + unit) if any(c.isspace() for c in unit) else self.spaced[unit]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, entries: int = CACHE_ENTRIES) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    if (path, entries) not in _ENCODERS:
        _ENCODERS[path, entries] = Encoder(path, entries)
    return _ENCODERS[path, entries]


@contextmanager
def lent(path: str) -> Iterator[Encoder]:
    """The worker's encoder for one task. Most of its words go after it, and their memory: workers serve later stages too."""
    found = encoder(path, LENT_ENTRIES)
    try:
        yield found
    finally:
        found.forget(KEPT_ENTRIES)
        pa.default_memory_pool().release_unused()
        getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: None)(0)
