"""Exact token ids of public tokenizers, with work done once per distinct pre-token.

Byte-pair tokenizers never merge across pre-tokens, so a text's ids are its
pre-tokens' ids in a row. ``PieceEncoder`` finds pre-tokens with one regular
expression and remembers their ids; the tokenizers library makes the ids of
each pre-token that is new, for some hundred KB of texts at a time: the library's
tables and the remembered ids would else drive each other out of the processor's
caches at every new pre-token. Texts for which the expression might read Unicode in
another way than the library does are cut by the library's own pre-tokenizer;
only texts with special strings are encoded by it whole.
"""

from __future__ import annotations

import json
import re
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from presswork.llm.common import byte_slices

#: Letters and marks up to Latin Extended-B, general punctuation without odd spaces, currency signs:
#: for these the pre-token expressions below and the library agree, and NFC changes nothing.
_PLAIN_RANGES = "\t-\r\x20-\x7e¡-¬®-įĲ-ɏ‐-‧‰-⁞₠-₿"
_PLAIN = re.compile(f"[^{_PLAIN_RANGES}]")


def _plain_class(name: str) -> str:
    """The plain characters, and their lower-case forms, that are in a Unicode class, as the inside of a set for ``re``."""
    plain = "".join(re.findall(f"[{_PLAIN_RANGES}]", "".join(map(chr, range(0x20C0)))))
    return "".join(sorted(set(regex.findall(rf"\p{{{name}}}", plain + plain.lower()))))


def plain_pattern(pattern: str) -> re.Pattern:
    """A pre-token pattern for plain texts: its classes spelled out, and runs of letters tried first, which no
    other alternative can begin with, as nearly every pre-token is one."""
    letters, numbers = _plain_class("L"), _plain_class("N")
    pattern = pattern.replace(r"\s", r" \t-\r ").replace(r"[^ \t-\r \p{L}\p{N}]", rf"[^ \t-\r {letters}{numbers}]")
    pattern = pattern.replace(r"[\p{L}]", rf"[{letters}]").replace(r"[\p{N}]", rf"[{numbers}]").replace(r"\p{L}", rf"[{letters}]").replace(r"\p{N}", rf"[{numbers}]")
    pattern = pattern.replace(r" \t-\r +", r"[ \t-\r ]+")
    words = [p for p in pattern.split("|") if letters in p and "^" not in p]
    return re.compile("|".join([*words, *[p for p in pattern.split("|") if p not in words]]))


#: The pattern of a vocabulary whose pre-tokens hold no white space.
_WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def word_finder() -> Callable[[str], list[str]]:
    """Pre-tokens of plain texts by ``_WORD_LEVEL``: its matches that begin with no letter are set off by spaces, and the text is cut at white space.

    The expression begins with a single set, so that it passes over letters quickly.
    """
    letters, numbers = _plain_class("L"), _plain_class("N")
    odd = re.compile(rf"[^ \t-\r{letters}](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<![{numbers}])[^ \t-\r{letters}{numbers}]+|)")
    return lambda text: odd.sub(r" \g<0> ", text).split()


#: The pre-token patterns of the two public vocabularies, as their files state them.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_CHARS = {b: chr(256 + n) for n, b in enumerate(_HIDDEN)}
_CHAR_BYTES = {256 + n: chr(b) for n, b in enumerate(_HIDDEN)}
_WRITTEN = "".join(_BYTE_CHARS.get(b, chr(b)) for b in range(256))


class _Known(dict):
    """Pre-token to the bytes of its ids. A new one has an empty place, which ``fill`` fills.

    When there are more than ``most``, ``turn`` lays them aside: those that are asked for again come back, the others go at the next turn.
    """

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most, self.before, self.places = make, most, {}, {}

    def __missing__(self, piece: str) -> bytes | bytearray:
        raw = self.before.pop(piece, None)
        if raw is None:
            raw = self.places[piece] = bytearray()
        self[piece] = raw
        return raw

    def fill(self) -> None:
        places, self.places = self.places, {}
        try:
            for piece, place in places.items():
                raw = self[piece] = self.make(piece)
                place += raw
        except BaseException:  # no empty place stays behind for the process's next task
            for piece in places:
                self.pop(piece, None)
            raise

    def turn(self) -> None:
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()


class PieceEncoder:
    """Ids of texts as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, cache: int = 300_000) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        kinds = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"]:
            self.lower, pattern = True, steps[0]["pattern"]["Regex"]
        elif not kinds and [s["type"] for s in steps] == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]:
            self.lower, pattern = False, _BYTE_LEVEL
        else:
            self.lower, pattern = None, "(?!)"  # unknown: the library makes all
        self.find = word_finder() if self.lower and pattern == _WORD_LEVEL else plain_pattern(pattern).findall
        self._tokenize = self.library.model.tokenize
        self._raw = [n.to_bytes(4, "little") for n in range(max(self.library.get_vocab().values(), default=-1) + 1)]
        self.known = _Known(self._piece, cache)

    def pieces(self, text: str) -> list[str] | None:
        """The text's pre-tokens; None where they don't make its ids: for special strings and unknown kinds of vocabularies."""
        if self.lower is None or self.special.search(text):
            return None
        if not _PLAIN.search(text):
            return self.find(text.lower() if self.lower else text)
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [p.translate(_CHAR_BYTES).encode("latin-1").decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _library_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _new(self, piece: str) -> list:
        """The library's tokens of one pre-token."""
        return self._tokenize(charmap_decode(piece.encode(), "strict", _WRITTEN)[0])

    def _piece(self, piece: str) -> bytes:
        return b"".join([self._raw[t.id] for t in self._new(piece)])

    def piece_ids(self, piece: str) -> list[int]:
        """The library's ids of one pre-token."""
        return [t.id for t in self._new(piece)]

    def count_ids(self, text: str) -> int:
        """The number of ids of a text that has no pre-tokens here."""
        return len(self._library_ids(text))

    def ids(self, text: str) -> np.ndarray:
        return next(self.ids_of([text]))

    def ids_of(self, texts: list[str], slice_chars: int = 250_000) -> Iterator[np.ndarray]:
        """The ids of each text. The new pre-tokens of texts of ``slice_chars`` together (one text at least) are made at once."""
        known = self.known.__getitem__
        for first, last in byte_slices([len(t) for t in texts], slice_chars):
            self.known.turn()
            cut = [None if pieces is None else list(map(known, pieces)) for pieces in map(self.pieces, texts[first:last])]
            self.known.fill()
            for text, raw in zip(texts[first:last], cut):
                yield self._library_ids(text) if raw is None else np.frombuffer(b"".join(raw), dtype="<u4")


@lru_cache(maxsize=2)
def encoder(name: str) -> PieceEncoder:
    """The process's encoder for a file of ``public_tokenizers``, or for a path."""
    return PieceEncoder(name if "/" in name else public_tokenizers.path(name))
