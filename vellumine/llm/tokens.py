"""Token ids of whole texts by a public tokenizer, inside Spark tasks.

A pre-tokenizer that starts a new piece at white space gives a text the ids of its white-space chunks, one after
another. So a task encodes each distinct chunk once, by the library, and keeps what it found in a memo of bounded
size. A chunk of plain letters and closing punctuation consists of two pieces at most, which go to the library's model
one by one and are remembered too, so that a word with a new comma is no new word; any other chunk goes through the
whole tokenizer. Texts with characters on which the library and Python could differ about white space, or with a
marker that could be a special token, are encoded whole.

Where the pre-tokenizer is one of two known ones (one drops white space and lower-cases, the other is byte-level), texts of
Latin-1 letters are cut into its own pieces instead: a word is remembered once, not with each punctuation (and, in lower
case, not with each case) that it is met with.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import islice
from pathlib import Path

#: Texts with these are encoded whole: rare white space, separators, joiners, and what could start a special token.
UNUSUAL = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|<\|")

#: A chunk that keeps the white space in front of it, and one without.
SPACED, BARE = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+").findall, str.split

#: The pattern of the pre-tokenizer that drops white space, and the same for lower-case Latin-1 texts without UNUSUAL characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORDS = re.compile(rf"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^ \t\n\r{_L}{_N}]+").findall

#: The byte-level pre-tokenizer, and its pattern for Latin-1 texts without UNUSUAL characters, the most frequent kind first.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_CASED = f"A-Z{_L}\xc0-\xd6\xd8-\xde"
PARTS = re.compile(rf" ?[{_CASED}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^ \t\n\r{_CASED}{_N}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+").findall

#: What UNUSUAL finds in a Latin-1 text; a search for single characters is many times faster than the pattern.
UNUSUAL_LATIN = ("\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "<|")

#: The most chunks and pieces that are remembered, and the longest chunk. A full memo keeps its older half, where the
#: frequent ones are.
MEMO, PIECES, MEMO_CHARS = 600_000, 200_000, 48

#: Characters of text that are encoded at a time.
AT_ONCE = 1 << 20

#: A plain chunk: a space or a line's end, Latin letters, closing punctuation.
PLAIN = re.compile(r"([ \n]?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+)([.,;:!?#*$%&@|/+=_()<>{}\"-]*)").fullmatch

#: The letter for a space in byte-level models.
SPACE = chr(256 + 32)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level models: itself if visible, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTER = _byte_letters()


def _bytes_of(ids: list[int]) -> bytes:
    out = array("I", ids)
    return out.tobytes()


def _plain_latin(text: str) -> bool:
    """Whether all characters are Latin-1 and none is unusual."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not any(x in text for x in UNUSUAL_LATIN)


class Memo(dict):
    """Chunks and their ids; a chunk that is looked up for the first time is encoded, and kept unless it is long."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = ids
        return ids

    def shorten(self) -> None:
        """Drops the younger half of a memo that is over full."""
        if len(self) > MEMO:
            older = list(islice(self.items(), MEMO // 2))
            self.clear()
            self.update(older)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, keeps_space: bool):
        """keeps_space: white space is part of the tokens (byte-level), else it is dropped and words are in lower case."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keeps_space = keeps_space
        self.chunks = SPACED if keeps_space else BARE
        self.memo = Memo(self._chunk)
        self.words = Memo(self._word)
        self.cut = self._cut(json.loads(Path(path).read_text("utf-8")))
        self.pieces: dict[str, bytes] = {}
        self.newline = self._fresh(["\n"])[0]

    def _cut(self, told: dict):
        """What cuts a Latin-1 text into the pre-tokenizer's own pieces; None if it is not a known one."""
        if not self.keeps_space:
            return (lambda text: WORDS(text.lower())) if json.dumps(PATTERN) in json.dumps(told["pre_tokenizer"]) else None
        known = told["normalizer"] is None and {k: (told["pre_tokenizer"] or {}).get(k) for k in BYTE_LEVEL} == BYTE_LEVEL
        return PARTS if known else None

    def _fresh(self, texts: list[str]) -> list[bytes]:
        return [_bytes_of(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece of the pre-tokenizer: a word, with a space in front or without, or punctuation."""
        space = piece[0] == " "
        letters = SPACE * space + (piece[space:] if piece.isascii() else "".join(map(_LETTER.__getitem__, piece[space:].encode())))
        if len(self.pieces) >= PIECES:
            self.pieces = dict(islice(self.pieces.items(), PIECES // 2))
        found = self.pieces[piece] = _bytes_of([t.id for t in self.model.tokenize(letters)])
        return found

    def _word(self, word: str) -> bytes:
        """The ids of one piece of the pre-tokenizer, in lower case if that drops white space."""
        rest = word[1:] if word[0] == " " else word
        if rest.isascii() and rest.isprintable() and " " not in rest:
            letters = word if rest is word else SPACE + rest
        else:
            letters = "".join(map(_LETTER.__getitem__, word.encode()))
        return _bytes_of([t.id for t in self.model.tokenize(letters)])

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk: a plain one by its pieces, any other by the whole tokenizer."""
        match = PLAIN(chunk)
        if match is None:
            return self._fresh([chunk])[0]
        head, core, tail = match.groups()
        word = core.lower() if not self.keeps_space else " " + core if head == " " else core
        ids = self.pieces.get(word) or self._piece(word)
        if head == "\n":
            ids = self.newline + ids
        return ids + (self.pieces.get(tail) or self._piece(tail)) if tail else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out, start, chars = [], 0, 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars >= AT_ONCE:
                out += self._some(texts[start : i + 1])
                start, chars = i + 1, 0
        return out + self._some(texts[start:])

    def _some(self, texts: list[str]) -> list[bytes]:
        self.memo.shorten()
        self.words.shorten()
        return [self._text(t) for t in texts]

    def _text(self, text: str) -> bytes:
        if self.cut is not None and _plain_latin(text):
            return b"".join(map(self.words.__getitem__, self.cut(text)))
        if UNUSUAL.search(text):
            return self._fresh([text])[0]
        return b"".join(map(self.memo.__getitem__, self.chunks(text)))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    """The worker's own encoder for this file."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, keeps_space)
    return _ENCODERS[key]
