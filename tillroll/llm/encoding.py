"""Token ids of whole texts with a file of the ``tokenizers`` library.

A text of Latin-1 characters is cut into the tokenizer's own pre-tokens by the
rules stated below, and each distinct one goes through the library's BPE model
once per Python worker, as long as it is short and remembered (``memo.py``).  Any other text is cut where the tokenizer always cuts
(at white space), and each distinct chunk goes through the library whole; a
text with a character on which Python and the library disagree about white
space goes through it at once.  A text's ids are those of its parts put
together.  The strings of special tokens count as ordinary text.

Ids come as bytes, little-endian unsigned 32-bit, so that joining, slicing and
checksums never make Python integers.
"""

from __future__ import annotations

import re
import struct

from tokenizers import Tokenizer

from tillroll.llm.memo import Memo

# The splitting rules of the two files for Latin-1 characters.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼½¾"
_BLANK = "\\s\x85\xa0"
_WORD_SPLIT = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")
_BYTE_SPLIT = re.compile(
    f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_LATIN = re.compile("[\\x00-\\x1b\x20-\xff]*")
#: Python takes these for white space, the library doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_WHITE = " \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BYTE_CHUNK = re.compile(f"[ ]?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: itself if printable,
    else the next unused character from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return out


_SHOWN = _byte_letters()


_SPACE = _SHOWN[32]
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """``ids(text)`` gives a whole text's packed ids."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.words = self.tokenizer.normalizer is not None
        self.split = (_WORD_SPLIT if self.words else _BYTE_SPLIT).findall
        self.chunks = str.split if self.words else _BYTE_CHUNK.findall
        self.of_piece = Memo(self.piece)
        self.of_chunk = Memo(self.whole)

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token of a Latin-1 text."""
        if piece.isascii() and piece[1:].isalpha() and piece[0] == " ":
            piece = _SPACE + piece[1:]
        elif not (piece.isascii() and piece.isalpha()):
            piece = piece.encode("utf-8").decode("latin-1").translate(_SHOWN)
        return _packed([t.id for t in self.model.tokenize(piece)])

    def ids(self, text: str) -> bytes:
        if _LATIN.fullmatch(text):
            return b"".join(map(self.of_piece.__getitem__, self.split(text.lower() if self.words else text)))
        if self.words and _ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.of_chunk.__getitem__, self.chunks(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
