"""Whole texts to token ids with the tokenizers library, each distinct word encoded once per worker.

`word_bpe_49k.json` lower-cases, drops white space and encodes each run of letters, each digit and each run of other
signs by itself, so a text's ids are those of its white-space separated words in order. Words are cut at ASCII white
space, their ids are kept in a dictionary, and a text is the join of its words' ids. Words of code points under U+0130
(where NFC changes nothing and lower-casing is per character) are split further by the tokenizer's own pattern and
encoded by its BPE model; any other word goes through the whole tokenizer, and so does a text that may hold one of the
tokenizer's special tokens. A test holds this against encoding whole texts.

`byte_bpe_50k.json` keeps case and white space. Its pattern never crosses the place between a word and the white space
after it, so a text's ids are those of its units (white space and the word after it), unless it holds white space that is
not ASCII. Where white space stands alone, units are words after one space, and lines are cut first.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import public_tokenizers
import regex

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Words and pieces of words that a worker keeps in a young and in an old dictionary each; a full young one becomes the old.
KEPT_WORDS, KEPT_PIECES = 250_000, 350_000
#: Text to encode at once: the more, the fewer distinct words.
ENCODE_BYTES = 4 << 20
_ENCODERS: dict[str, Encoder] = {}
#: White space beyond ASCII, in UTF-8; and what makes a line's words differ from units that one space begins, beside a
#: space or two lines' ends at the end and a line's end at the beginning.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_NOT_PLAIN = (b"  ", b"\t", b"\r", b"\x0b", b"\x0c", b" \n", b"\n ", b"\n\n\n")
_UNIT = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")


def default_path(name: str = WORD_BPE) -> str:
    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file: by units for byte-level files that split by the usual pattern, else by words."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            plain = json.load(f)["pre_tokenizer"].get("type") == "ByteLevel"
        _ENCODERS[path] = (UnitEncoder if plain else Encoder)(path)
    return _ENCODERS[path]


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Kept(dict):
    """Ids by key; a missing key is looked up among the older ones, or else made."""

    def __init__(self, make, older: dict):
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, key):
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        self[key] = ids
        return ids

    def aged(self) -> "_Kept":
        """A fresh dictionary with this one behind it."""
        self.older = {}
        return _Kept(self.make, self)


class _Tokenizer:
    """A tokenizer file and the width of its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.code, self.kind = ("H", np.uint16) if self.size <= 1 << 16 else ("I", np.uint32)
        self.special = [t["content"].encode() for t in self.spec["added_tokens"]]

    def encode_whole(self, text: bytes) -> bytes:
        return array(self.code, self.whole.encode(text.decode(), add_special_tokens=False).ids).tobytes()


class Encoder(_Tokenizer):
    def __init__(self, path: str):
        super().__init__(path)
        spec = self.spec
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = _byte_letters()
        self.bpe = self.whole.model.tokenize
        self.pieces = _Kept(self._piece, {})
        self.words = _Kept(self._word, {})

    def _piece(self, piece: str) -> bytes:
        """Ids of one run of letters, digit, or run of other signs, in lower case."""
        if not (piece.isascii() and piece.isalpha()):
            piece = "".join([self.letters[b] for b in piece.encode()])
        return array(self.code, [t.id for t in self.bpe(piece)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not text.isascii() and max(text) >= "İ":
            return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        if text.isalpha():
            return self.pieces[text]
        if text[-1] in ".,!?" and text[:-1].isalpha():
            return self.pieces[text[:-1]] + self.pieces[text[-1]]
        return b"".join([self.pieces[p] for p in self.pattern.findall(text)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, of 16 bits where the vocabulary allows."""
        if len(self.words) > KEPT_WORDS:
            self.words = self.words.aged()
        if len(self.pieces) > KEPT_PIECES:
            self.pieces = self.pieces.aged()
        get, out = self.words.__getitem__, []
        for text in texts:
            if any([s in text for s in self.special]):
                out.append(np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, self.kind))
            else:
                out.append(np.frombuffer(b"".join(map(get, text.split())), self.kind))
        return out


class UnitEncoder(_Tokenizer):
    """Byte-level BPE by units: white space with the word after it."""

    def __init__(self, path: str):
        super().__init__(path)
        self.letters, self.bpe = _byte_letters(), self.whole.model.tokenize
        self.pieces = _Kept(self._piece, {})
        self.units, self.spaced = _Kept(self._unit, {}), _Kept(lambda word: self._unit(b" " + word), {})
        self.pattern = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
        self.line = self._unit(b"\n")

    def _piece(self, piece: str) -> bytes:
        """Ids of one match of the tokenizer's pattern."""
        return array(self.code, [t.id for t in self.bpe(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _unit(self, unit: bytes) -> bytes:
        text = unit.decode()
        word = text[1:] if text[:1] == " " else text
        if not word or word[0].isspace() or not word.isascii() and max(word) >= "İ":
            return self.encode_whole(unit)
        if word.isalpha():
            return self.pieces[text]
        if word[-1] in ".,!?;:" and word[:-1].isalpha():
            return self.pieces[text[:-1]] + self.pieces[text[-1]]
        return b"".join([self.pieces[p] for p in self.pattern.findall(text)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.pieces) > KEPT_PIECES:
            self.pieces = self.pieces.aged()
        if len(self.units) > KEPT_WORDS:
            self.units = self.units.aged()
        if len(self.spaced) > KEPT_WORDS:
            self.spaced = self.spaced.aged()
        bare, spaced, out = self.units.__getitem__, self.spaced.__getitem__, []
        for text in texts:
            if any([s in text for s in self.special]) or (not text.isascii() and _WIDE_SPACE.search(text)):
                ids = self.encode_whole(text)
            elif any([s in text for s in _NOT_PLAIN]) or text[-1:].isspace() or text[:1] == b"\n":
                ids = b"".join(map(bare, _UNIT.findall(text)))
            elif b"\n" in text:
                lines = []
                for line in text.split(b"\n"):
                    first, *words = line.split(b" ")
                    lines.append((bare(first) if first else b"") + b"".join(map(spaced, words)))
                ids = self.line.join(lines)
            else:
                first, *words = text.split(b" ")
                ids = (bare(first) if first else b"") + b"".join(map(spaced, words))
            out.append(np.frombuffer(ids, self.kind))
        return out


def text_list(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    whole, cuts = raw.tobytes(), offsets.tolist()
    return [whole[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
