"""Token ids of whole texts by the tokenizers library, with a table of words met before."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable

from tokenizers import Tokenizer

TOKENIZER_FILE = "byte_bpe_50k.json"
#: The word pattern of byte-level BPE (fixed by the vocabulary's format).
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the other bytes in turn for the characters from U+0100."""
    letters, spare = {}, 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + spare)
            spare += 1
    return letters


class _Table(dict):
    """Ids of what was met before; others are worked out by `found` and kept while there is room."""

    def __init__(self, found: Callable[[str], bytes], room: int):
        super().__init__()
        self.found, self.room = found, room

    def __missing__(self, key: str) -> bytes:
        ids = self.found(key)
        if len(self) < self.room and len(key) < 64:
            self[key] = ids
        return ids


class _Placed(Exception):
    """A part whose ids depend on its place in the text."""


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers.

    A byte-level BPE cuts a text into words before it merges anything, and a space or line feed between
    two other characters always begins a word. So the text is split there, and the ids of each part (a word
    with the marks after it) come from a table, or else from the library's model. Texts with other runs of
    white space are cut by the full pattern, and those that hold added tokens are encoded whole, as are all
    texts of tokenizers of another kind. `parts` and `pieces` bound the tables; both only save work."""

    def __init__(self, path: str, parts: int = 600_000, pieces: int = 100_000):
        import regex

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = not pre.get("add_prefix_space", True) and not spec.get("normalizer") and spec["model"].get("type", "BPE") == "BPE"
        self.byte_level = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.find, self.letters = regex.compile(_WORD).findall, _byte_letters()
        self.space = self.letters[0x20]
        self.pieces, self.parts = _Table(self._model, pieces), _Table(self._part, parts)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, piece: str) -> bytes:
        return self._letters(piece.encode().decode("latin-1").translate(self.letters))

    def _letters(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def _word(self, body: str) -> bytes:
        """Ids of a word of letters with a space before it."""
        return self._letters(self.space + body) if body.isascii() else self._model(" " + body)

    def _part(self, part: str) -> bytes:
        """Ids of a part with the white space before it. Letters, and letters before one mark, are cut without the pattern."""
        if part.isalpha():
            return self._word(part)
        if part[-1:] in (".", ",") and part[:-1].isalpha():
            return self.parts[part[:-1]] + self.pieces[part[-1]]
        body = part[1:] if part[:1] == "\n" else part
        if not body or body[0].isspace() or body[-1].isspace():
            raise _Placed
        return self._cut(" " + body) if body is part else self.pieces["\n"] + self._cut(body)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.byte_level or any(x in text for x in self.added):
            return self.whole(text)
        head, *parts = text.replace("\n", " \n").split(" ")
        if not head or head[0].isspace() or head[-1].isspace():
            return self._cut(text)
        try:
            return self._cut(head) + b"".join(map(self.parts.__getitem__, parts))
        except _Placed:
            return self._cut(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Callable[[str | None], bytes]:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path].encode
