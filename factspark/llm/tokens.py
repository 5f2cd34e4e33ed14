"""Whole texts to the ids of a public tokenizer file, by the tokenizers library, with each distinct word encoded once per worker."""

from __future__ import annotations

import gc
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The split patterns of the two tokenizer files (fixed values).
BYTE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: printable bytes stand for themselves, the rest follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: Signs that end a word in both files; what follows them is a run of its own, cut the same way wherever it stands.
_MARKS = ".,:;!?#$%&*+=@^~|/)(-_\"]}["
#: What isn't a single blank or line break between words: other white space, and any two next to each other.
_SPACES = (*("".join((a, b)) for a in " \n" for b in " \n"), *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
_ASCII_SPACES = tuple(c for c in _SPACES if c.isascii())
#: Texts that aren't words between single blanks and line breaks only, or may hold a special token (RE2's syntax).
_ODD = r"\A[ \n]|[ \n]\z|[ \n]{2}|<\||[" + "".join(rf"\x{{{ord(c):x}}}" for c in _SPACES if len(c) == 1) + "]"


class _Known(dict):
    """piece -> ids; a piece that is not there is encoded on first use. A full cache becomes the old one and a new one begins, so
    that what is used often stays."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.encode(piece)
        if len(self) >= self.limit:
            self.old = self.copy()
            self.clear()
        self[piece] = got
        return got


class WordEncoder:
    """encode(text) gives the ids of tokenizer.encode(text, add_special_tokens=False) as little-endian bytes.

    Both files split a text at white space before they merge, so words between single blanks can be encoded on their own; the
    library's model merges each of them, and a bounded cache holds the results. A text where that split is in doubt (runs of
    white space, control separators, a possible special token) goes to the library as a whole.
    """

    def __init__(self, path: str, cache: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind["pre_tokenizer"]
        self.words = pre["type"] == "Sequence" and kind["normalizer"] is not None
        self.plain = not self.words and not (pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and kind["normalizer"] is None)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.letters = _byte_letters()
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.first = _Known(lambda p: self._piece("", p), cache)
        self.rest = _Known(self._after, cache)
        self.newline = b"" if self.words or self.plain else self.first["\n"]

    def _ids(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def _merge(self, part: str) -> bytes:
        return self._ids(part if part.isascii() and part.isalnum() else "".join(map(self.letters.__getitem__, part.encode())))

    def _piece(self, blank: str, piece: str) -> bytes:
        if piece.isalpha():
            return self._ids(self.letters[32] + piece if blank else piece) if piece.isascii() else self._merge(blank + piece)
        if (word := piece.rstrip(_MARKS)).isalpha():
            return (self.rest if blank else self.first)[word] + self.first[piece[len(word) :]]
        return b"".join(map(self._merge, (WORD_SPLIT if self.words else BYTE_SPLIT).findall(blank + piece)))

    def _after(self, piece: str) -> bytes:
        """A piece that stands after a blank; one marked by a line break stands after that, one marked by a return begins its text."""
        if piece[0] == "\n":
            return self.newline + self.first[piece[1:]]
        return self.first[piece[1:]] if piece[0] == "\r" else self._piece(" ", piece)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.plain or "<|" in text:
            return self.whole(text)
        if self.words:
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return self.whole(text)
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            # a sigma at a word's end is lower-cased like any other by the library, which takes one letter at a time
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            return b"".join(map(self.first.__getitem__, text.split()))
        if text[0] in " \n" or text[-1] in " \n" or any(c in text for c in (_ASCII_SPACES if text.isascii() else _SPACES)):
            return self.whole(text)
        out = []
        for line in text.split("\n"):
            pieces = line.split(" ")
            out.append(self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:])))
        return self.newline.join(out)


    def encode_each(self, texts: pa.Array, size: int = 1 << 23) -> list[bytes]:
        """encode(text) of each of the texts. The distinct pieces of some texts at a time, about so many bytes, are looked up once."""
        if self.plain or self.words:
            return list(map(self.encode, texts.to_pylist()))
        out, at = [], 0
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            out += self._of_some(texts.slice(at, to - at))
            at = to
        return out

    def _of_some(self, texts: pa.Array) -> list[bytes]:
        odd = pc.fill_null(pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(pc.binary_length(texts), 0)), True)
        plain = texts.filter(pc.invert(odd))
        encoded = iter(self._of_plain(plain) if len(plain) else ())
        return [self.encode(texts[i].as_py()) if o else next(encoded) for i, o in enumerate(odd.to_pylist())]

    def _of_plain(self, texts: pa.Array) -> list[bytes]:
        marked = pc.binary_join_element_wise(pa.scalar("\r", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type))
        words = pc.split_pattern(marked, " ")
        pieces = words.flatten().dictionary_encode()
        known = list(map(self.rest.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False)))
        n = np.fromiter(map(len, known), np.int32, len(known)) // self.dtype.itemsize
        ids, starts = np.frombuffer(b"".join(known), self.dtype), np.cumsum(n, dtype=np.int32) - n
        place = pieces.indices.to_numpy()
        n, starts = n[place], starts[place]
        ends = np.cumsum(n, dtype=np.int32)
        got = ids[np.repeat(starts - (ends - n), n) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        last = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        cuts = [0, *(ends[last - 1] * self.dtype.itemsize).tolist()]
        return [got[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, cache: int = 400_000) -> WordEncoder:
    """One per Python worker and file; its caches outlive a task. Merging makes many short-lived objects and no cycles, so the worker
    looks for cycles less often (a sixth of the time went there)."""
    if path not in _encoders:
        gc.set_threshold(500_000)
        _encoders[path] = WordEncoder(path, cache)
    return _encoders[path]
