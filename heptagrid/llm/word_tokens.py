"""Encoding of whole texts with a tokenizers-library file, with repeated words encoded once.

The tokenizer's normaliser lower-cases, its pre-tokeniser drops white space, and no pre-token spans white space. So the
ids of a text are those of its lower-cased words in turn, and a word's ids can be kept. A text holding anything for which
that would have to be argued (characters beyond plain Latin letters, rare white space, ``<|``, which may begin a special
token) goes to the library as it is. Any other tokenizer file does so always.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: Outside these, or with "<|", a text goes to the library whole: no composing marks, no dotted capital I, no rare spaces.
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ]|<\\|")
#: The normaliser and splitting pattern for which word by word encoding is the same.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Of the last words met, so many at least and twice as many at most are kept, some 100 bytes each.
WORDS_KEPT = 250_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Recent(dict):
    """A bounded memory: what was not asked for since the last two changes of generation is dropped."""

    def __init__(self, make, keep: int = WORDS_KEPT):
        self.make, self.keep, self.before = make, keep, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.keep:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """``ids(text)``: the text's ids as little-endian unsigned 32-bit integers, as the library gives them."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers") or [{}]
        self.by_word = (
            norm.get("normalizers") == NORMALIZERS
            and len(parts) == 2
            and parts[0].get("pattern") == {"Regex": SPLIT}
            and parts[0].get("behavior") == "Removed"
            and parts[0].get("invert") is True
            and parts[1].get("type") == "ByteLevel"
            and not parts[1].get("add_prefix_space")
            and not parts[1].get("use_regex")
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
        )
        self.split = regex.compile(SPLIT).findall
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x180)}
        self.model = self.library.model
        self.words = _Recent(self._word)
        self.word = self.words.__getitem__

    def _word(self, word: str) -> bytes:
        if not word.isalpha() and len(pieces := self.split(word)) > 1:
            return b"".join([self.words[p] for p in pieces])
        ids = [t.id for t in self.model.tokenize(word.translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or NOT_PLAIN.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.word, text.lower().split()))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file; the worker is used again by later tasks."""
    return WordEncoder(path)


def digest_of_file(path: str) -> str:
    """The tokenizer's version: a digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
