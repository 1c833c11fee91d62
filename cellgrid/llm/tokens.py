"""Tokenising whole texts with a public tokenizer, word by word where that gives the same ids.

The tokenizer file is a parameter; it is read on the executors by its path, as
installed there.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Separators that the tokenizer's own pattern and Python's take differently; texts with one go through whole.
_UNLIKE = b"\x1c\x1d\x1e\x1f\x85"
#: What texts may have beside Latin-1 to be cut here: quotes, dashes and other signs that no rule changes.
_SIGNS = re.compile("[\u2010-\u2027\u2030-\u205e\u20ac]")
#: Parts of words whose ids a worker keeps: as many new ones, and those used lately.  Only speed depends on it.
KNOWN_PARTS = 400_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be printed, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordRules:
    """What a tokenizer file says about cutting texts, if it drops all white space and reads nothing across it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        steps = (d.get("pre_tokenizer") or {}).get("pretokenizers") or []
        names = [n["type"] for n in (d.get("normalizer") or {}).get("normalizers") or []]
        cuts = [s["pattern"].get("Regex", "") for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        plain = any(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps)
        self.pattern = cuts[0] if len(cuts) == 1 and r"[^\s\p{L}\p{N}]+" in cuts[0] else None
        self.holds = bool(self.pattern) and plain and len(steps) == 2 and names == ["NFC", "Replace", "Lowercase"] and d.get("post_processor") is None and not d["model"].get("ignore_merges")

    def latin_pattern(self) -> re.Pattern:
        """The pattern for texts of Latin-1 in lower case, with its letter and number classes spelt out."""
        kind = lambda k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k)
        return re.compile(self.pattern.replace(r"\p{L}", kind("L")).replace(r"\p{N}", kind("N")))


def is_plain(text: str) -> bool:
    """Whether all characters are of Latin-1 or among a few signs: none of these changes under NFC or depends on others when lower-cased."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        try:
            data = _SIGNS.sub("", text).encode("latin-1")
        except UnicodeEncodeError:
            return False
    return len(data.translate(None, _UNLIKE)) == len(data)


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers.

    Where the file's rules and the text allow, each distinct part that the
    tokenizer's own pattern cuts is given to its model once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {s[0] for s in self.special if s}
        rules = WordRules(path)
        self.cut = rules.latin_pattern().findall if rules.holds else None
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def part(self, word: str) -> bytes:
        """The ids of a part, in the letters of the model's vocabulary."""
        written = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def encode(self, text: str) -> bytes:
        marked = any(m in text for m in self.marks) and any(s in text for s in self.special)
        if not self.cut or marked or not is_plain(text):
            return self.whole([text])[0]
        cut = self.cut(text.lower())
        known = self.parts
        try:
            return b"".join(map(known.__getitem__, cut))
        except KeyError:
            for word in set(cut).difference(known):
                known[word] = self.before.get(word) or self.part(word)
            out = b"".join(map(known.__getitem__, cut))
            if len(known) > KNOWN_PARTS:
                self.before, self.parts = known, {}
            return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
