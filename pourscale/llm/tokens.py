"""Token ids of whole texts by a tokenizer file of the tokenizers library.

Where the tokenizer drops white space and ends words by a suffix, a text's ids are
those of its white-space parts one after the other, so each part met before comes
from a memo and the library encodes the new ones. Memos live as long as the Python
worker and take at most ``memo`` bytes each, by default ``MEMO``; they change no result.
Other tokenizers encode every text by the library alone.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MEMO = 96 << 20
#: Bytes that an entry takes besides its characters and ids.
_ENTRY = 220
#: Latin letters, then punctuation: two words for the tokenizer, the first in lower case.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: What str.split() parts and the tokenizer's white space does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_printable)))}


class _Memo(dict):
    """A dictionary of at most half of the given bytes, and the one before it, whose entries come back when they are met again."""

    def __init__(self, size: int):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.size = self.room = size // 2

    def again(self, key: str) -> bytes | None:
        found = self.before.get(key)
        return None if found is None else self.keep(key, found)

    def keep(self, key: str, ids: bytes) -> bytes:
        self.room -= _ENTRY + len(key) + len(ids)
        if self.room < 0:
            self.before = dict(self)
            self.clear()
            self.room = self.size
        self[key] = ids
        return ids


class TextEncoder:
    def __init__(self, path: str = TOKENIZER, memo: int = MEMO):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        rules = json.loads(self.library.to_str())
        first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_parts = bool(rules["model"].get("end_of_word_suffix")) and first.get("behavior") == "Removed" and first.get("invert") is True
        self.tokenize = self.library.model.tokenize
        self.parts = _Memo(memo)  # of white-space parts
        self.words = _Memo(memo)  # of pre-tokens

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token in lower case, straight from the library's model."""
        found = self.words.get(word) or self.words.again(word)
        if found is None:
            found = array(self.dtype.char, [t.id for t in self.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
            self.words.keep(word, found)
        return found

    def _part(self, part: str) -> bytes:
        if m := _PLAIN(part):
            word, marks = m.groups()
            found = self._word(word.lower()) + self._word(marks) if word and marks else self._word(word.lower() or marks)
        else:
            found = self._library(part)
        return self.parts.keep(part, found)

    def _text(self, text: str | None) -> bytes:
        if not text or _ODD_SPACE.search(text):
            return self._library(text or "")
        parts = text.split()
        found = list(map(self.parts.get, parts))
        if None in found:
            found = [ids if ids is not None else self.parts.get(part) or self.parts.again(part) or self._part(part) for ids, part in zip(found, parts)]
        return b"".join(found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text; null is empty."""
        if not self.by_parts:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        return list(map(self._text, texts))


@cache
def encoder(path: str = TOKENIZER, memo: int = MEMO) -> TextEncoder:
    """The worker's encoder of a tokenizer file."""
    return TextEncoder(path, memo)
