"""Token ids of the word-level BPE vocabulary, as little-endian unsigned 32-bit integers.

The ids of a text are those of its pre-tokens in turn, so each worker keeps the ids of the pre-tokens it has met and
gives the library only new ones. Texts with characters beyond Latin Extended-B, unusual white space or a special
token's opening go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa

from gaugeworks.llm.common import hold

VOCABULARY = "word_bpe_49k.json"
#: Pre-tokens kept in a worker; beyond that the half met last is dropped. Others go to the library again.
KEPT = 400_000
#: The letters and numbers of PLAIN texts once in lower case.
LETTERS, NUMBERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: The vocabulary's own split pattern (a fixed value of the file), with these characters for its classes.
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: The file's own steps, for which lower case and PRE_TOKEN stand.
STEPS = (
    b'{"type":"Sequence","normalizers":[{"type":"NFC"},{"type":"Replace","pattern":{"Regex":"\\\\s+"},"content":" "},{"type":"Lowercase"}]}',
    b'{"type":"Sequence","pretokenizers":[{"type":"Split","pattern":{"Regex":"\'s|\'t|\'re|\'ve|\'m|\'ll|\'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"},"behavior":"Removed","invert":true},{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":false}]}',
)
#: Characters on which Python's and the library's lower-casing, composition and classes agree.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-\u024f]*")

_tokenizers: dict[str, WordTokens] = {}


def forget() -> None:
    _tokenizers.clear()


class WordTokens:
    """The library's tokenizer and the ids of the pre-tokens met.

    ``library`` takes whole texts. ``parts`` has the same vocabulary and merges without the steps that lower case and
    ``PRE_TOKEN`` have already done, and takes single pre-tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.library = path, None
        self.parts = Tokenizer.from_file(path)
        steps = self.parts.normalizer, self.parts.pre_tokenizer
        self.fits = tuple(s and s.__getstate__() for s in steps) == STEPS  # else every text goes to the library whole
        self.parts.normalizer = None
        self.parts.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """The tokenizer of this Python worker, loaded once."""
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def whole(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, four bytes each."""
        found, open_places, new = [], [], {}
        get = self.known.get
        for text in texts:
            if not self.fits or not PLAIN.fullmatch(text) or "<|" in text:
                found.append(self.whole(text))
                continue
            words = PRE_TOKEN.findall(text.lower())
            ids = list(map(get, words))
            if None in ids:
                gaps = [(i, words[i]) for i, got in enumerate(ids) if got is None]
                new.update((word, b"") for _, word in gaps)
                open_places.append((len(found), ids, gaps))
                found.append(b"")
            else:
                found.append(b"".join(ids))
        if new:
            for word, got in zip(new, self.parts.encode_batch_fast(list(new), add_special_tokens=False), strict=True):
                new[word] = array("I", got.ids).tobytes()
            for at, ids, gaps in open_places:
                for i, word in gaps:
                    ids[i] = new[word]
                found[at] = b"".join(ids)
            if len(self.known) + len(new) > KEPT:  # those met first are mostly the frequent ones
                self.known = dict(islice(self.known.items(), KEPT // 2))
            self.known.update(islice(new.items(), KEPT - len(self.known)))
        return found


def encoded(texts: pa.Array, path: str, at_once: int = 200) -> Iterator[bytes]:
    """The ids of each text of a column, null as the empty text, in blocks that bound what is held."""
    hold(forget)
    tokenizer = WordTokens.of(path)
    for i in range(0, len(texts), at_once):
        yield from tokenizer.encode([t or "" for t in texts.slice(i, at_once).to_pylist()])


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)
