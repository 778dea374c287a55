"""Token ids of a public byte-level BPE vocabulary.

The ids equal those of ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
The vocabulary file's merges are run by the faster of the installed BPE libraries; texts that hold a
special token's string, or a word so long that it matters, go to the tokenizer itself.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

TOKENIZER = "byte_bpe_50k.json"

# Fixed value: the splitting pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = re.compile(r"\S{2000}|\s{2000}")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        chars = _byte_chars()
        ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def whole(self):
        """The tokenizer itself, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def plain(self):
        """The tokenizer, but strings of special tokens are text."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers; none for a null or empty text."""
        if not text:
            return np.empty(0, "<u4")
        if LONG_WORD.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")

    def ordinary(self, text: str | None) -> np.ndarray:
        """Ids with the strings of special tokens read as ordinary text: no special id ever comes out."""
        if text and any(s in text for s in self.special):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4")
        return self.encode(text)


@functools.cache
def encoder(path: str) -> Encoder:
    """The worker's encoder, loaded once."""
    return Encoder(path)
