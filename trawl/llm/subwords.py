"""Byte-level BPE ids of whole texts.

The vocabulary comes from a tokenizers file. Where its ids follow the order of
its merges, a rank encoder gives the same ids as the tokenizers library at
several times its speed; the tests compare the two, over every code point too.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Fixed: the pattern by which byte-level BPE files of this family split text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as Unicode defines it, as the pattern's white space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space of at least so many characters is cut out before the pattern runs, which would run out of stack on a million.
LONG_SPACE = 50_000

#: It is looked for from a run's first character alone, so that every shorter run is read once too.
_LONG_SPACE = re.compile(f"[{SPACES}](?<![{SPACES}]{{2}})[{SPACES}]{{{LONG_SPACE - 1},}}")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others, in order, take
    the code points from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or order != sorted(order):
            raise ValueError(f"{path}: not a byte-level BPE file whose ids follow the order of its merges")
        self.size = max(vocab.values()) + 1
        self._ranked = tiktoken.Encoding(
            "ranked",
            pat_str=SPLIT,
            mergeable_ranks={bytes(symbols[c] for c in token): i for token, i in vocab.items()},
            special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]},
        )
        self._special = tuple(t["content"] for t in spec["added_tokens"])

    def encode(self, text: str | None) -> bytes:
        """The ids of one whole text, four little-endian bytes each; a null text has none.

        Special tokens' strings become their ids, as they do in the tokenizers library.
        """
        if not text:
            return b""
        if len(text) < LONG_SPACE or not _LONG_SPACE.search(text):
            return self._ids(text)
        parts, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            # The pattern makes one piece of a run; before anything but the end and special tokens, all but its last character.
            end = run.end()
            if end < len(text) and not (self._special and text.startswith(self._special, end)):
                end -= 1
            parts += [self._ids(text[at : run.start()]), np.array(self._ranked._encode_single_piece(text[run.start() : end]), "<u4").tobytes()]
            at = end
        return b"".join([*parts, self._ids(text[at:])])

    def _ids(self, text: str) -> bytes:
        return self._ranked.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() if text else b""


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each file and Python worker."""
    return ByteBpe(path)
