"""BPE encoding and decoding by a pair occurrence index.

The words of a stretch of a partition lie in one array of symbols with links to
their neighbours. The index maps each pair's rank to all positions where the
pair begins. The lowest active rank is applied to all its positions at once;
only the pairs to the left and right of a merge change, and just these are
looked up again and put on the lists of their ranks. Words are independent, so
the result of each word is that of merging it alone.

Words seen before are looked up in a bounded memory; it is an aid, not part of
the result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import stretches
from .subwords import SPACES, byte_symbols

#: Characters of text that are encoded together.
STRETCH = 6_000_000
#: Chunks remembered by one Python worker; the memory starts anew beyond it.
REMEMBERED = 400_000
#: Code points on which this module's and the tokenizers library's Unicode tables agree;
#: texts with others are normalised and split by the library itself.
SETTLED = "\x00-\u052f\u0590-\u06ff\u0900-\u097f\u1e00-\u1fff\u2000-\u206f\u20a0-\u20bf\u2100-\u2bff\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001f64f"

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_SPACE = re.compile(f"[{SPACES}]+")
_RARE = re.compile(f"[^{SETTLED}]")


def _ordered(positions: np.ndarray) -> np.ndarray:
    """Distinct positions, ascending."""
    if len(positions) < 2:
        return positions
    positions.sort()
    return positions[np.r_[True, positions[1:] != positions[:-1]]]


class PairIndex:
    """Merges of a vocabulary, applied to many words at once."""

    def __init__(self, vocab: dict[str, int], merges: Iterable, suffix: str):
        symbols = byte_symbols()
        inner, last = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        for char, byte in symbols.items():
            inner[byte], last[byte] = vocab.get(char, -1), vocab.get(char + suffix, -1)
        if (inner < 0).any() or (last < 0).any():
            raise ValueError("the vocabulary lacks the symbols of some bytes")
        self.inner, self.last = inner, last
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (self.left << 32) | self.right
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, keys[order][1:] != keys[order][:-1]] if len(order) else np.zeros(0, bool)
        self.keys, self.ranks = keys[order][first], order[first]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where a pair never merges."""
        if not len(self.keys):
            return np.full(len(left), -1)
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many of them each word has. Words are non-empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes) - 1
        starts = ends + 1 - sizes
        symbol = self.inner[data]
        symbol[ends] = self.last[data[ends]]
        after = np.arange(1, len(data) + 1)
        after[ends] = -1
        before = np.arange(-1, len(data) - 1)
        before[starts] = -1

        index: dict[int, tuple[list, list]] = {}  # rank: positions one by one, and in arrays
        queue: list[int] = []

        def listed(rank: int) -> tuple[list, list]:
            if rank not in index:
                index[rank] = ([], [])
                heapq.heappush(queue, rank)
            return index[rank]

        def occur(positions: np.ndarray) -> None:
            ranks = self._rank(symbol[positions], symbol[after[positions]])
            if len(ranks) <= 24:
                for rank, where in zip(ranks.tolist(), positions.tolist()):
                    if rank >= 0:
                        listed(rank)[0].append(where)
                return
            active = ranks >= 0
            positions, ranks = positions[active], ranks[active]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            bounds = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else ranks
            for rank, where in zip(ranks[bounds].tolist(), np.split(positions, bounds[1:])):
                listed(rank)[1].append(where)

        occur(np.flatnonzero(after >= 0))
        while queue:
            rank = heapq.heappop(queue)
            single, arrays = index.pop(rank)
            at = _ordered(np.concatenate([np.array(single, np.int64), *arrays]))
            right = after[at]
            a, b = self.left[rank], self.right[rank]
            still = (symbol[at] == a) & (right >= 0) & (symbol[right] == b)
            at, right = at[still], right[still]
            if a == b and len(at) > 1:  # of overlapping pairs, every other one from the left
                count = np.arange(len(at))
                begins = np.r_[True, right[:-1] != at[1:]]
                kept = (count - np.maximum.accumulate(np.where(begins, count, 0))) % 2 == 0
                at, right = at[kept], right[kept]
            if not len(at):
                continue
            beyond = after[right]
            symbol[at], symbol[right] = self.made[rank], -1
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            ahead = before[at]
            touched = np.concatenate([ahead[ahead >= 0], at[inside]])
            if len(touched):
                occur(_ordered(touched))
        alive = symbol >= 0
        return symbol[alive], np.add.reduceat(alive, starts, dtype=np.int64)


class WordBpe:
    """Encoder and decoder of a word-end BPE file: NFC, white space collapsed, lower case."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if steps != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or not model.get("end_of_word_suffix") or spec.get("decoder"):
            raise ValueError(f"{path}: not a word-end BPE file of the kind read here")
        self.find = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACES)).findall
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.bytes_of = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.index = PairIndex(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.names = {i: t for t, i in (model["vocab"] | self.special).items()}
        #: Of chunks and of the pieces in them: ids, and decoded text.
        self.ids: dict[str | int, bytes] = {}
        self.text: dict[str | int, str] = {}
        self.forget()

    def forget(self) -> None:
        self.ids, self.text = {}, {}
        for number in self.special.values():
            self.ids[number], self.text[number] = number.to_bytes(4, "little"), self.names[number]

    def chunks(self, text: str) -> list[str | int]:
        """A text's normalised chunks between white space; special tokens stand as their ids."""
        if not self.marks or "<" not in text or not self.marks.search(text):
            return self._plain(text)
        out: list[str | int] = []
        at = 0
        for mark in self.marks.finditer(text):
            out += self._plain(text[at : mark.start()])
            out.append(self.special[mark[0]])
            at = mark.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if _RARE.search(text):
                text = self.normalise(text)
            else:  # lower-casing goes letter by letter: no final sigma
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to split() alone
            return list(filter(None, _SPACE.split(text.lower())))
        return text.lower().split()

    def pieces(self, chunk: str) -> list[str]:
        """A chunk's pieces, each of which is merged alone."""
        if chunk.isascii() or not _RARE.search(chunk):
            return self.find(chunk)
        return [bytes(map(self.bytes_of.__getitem__, mapped)).decode() for mapped, _ in self.split(chunk)]

    def learn(self, chunks: set[str | int]) -> None:
        """Put ids and decoded text of each of ``chunks`` in memory."""
        if len(self.ids) > REMEMBERED:
            self.forget()
        new = list(chunks - self.ids.keys())
        split = list(map(self.pieces, new))
        fresh = list(set().union(*split) - self.ids.keys())
        if fresh:
            ids, counts = self.index.encode([p.encode() for p in fresh])
            names, raw = list(map(self.names.__getitem__, ids.tolist())), ids.astype("<u4").tobytes()
            ends = np.cumsum(counts)
            spans = list(zip((ends - counts).tolist(), ends.tolist()))
            self.ids.update(zip(fresh, [raw[4 * a : 4 * b] for a, b in spans]))
            self.text.update(zip(fresh, [" ".join(names[a:b]) for a, b in spans]))
        for chunk, parts in zip(new, split):
            if len(parts) != 1 or parts[0] != chunk:
                self.ids[chunk] = b"".join(map(self.ids.__getitem__, parts))
                self.text[chunk] = " ".join(map(self.text.__getitem__, parts))

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Ids (four little-endian bytes each) and decoded text of each text, in order."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= STRETCH):
                size += len(texts[stop] or "")
                stop += 1
            split = [self.chunks(t) if t else [] for t in texts[start:stop]]
            self.learn(set().union(*split))
            for chunks in split:
                yield b"".join(map(self.ids.__getitem__, chunks)), " ".join(map(self.text.__getitem__, chunks))
            start = stop

    def decode(self, ids: bytes) -> str:
        """Tokens' names with spaces between, as a tokenizers file without a decoder decodes."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder for each file and Python worker."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode each whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_tokens and the SHA-256 digests of the ids (little-endian,
    32 bits) and of the decoded text. One row per input row, repeated ones too.
    A null or empty text has no ids and decodes to the empty text. A null
    doc_id stays null. Very long texts, and very long words, are encoded whole.
    Other columns are ignored; an empty table gives no rows.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(tokenizer)
        for batch in stretches(batches, 1, STRETCH):
            counts, ids_digests, text_digests = [], [], []
            for ids, decoded in coder.encode_all(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(encoded, RESULT)
