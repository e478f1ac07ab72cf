"""BPE encoding and decoding by forced boundaries.

A byte pair that occurs inside no vocabulary token is never inside an encoded token: wherever it stands in
a text, a token ends. The pairs are marked once in a 256 x 256 table from the vocabulary. Texts are cut at
marked pairs of a solid byte and a following space (which the pretokenizer cannot look across), each
fragment is encoded by itself and the ids are concatenated. Inside a fragment the pretokenizer's pattern
and the other marked pairs cut again, and what is left is merged by rank. Fragments repeat, so each worker
keeps those that it has met, up to a bound.

Defined results: null counts as empty text (no ids); ``<|endoftext|>`` in a text is the special token, as
in the tokenizers library; texts of any length are encoded whole, in time n log n for one long fragment.
Columns other than doc_id and text are passed over.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy, worker_table

VOCABULARY = "byte_bpe_50k.json"
#: Fragments and words that a worker keeps.
KEPT = 150_000
#: The published pattern of the byte-level pretokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Known(dict):
    """Results of ``make`` by key: those used lately, in two generations of ``KEPT`` at most."""

    def __init__(self, make: Callable[[bytes], tuple[int, ...]]):
        self.make, self.old = make, {}

    def __missing__(self, key: bytes) -> tuple[int, ...]:
        if (found := self.old.get(key)) is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _alphabet()
        ids = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"] if a["special"]}
        self.token = dict(sorted([(i, t) for t, i in ids.items()] + [(i, t) for t, i in self.special.items()]))
        self.text = {i: str(i) for i in self.token}
        self.single = [ids.get(bytes([b])) for b in range(256)]
        self.rank, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(byte[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[ids[a], ids[b]] = rank
            self.made.append(ids[a + b])
        inside = np.zeros((256, 256), dtype=bool)
        for t in ids:
            if len(t) > 1:
                v = np.frombuffer(t, dtype=np.uint8)
                inside[v[:-1], v[1:]] = True
        #: Pairs of bytes that mark a certain cut.
        self.never = ~inside
        blank = np.zeros(256, dtype=bool)
        blank[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
        #: Those among them at which the pretokenizer cuts as well, whatever stands around.
        self.outer = self.never & ~blank[:, None] & blank[None, :]
        #: Whether a space or a line end after any solid byte is a marked pair, and where texts need a closer look.
        self.simple = bool(self.outer[~blank][:, [10, 32]].all())
        self.unclear = re.compile(rb"[\x09-\x0d\x1c-\x20][\x09-\x0d\x1c-\x20]|[\xc2\xe1\xe2\xe3][\x80-\xbf]{1,2}[ \n]|\0")
        self.fragments, self.words = Known(self._fragment), Known(self._word)
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(regex.escape(s.decode()) for s in self.special)) if self.special else None

    def _merged(self, word: bytes) -> list[int]:
        ids = [self.single[b] for b in word]
        if len(ids) > 48:
            return self._merged_long(ids)
        get, none = self.rank.get, 1 << 60
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i] = new = self.made[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], new), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i], after[j] = self.made[rank], -1, after[j], -1
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := get((ids[x], ids[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[after[x]]))
        return [i for i in ids if i >= 0]

    def _word(self, word: bytes) -> tuple[int, ...]:
        if len(word) <= 16:
            return tuple(self._merged(word))
        v = np.frombuffer(word, dtype=np.uint8)
        at = [0, *(np.flatnonzero(self.never[v[:-1], v[1:]]) + 1).tolist(), len(word)]
        return tuple(chain.from_iterable(self._merged(word[i:j]) for i, j in zip(at, at[1:])))

    def _fragment(self, fragment: bytes) -> tuple[int, ...]:
        if fragment.isascii() and (fragment[1:] or fragment).isalpha() and (fragment[0] == 32 or fragment[:1].isalpha()):
            return self._word(fragment)  # the pattern takes it whole
        found = [self.words[w.encode()] for w in self.pattern.findall(fragment.decode())]
        return found[0] if len(found) == 1 else tuple(chain.from_iterable(found))

    def _plain(self, text: bytes) -> list[int]:
        if not text:
            return []
        if self.simple and not self.unclear.search(text):
            # each space and line end follows a solid byte: cut before them all
            parts = text.replace(b" ", b"\0 ").replace(b"\n", b"\0\n").split(b"\0")
            return list(chain.from_iterable(map(self.fragments.__getitem__, parts if parts[0] else parts[1:])))
        v = np.frombuffer(text, dtype=np.uint8)
        hit = self.outer[v[:-1], v[1:]]
        # a blank beyond ASCII may end in this byte; the cut is left out there
        if (v >= 128).any():
            doubt = np.zeros(len(v), dtype=bool)
            doubt[1:] = ((v[:-1] == 0xC2) & ((v[1:] == 0x85) | (v[1:] == 0xA0)))
            doubt[2:] |= (v[:-2] >= 0xE1) & (v[:-2] <= 0xE3) & ((v[1:-1] == 0x80) | (v[1:-1] == 0x81) | (v[1:-1] == 0x9A))
            hit &= ~doubt[:-1]
        at = [0, *(np.flatnonzero(hit) + 1).tolist(), len(v)]
        parts = [text[i:j] for i, j in zip(at, at[1:])]
        return list(chain.from_iterable(map(self.fragments.__getitem__, parts)))

    def encode(self, text: bytes) -> list[int]:
        """Ids of a UTF-8 text."""
        if not self.marks or not any(s in text for s in self.special):
            return self._plain(text)
        out, at, whole = [], 0, text.decode()
        for m in self.marks.finditer(whole):
            out += self._plain(whole[at : m.start()].encode())
            out.append(self.special[m[0].encode()])
            at = m.end()
        return out + self._plain(whole[at:].encode())

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text of ids; bytes that make no character become the replacement character."""
        raw = b"".join(map(self.token.__getitem__, ids))
        return raw.decode("utf-8", errors="replace").encode()


def encoder(path: str) -> Encoder:
    return worker_table("encoder", path, make=lambda: Encoder(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, ids array<int>) of every document."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([enc.encode(t) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, keep=True), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, text) of encoded documents; null ids give empty text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(i or []).decode() for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidy(run, keep=True), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each document encoded and decoded in one pass: rows (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        name = enc.text.__getitem__
        for part, texts in slices(batches, "text"):
            count, ids_sha, text_sha = [], [], []
            for t in texts:
                ids = enc.encode(t)
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, keep=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
