"""Language identification by unigram pieces with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary (a sentencepiece model, its
path a parameter; single bytes complete it). All pieces take part that can stand in a word: letters, with a word
start in front or not. A word's probability is the sum over all its segmentations of
the product of its pieces' probabilities, by the forward algorithm; a text's is the product over its words
(runs of letters, in lower case) with a word start in front. The probabilities are fitted by expectation-
maximisation on the words of a bounded sample: about ``SAMPLE`` texts of each language, chosen by a hash of
doc_id, with all their words, however long. Everything else covers all texts, whole.

Words are taken together in matrices by length; those of more than ``ALONE`` bytes one by one, in logarithms.

Defined results: null text, or text without a letter: language ``und``, score 0; score is the posterior of
the language (equal priors); ties go to the first language in order; with no labelled rows every text is
``und``. Repeated rows are scored alike; other columns are never read for a prediction. A row with null doc_id is
not learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, tidy, worker_table

VOCABULARY = "piece_bpe_32k.model"
SAMPLE, ROUNDS, SMOOTH, ALONE = 1500, 3, 0.02, 256
#: Words that a worker keeps, and their characters at most.
KEPT, LONG = 120_000, 64
#: About how much less likely a word is with each byte more.
_LIFT = 8.0
_WORDS = re.compile(r"[^\W\d_]+")


_PIECE = re.compile(r"▁?[^\W\d_]*", re.UNICODE)
_BASE = pow(0x9E3779B97F4A7C15, 3, 1 << 64) | 1


class Pieces:
    """The vocabulary's pieces that can stand in a word, and all single bytes, in order; a space stands for the word
    start. To match them backwards from an end, the tails of all pieces are kept by length as hashes: with the piece
    that each is, or -1."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(1, 256)}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and piece and _PIECE.fullmatch(piece):
                found.add(piece.replace("▁", " ").lower().encode())
        self.names = sorted(found)
        number = {name: i for i, name in enumerate(self.names)}
        tails = {name[-n:] for name in self.names for n in range(1, len(name) + 1)}
        self.tails = {t: number.get(t, -1) for t in tails}
        self.longest = max(map(len, tails))
        self.powers = np.array([pow(_BASE, n, 1 << 64) for n in range(self.longest)], dtype=np.uint64)
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for n in range(1, self.longest + 1):
            own = [t for t in tails if len(t) == n]
            chars = np.frombuffer(b"".join(own), dtype=np.uint8).reshape(len(own), n).astype(np.uint64) + np.uint64(1)
            code = (chars[:, ::-1] * self.powers[:n]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(code)
            if (np.diff(code[order].view(np.int64)) == 0).any():
                raise ValueError("two pieces have one hash")
            self.by_length.append((code[order], np.array([self.tails[t] for t in own], dtype=np.int64)[order]))

    def __len__(self) -> int:
        return len(self.names)

    def ending(self, chars: np.ndarray, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For pieces that end at column ``end`` of a matrix of bytes: length, rows and piece numbers."""
        rows = np.flatnonzero(chars[:, end - 1] > 0)
        code = np.zeros(len(rows), dtype=np.uint64)
        for n in range(1, min(self.longest, end) + 1):
            code = code + (chars[rows, end - n].astype(np.uint64) + np.uint64(1)) * self.powers[n - 1]
            hashes, piece = self.by_length[n]
            at = np.minimum(np.searchsorted(hashes, code), len(hashes) - 1)
            hit = hashes[at] == code
            rows, code, at = rows[hit], code[hit], at[hit]
            if not len(rows):
                return
            whole = piece[at] >= 0
            if whole.any():
                yield n, rows[whole], piece[at[whole]]

    def walk(self, word: bytes) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each end in a word: the pieces that end there, as (length, piece number)."""
        get = self.tails.get
        for end in range(1, len(word) + 1):
            found = []
            for n in range(1, min(self.longest, end) + 1):
                piece = get(word[end - n : end])
                if piece is None:
                    break
                if piece >= 0:
                    found.append((n, piece))
            yield end, found


def pieces(path: str) -> Pieces:
    """A worker's table of a vocabulary: one for all fits and predictions, never shipped with a task."""
    return worker_table("pieces", path, make=lambda: Pieces(path))


def _matrices(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of up to ALONE bytes and like lengths as matrices of bytes, each with the words' numbers."""
    size = np.array([len(w) for w in words])
    for lo, hi in [(0, 8), (8, 12), (12, 18), (18, 32), (32, 64), (64, 128), (128, ALONE)]:
        at = np.flatnonzero((size > lo) & (size <= hi))
        for k in range(0, len(at), 1 << 14):
            own = at[k : k + (1 << 14)]
            width = int(size[own].max())
            flat = b"".join(words[i].ljust(width, b"\0") for i in own)
            yield own, np.frombuffer(flat, dtype=np.uint8).reshape(len(own), width)


def _forward(ends: list[list[tuple[int, int]]], log_prob: list[float]) -> list[float]:
    """Log forward sums of a word at all its ends, one language."""
    log = [0.0]
    for end, found in enumerate(ends, 1):
        last = log[-1]
        log.append(last + math.log(sum(math.exp(log[end - n] - last + log_prob[piece]) for n, piece in found)))
    return log


def word_scores(words: list[bytes], table: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log probabilities of words under each language (columns of ``prob``)."""
    out = np.zeros((len(words), prob.shape[1]))
    for own, chars in _matrices(words):
        n, width = chars.shape
        size = (chars > 0).sum(1)
        recent = [np.ones((n, prob.shape[1]))]  # forward sums at the last ends, as many as the longest piece
        scale = np.zeros((n, prob.shape[1]))
        for end in range(1, width + 1):
            new = np.zeros((n, prob.shape[1]))
            for k, rows, piece in table.ending(chars, end):
                new[rows] += recent[-k][rows] * prob[piece]
            recent = [*recent[1 - table.longest :], new]
            stop = np.flatnonzero(size == end)
            out[own[stop]] = np.log(np.maximum(new[stop], 1e-300)) + scale[stop]
            if end % 8 == 0:
                top = np.maximum(np.max(recent[-8:], axis=0), 1e-300)
                recent = [r / top for r in recent]
                scale += np.log(top)
    for i, word in enumerate(words):
        if len(word) > ALONE:
            ends = [found for _, found in table.walk(word)]
            out[i] = [_forward(ends, np.log(prob[:, j]).tolist())[-1] for j in range(prob.shape[1])]
    return out


def expected_counts(words: list[bytes], weight: np.ndarray, table: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in the words (``weight`` times each), one language."""
    out = np.zeros(len(table))
    for own, chars in _matrices(words):
        n, width = chars.shape
        size = (chars > 0).sum(1)
        hits = [list(table.ending(chars, end)) for end in range(1, width + 1)]
        # all sums are of probabilities times ``lift`` to the number of bytes, so that long words stay in range
        lift = _LIFT ** np.arange(table.longest + 1)
        fore = np.zeros((width + 1, n))
        fore[0] = 1
        for end in range(1, width + 1):
            for k, rows, piece in hits[end - 1]:
                fore[end, rows] += fore[end - k, rows] * prob[piece] * lift[k]
        back = np.zeros((width + 1, n))
        back[size, np.arange(n)] = 1
        for end in range(width, 0, -1):
            for k, rows, piece in hits[end - 1]:
                back[end - k, rows] += back[end, rows] * prob[piece] * lift[k]
        total = np.maximum(fore[size, np.arange(n)], 1e-300)
        for end in range(1, width + 1):
            for k, rows, piece in hits[end - 1]:
                share = fore[end - k, rows] * prob[piece] * lift[k] * back[end, rows] / total[rows] * weight[own[rows]]
                out += np.bincount(piece, weights=share, minlength=len(table))
    log_prob = np.log(prob).tolist()
    for word, times in zip(words, weight):
        if len(word) > ALONE:
            ends = [found for _, found in table.walk(word)]
            fore_log = _forward(ends, log_prob)
            back_log = [-math.inf] * len(word) + [0.0]
            for end in range(len(word), 0, -1):
                if back_log[end] == -math.inf:
                    continue
                for n, piece in ends[end - 1]:
                    here = back_log[end] + log_prob[piece]
                    out[piece] += times * math.exp(min(fore_log[end - n] + here - fore_log[-1], 0.0))
                    top, low = max(back_log[end - n], here), min(back_log[end - n], here)
                    back_log[end - n] = top + math.log1p(math.exp(low - top))
    return out


def text_words(text: bytes) -> list[str]:
    return _WORDS.findall(text.decode().lower())


def fit(labelled: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and piece probabilities (pieces x languages) from rows (doc_id, text, lang)."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 0))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))])
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found: dict[str, Counter] = {}
            for lang, t in zip(part.column(1).to_pylist(), texts, strict=True):
                found.setdefault(lang, Counter()).update(text_words(t))
            for lang, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array([w.encode() for w in c], pa.binary()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    words = cut(drawn.select("text", "lang").mapInArrow(tidy(count, keep=True), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    size = len(pieces(path))
    number = {k: i for i, k in enumerate(langs)}
    prob = np.full((size, len(langs)), 1 / size)
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], prob: np.ndarray = prob) -> Iterator[pa.RecordBatch]:
            total, table = np.zeros_like(prob), pieces(path)
            for b in batches:
                of, word, n = (b.column(i).to_pylist() for i in range(3))
                for lang in set(of):
                    own = [i for i, x in enumerate(of) if x == lang]
                    total[:, number[lang]] += expected_counts([b" " + word[i] for i in own], np.array([n[i] for i in own], dtype=float), table, prob[:, number[lang]])
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])

        counts = np.full_like(prob, SMOOTH)
        for r in words.mapInArrow(tidy(expect, keep=True), "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # pieces times languages at most
            counts[r.i, r.j] += r.n
        prob = counts / counts.sum(0)
    return langs, prob


_owner: list = [None]


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, path: str, carried: bool = False) -> DataFrame:
    """Adds (lang_pred, score) to every document; the prediction reads the column text alone."""
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast((prob, f"{path}:{hash(prob.tobytes())}"))  # pieces times languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob, name = held.value
        if _owner[0] != name:
            _owner[:] = [name, None, None]  # the last fit's words go before the new ones come
            _owner[1:] = [{}, np.zeros((KEPT, len(langs)))]
        table, (_, known, scores) = pieces(path), _owner
        for part, texts in slices(batches, "text", 1 << 20):
            total, solid = np.zeros((len(texts), max(len(langs), 1))), np.zeros(len(texts), dtype=bool)
            every = [text_words(t) for t in texts]
            solid[:] = [any(c.isalpha() for w in own for c in w) for own in every]
            if langs:
                for i, own in enumerate(every):  # long words are not kept
                    if long := [b" " + w.encode() for w in own if len(w) > LONG]:
                        every[i] = [w for w in own if len(w) <= LONG]
                        total[i] += word_scores(long, table, prob).sum(0)
                new = set().union(*every) - known.keys()
                if len(known) + len(new) > KEPT:
                    known.clear()
                    new = set().union(*every)
                if len(new) > len(scores):
                    _owner[2] = scores = np.zeros((len(new), len(langs)))
                new = sorted(new)
                if new:
                    scores[len(known) : len(known) + len(new)] = word_scores([b" " + w.encode() for w in new], table, prob)
                    known.update(zip(new, range(len(known), len(known) + len(new))))
            for i, own in enumerate(every):
                if own and langs:
                    total[i] += scores[np.fromiter(map(known.__getitem__, own), dtype=np.int64, count=len(own))].sum(0)
            best = total.argmax(1)
            post = 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1)
            if not langs:
                solid[:] = False
            own = [c for i, c in enumerate(part.columns) if i != at or carried]
            yield pa.RecordBatch.from_arrays([*own, pa.array([langs[b] if s else "und" for b, s in zip(best, solid)], pa.string()), pa.array(np.where(solid, post, 0.0))], names=[*names, "lang_pred", "score"])

    names = [c for c in docs.columns if c != "text" or carried]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(tidy(run, keep=True), schema)


def held_out() -> Column:
    """True for documents that no fit may see: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Fit on the rows that are not held out, predict all: rows (doc_id, held_out, lang_pred, score), or the
    columns ``keep`` of ``docs`` with lang_pred and score."""
    path = path or public_tokenizers.path(VOCABULARY)
    langs, prob = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), path)
    if keep:
        return predict(docs.select(*keep), langs, prob, path, carried=True)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(own, langs, prob, path).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
