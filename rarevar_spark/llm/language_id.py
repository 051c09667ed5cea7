"""Language identification by unigram models over a fixed vocabulary, summed over all segmentations.

A word (a run of letters, lower-cased, with a space before it) is made of vocabulary pieces in any of the ways that spell it. Per
language every piece has a probability, and the probability of a word is the sum over its segmentations of the product of
their pieces: the forward algorithm. Piece probabilities are learned by expectation maximisation on all words of a
sample of documents. The vocabulary has all single bytes, so every word has a segmentation.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep
from .textkit import prefix_hashes, span_hashes

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Pieces of a file of base64 tokens and ranks, one a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Pieces:
    """The pieces of a vocabulary that a word can have, by length: sorted hashes and the pieces' numbers."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        by_length: dict[int, list[bytes]] = {}
        for piece in vocabulary:
            if piece.removeprefix(b" ").translate(None, _SPELLING) == b"":
                by_length.setdefault(len(piece), []).append(piece)
        self.hashes, self.numbers = {}, {}
        self.maybe = np.zeros(1 << 22, dtype=bool)
        for n, pieces in by_length.items():
            raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
            h = span_hashes(raw, np.arange(len(pieces)) * n, np.arange(1, len(pieces) + 1) * n, lower=False)
            order = np.argsort(h)
            self.hashes[n], self.numbers[n] = h[order], np.array([vocabulary[x] for x in pieces], dtype=np.int64)[order]
            self.maybe[(h >> np.uint64(42)).astype(np.int64)] = True
        self.longest = max(by_length)

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of every edge of the words' segmentation lattices, and the words' lengths in bytes."""
        spelt = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
        length = np.array([len(b) for b in spelt], dtype=np.int64)
        raw = np.frombuffer(b"".join(spelt), dtype=np.uint8)
        stop = np.cumsum(length)
        word = np.repeat(np.arange(len(words)), length)
        room = stop[word] - np.arange(len(raw))  # bytes from here to the end of the word
        hash_from = prefix_hashes(raw)
        at = np.arange(len(raw))
        starts, ends, pieces = [], [], []
        for n in range(1, self.longest + 1):
            at = at[room[at] >= n]
            if not len(at):
                break
            if n not in self.hashes:
                continue
            h = hash_from(at, n)
            near = self.maybe[(h >> np.uint64(42)).astype(np.int64)]
            i, h = at[near], h[near]
            k = np.minimum(np.searchsorted(self.hashes[n], h), len(self.hashes[n]) - 1)
            ok = self.hashes[n][k] == h
            starts.append(i[ok])
            ends.append(i[ok] + n)
            pieces.append(self.numbers[n][k[ok]])
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, pieces))
        of = word[start]
        begin = (stop - length)[of]
        return of, start - begin, end - begin, piece, length


#: Bytes of lower-cased letters: small ASCII ones, and all of characters beyond ASCII.
_SPELLING = bytes([*range(97, 123), *range(128, 256)])


def _by(position: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(position, kind="stable")
    return order, np.searchsorted(position[order], np.arange(last + 2))


def log_likelihoods(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """log P(word | language) for every word, shape (words, languages).

    Words of a like length go together. Of the forward sums the last ``pieces.longest`` positions are held, and scaled before they get
    too small, so that a run of letters may have any length.
    """
    n_lang = p.shape[1]
    out = np.zeros((len(words), n_lang))
    by_length = sorted(range(len(words)), key=lambda i: len(words[i]))
    held = pieces.longest + 1
    while by_length:
        # some 40,000 letters at once, a longer run alone
        some = by_length[-max(1, min(4000, 40_000 // (len(words[by_length[-1]]) + 1))) :]
        del by_length[-len(some) :]
        of, start, end, piece, length = pieces.edges([words[i] for i in some])
        last = int(length.max())
        order, cuts = _by(end, last)
        of, start, piece = of[order], start[order] % held, piece[order]
        alpha = np.zeros((held, len(some), n_lang))
        alpha[0] = 1.0
        scale = np.zeros((len(some), n_lang))
        final = np.zeros((len(some), n_lang))
        _, ends_at = _by(length, last)
        by_end = np.argsort(length, kind="stable")
        for e in range(1, last + 1):
            k = slice(cuts[e], cuts[e + 1])
            step = alpha[start[k], of[k]] * p[piece[k]]
            now = alpha[e % held]
            for lang in range(n_lang):
                now[:, lang] = np.bincount(of[k], weights=step[:, lang], minlength=len(some))
            done = by_end[ends_at[e] : ends_at[e + 1]]
            if len(done):
                final[done] = np.log(now[done]) + scale[done]
            if e % 8 == 0 and e < last:
                most = alpha.max(axis=0)
                low = (most < 1e-100) & (most > 0)
                if low.any():
                    factor = np.where(low, most, 1.0)
                    alpha /= factor
                    scale += np.log(factor)
        out[some] = final
    return out


def expected_counts(words: list[str], weight: np.ndarray, pieces: Pieces, p: np.ndarray, letters: int = 40_000) -> np.ndarray:
    """How often each piece is expected in ``words`` by language, shape of ``p``, if word i comes ``weight[i, lang]`` times: forward and backward sums.

    Words of a like length go together, some ``letters`` letters at once.
    """
    seen = np.zeros_like(p)
    n_lang = p.shape[1]
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    while order:
        some = order[-max(1, min(2000, letters // (len(words[order[-1]]) + 1))) :]
        del order[-len(some) :]
        of, start, end, piece, length = pieces.edges([words[i] for i in some])
        last = int(length.max())
        (ahead, ahead_cuts), (back, back_cuts) = _by(end, last), _by(start, last)
        every = np.arange(len(length))
        alpha = np.zeros((len(length), last + 1, n_lang))
        beta = np.zeros_like(alpha)
        alpha[:, 0] = 1.0
        beta[every, length] = 1.0
        low, high = np.zeros((len(length), last + 1, n_lang)), np.zeros((len(length), last + 1, n_lang))  # logarithms that the sums are scaled by

        def add(to: np.ndarray, scale: np.ndarray, k: np.ndarray, at: np.ndarray, other: np.ndarray, place: int) -> None:
            """Sums over edges ``k`` into position ``place``, scaled by the largest of their other ends."""
            base = np.full((len(length), n_lang), -np.inf)
            np.maximum.at(base, of[k], scale[of[k], other[k]])
            base[~np.isfinite(base)] = 0.0
            step = to[of[k], other[k]] * p[piece[k]] * np.exp(scale[of[k], other[k]] - base[of[k]])
            sums = np.stack([np.bincount(of[k], weights=step[:, lang], minlength=len(length)) for lang in range(n_lang)], axis=1)
            new = np.unique(of[k])
            factor = np.where(sums[new] > 0, sums[new], 1.0)
            to[new, place], scale[new, place] = sums[new] / factor, base[new] + np.log(factor)

        for e in range(1, last + 1):
            add(alpha, low, ahead[ahead_cuts[e] : ahead_cuts[e + 1]], end, start, e)
        for i in range(last - 1, -1, -1):
            add(beta, high, back[back_cuts[i] : back_cuts[i + 1]], start, end, i)
        total = low[every, length]  # alpha is 1 there
        share = alpha[of, start] * p[piece] * beta[of, end] * np.exp(low[of, start] + high[of, end] - total[of]) * weight[some][of]
        for lang in range(n_lang):
            seen[:, lang] += np.bincount(piece, weights=share[:, lang], minlength=len(p))
    return seen


def learn_pieces(counts: dict[tuple[str, str], int], languages: list[str], vocabulary: dict[bytes, int], rounds: int = 4, smoothing: float = 0.01) -> np.ndarray:
    """Piece probabilities, shape (pieces, languages), by expectation maximisation on word counts per language."""
    size = max(vocabulary.values()) + 1
    pieces, p = Pieces(vocabulary), np.full((size, len(languages)), 1.0 / size)
    words = sorted({w for _, w in counts})
    weight = np.array([[counts.get((lang, w), 0) for lang in languages] for w in words], dtype=float).reshape(len(words), len(languages))
    for _ in range(rounds):
        p = _maximised(expected_counts(words, weight, pieces, p), smoothing)
    return p


def _maximised(seen: np.ndarray, smoothing: float) -> np.ndarray:
    return (seen + smoothing) / (seen.sum(axis=0) + smoothing * len(seen))


def train(docs: DataFrame, vocabulary: dict[bytes, int], documents_per_language: int = 1000, rounds: int = 4, smoothing: float = 0.01, stretch: int = 2048) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from the text and lang of ``docs``.

    Counts all words of about ``documents_per_language`` documents of each language, chosen by a hash of doc_id; a run of more than
    ``stretch`` letters counts as stretches of so many. Each round of expectation maximisation sums the expected counts in tasks over the
    words; the driver gets a number for each piece and language.
    """
    rows = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not languages:
        return [], np.zeros((0, 0))
    chosen = rows.join(F.broadcast(sizes), "lang")  # a row for each language
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1).cast("double") / F.lit(float(1 << 63))
    chosen = chosen.where(place * F.col("n") < F.lit(float(documents_per_language))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n.update((lang, w[i : i + stretch]) for w in words_of(text) for i in range(0, len(w), stretch))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in n], pa.string()), "word": pa.array([k[1] for k in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    counts = keep(chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    size, sc = max(vocabulary.values()) + 1, docs.sparkSession.sparkContext
    p = np.full((size, len(languages)), 1.0 / size)
    for _ in range(rounds):
        sent = sc.broadcast((languages, vocabulary, p))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            languages, vocabulary, p = sent.value
            pieces, seen = Pieces(vocabulary), np.zeros_like(p)
            number = {lang: i for i, lang in enumerate(languages)}
            for batch in batches:
                lang, word, n = (batch.column(i).to_pylist() for i in range(3))
                words = sorted(set(word))
                row = {w: i for i, w in enumerate(words)}
                weight = np.zeros((len(words), len(languages)))
                for x, w, k in zip(lang, word, n):
                    weight[row[w], number[x]] = k
                if words:
                    seen += expected_counts(words, weight, pieces, p)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.reshape(-1)[at])], ["cell", "seen"])

        sums = counts.mapInArrow(expect, "cell long, seen double").groupBy("cell").agg(F.sum("seen").alias("seen")).toArrow()  # a row for each piece and language at most
        seen = np.zeros(size * len(languages))
        seen[sums.column("cell").to_numpy()] = sums.column("seen").to_numpy()
        p = _maximised(seen.reshape(size, len(languages)), smoothing)
    return languages, p


def identify(docs: DataFrame, languages: list[str], p: np.ndarray, vocabulary: dict[bytes, int], cached_words: int = 300_000) -> DataFrame:
    """doc_id, lang_pred and score (probability of lang_pred among the languages, each as likely beforehand).

    The whole text counts, every word as often as it comes. ``und`` with score 0 where the text is null or has no letter, or no
    language was learned. Ties go to the language first by name. Repeated rows are scored each; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((languages, p, vocabulary))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, p, vocabulary = sent.value
        pieces = Pieces(vocabulary)
        cache: dict[str, int] = {}
        known = np.zeros((cached_words, max(len(languages), 1)))
        for batch in batches:
            pred, score = [], []
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 128):
                parts = [words_of(t) if t else [] for t in texts.slice(lo, 128).to_pylist()]
                new = {w for ws in parts for w in ws if w not in cache} if languages else set()
                if len(cache) + len(new) > len(known):
                    cache.clear()
                    new = {w for ws in parts for w in ws}
                    if len(new) > len(known):
                        known = np.zeros((len(new), len(languages)))
                if new:
                    fresh = list(new)
                    known[len(cache) : len(cache) + len(fresh)] = log_likelihoods(fresh, pieces, p)
                    cache.update(zip(fresh, range(len(cache), len(cache) + len(fresh))))
                for ws in parts:
                    if not languages or not any(c.isalpha() for w in ws for c in w):
                        pred.append(UNDETERMINED)
                        score.append(0.0)
                        continue
                    total = known[[cache[w] for w in ws]].sum(axis=0)
                    e = np.exp(total - total.max())
                    best = int(np.argmax(e))
                    pred.append(languages[best])
                    score.append(float(e[best] / e.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(rows, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """True for the documents that no language is learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def language_of(docs: DataFrame, vocabulary_path: str, documents_per_language: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; languages are learned from those that are not held out."""
    vocabulary = read_vocabulary(vocabulary_path)
    languages, p = train(docs.where(~held_out()), vocabulary, documents_per_language)
    return identify(docs, languages, p, vocabulary).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocabulary_path: str, least_score: float = 0.5) -> DataFrame:
    """``docs`` without the documents whose language is undetermined or has a score under ``least_score``."""
    rejected = language_of(docs, vocabulary_path).where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < least_score))
    rejected = rejected.select(F.col("doc_id").alias("reject_id_")).distinct()
    return docs.join(rejected, docs["doc_id"].cast("long") == rejected["reject_id_"], "left_anti")
