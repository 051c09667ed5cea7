"""Best-fit packing of token sequences: length patterns fitted by non-negative least squares.

Tokenizing and placing run on Spark over all documents. The driver sees the histogram of
piece lengths alone (at most ``capacity`` rows whatever the input) and answers with patterns,
each a few lengths and a repeat count; documents of a length are numbered in parallel and
take the slots of their length in turn.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import keep

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: A part a line: a word of Latin letters that are their own normal form, and the signs behind it, which these tokenizers take apart; or anything else.
PARTS = re.compile("^(?:([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-&(-/:-@\\[-`{-~]*)|.*)$", re.MULTILINE)
#: ASCII letters in lower case, and a blank for a tab and a newline.
PLAIN_BYTES = bytes(32 if b in (9, 10) else b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD_END = "\0"


def word_ranks(vocabulary: str) -> tuple[dict[bytes, int], np.ndarray] | None:
    """The merges of a lower-casing BPE file with an end-of-word suffix as (bytes: rank), and the id of each rank.

    The end of a word is a byte of its own that joins the last letter before all other merges. Ranks give the ids of
    the merges if every token comes out of its own symbols alone as one token; the tests check that for the file. None for files of another form.
    """
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not end or model.get("dropout"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; others follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    made = {"".join(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    ranks, ids = {}, {}
    for token, i in model["vocab"].items():
        core = token.removesuffix(end)
        if not all(c in byte for c in core):
            continue
        key = bytes(byte[c] for c in core)
        if token in made:
            rank = 512 + made[token]
        elif len(core) == 1:
            rank = key[0] + (256 if core == token else 0)  # a letter and the end of its word come together first
        else:
            continue
        ranks[key + (b"" if core == token else WORD_END.encode())] = rank
        ids[rank] = i
    back = np.zeros(max(ranks.values(), default=0) + 1, dtype="<u4")
    back[list(ids)] = list(ids.values())
    return ranks, back


class PartEncoder:
    """Ids, as little-endian bytes, of the blank-separated parts of texts; encodes each part once while it is remembered.

    The vocabulary is lower-case. A part that is a plain word with signs behind it has the ids of the word and those of the signs. New words
    are encoded many in one call by ranks of the same merges, all other parts by the tokenizer itself.
    """

    def __init__(self, vocabulary: str, remembered: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary)
        self.remembered = remembered
        self.parts: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.words = None
        if found := word_ranks(vocabulary):
            ranks, self.ids = found
            self.words = tiktoken.Encoding("words", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens={})
            self.last = np.zeros(len(self.ids), dtype=bool)
            self.last[[r for t, r in ranks.items() if t.endswith(WORD_END.encode())]] = True

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of plain lower-cased words."""
        out: list[bytes] = []
        for s in range(0, len(words), 10_000):
            ranks = np.array(self.words.encode_ordinary(WORD_END.join(words[s : s + 10_000]) + WORD_END), dtype=np.int64)
            ids, cut = self.ids[ranks].tobytes(), (4 * (np.flatnonzero(self.last[ranks]) + 1)).tolist()
            out += [ids[i:j] for i, j in zip([0, *cut], cut)]
        return out

    def _any(self, parts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(parts, add_special_tokens=False) if parts else []
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def learn(self, new: list[bytes]) -> None:
        if not new:
            return
        lines = b"\n".join(new).decode("utf-8", "surrogatepass")
        split = PARTS.findall(lines.lower()) if self.words else [("", "")] * len(new)
        other = [p for p, (w, _) in zip(new, split) if not w]
        self.parts.update(zip(other, self._any([p.decode("utf-8", "surrogatepass") for p in other])))
        signs = {s for _, s in split} - {""}
        if len(self.signs) + len(signs) > 10_000:
            self.signs.clear()
        fresh = list(signs - self.signs.keys())
        self.signs.update(zip(fresh, self._any(fresh)))
        words = list({w for w, _ in split if w})
        ids, known = dict(zip(words, self._words(words))), self.signs
        self.parts.update([(p, ids[w] + known[s] if s else ids[w]) for p, (w, s) in zip(new, split) if w])

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text, given as UTF-8."""
        split = [t.translate(PLAIN_BYTES).split(b" ") for t in texts]
        words = set().union(*split)
        new = words.difference(self.parts)
        if len(self.parts) + len(new) > self.remembered:
            self.parts.clear()
            new = words
        self.learn(list(new))
        get = self.parts.__getitem__
        for ps in split:
            yield b"".join(map(get, ps))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, remembered: int = 400_000) -> DataFrame:
    """Each document's token ids plus ``end_id``, cut into pieces of at most ``capacity``.

    ``vocabulary`` is the path of a lower-casing tokenizers file whose pre-tokens never span white space, so that a
    text's ids are those of its blank-separated parts in turn; a task remembers the ids of at most
    ``remembered`` parts. Null text counts as empty: one piece of the end id.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PartEncoder(vocabulary, remembered)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for lo in range(0, batch.num_rows, 256):
                texts = [x or b"" for x in batch.column(1).slice(lo, 256).cast(pa.binary()).to_pylist()]
                for doc_id, ids in zip(batch.column(0).slice(lo, 256).to_pylist(), encoder.encode(texts)):
                    ids += end
                    for i, s in enumerate(range(0, len(ids) // 4, capacity)):
                        cut = ids[4 * s : 4 * (s + capacity)]
                        rows.append((doc_id, i, s, len(cut) // 4, zlib.crc32(cut)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares by multiplicative steps, for matrices without negative entries."""
    x = np.full(a.shape[1], b.sum() / max(a.sum(), 1.0))
    atb = a.T @ b
    for _ in range(steps):
        x *= atb / np.maximum(a.T @ (a @ x), 1e-12)
    return x


def _coarse_patterns(n_bins: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` bin sizes 1..n_bins that fill n_bins exactly."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], rest: int, least: int) -> None:
        if rest >= least:
            out.append(head + (rest,))
        if len(head) + 2 <= depth:
            for s in range(least, rest // 2 + 1):
                grow(head + (s,), rest - s, s)

    grow((), n_bins, 1)
    return out


def fit_patterns(histogram: dict[int, int], capacity: int, bins: int = 64, depth: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with repeat counts that hold every piece of ``histogram``.

    Lengths are put into ``bins`` classes, the classes' counts are fitted by patterns of at most
    ``depth`` classes that fill a sequence, and the fitted counts are rounded down; within its class the
    longest remaining lengths go first. What is left goes, longest first, into the open pattern with the
    least room that still holds it, or opens a new one. All steps work on counts of equal lengths, so the work depends
    on ``capacity`` alone.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    done: Counter[tuple[int, ...]] = Counter()
    if capacity in left:
        done[(capacity,)] += left.pop(capacity)
    if not left:
        return sorted(done.items())
    bins = max(1, min(bins, capacity))
    width = -(-capacity // bins)
    bins = -(-capacity // width)
    patterns = _coarse_patterns(bins, depth)
    a = np.zeros((bins, len(patterns)))
    for j, p in enumerate(patterns):
        for s in p:
            a[s - 1, j] += 1
    of_bin: dict[int, list[int]] = {}
    for n in sorted(left):  # a length counts as the class nearest to it, so that real sums scatter about the capacity
        of_bin.setdefault(min(bins, max(1, round(n / width))), []).append(n)
    b = np.array([float(sum(left[n] for n in of_bin.get(s + 1, ()))) for s in range(bins)])
    used = b > 0
    ok = [j for j in range(len(patterns)) if all(used[s - 1] for s in patterns[j])]
    repeats = np.floor(nnls(a[:, ok], b)).astype(np.int64) if ok else np.zeros(0, np.int64)

    open_by_room: dict[int, Counter[tuple[int, ...]]] = {}
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], count: int) -> None:
        room = capacity - sum(pattern)
        if room not in open_by_room:
            open_by_room[room] = Counter()
            bisect.insort(rooms, room)
        open_by_room[room][pattern] += count

    for r, j in sorted(zip(repeats.tolist(), ok), reverse=True):
        while r > 0:
            chosen: list[int] = []
            taken: Counter[int] = Counter()
            for s in sorted(patterns[j], reverse=True):
                fits = [n for n in of_bin.get(s, ()) if left.get(n, 0) > taken[n] and sum(chosen) + n <= capacity]
                if not fits:
                    break
                chosen.append(fits[-1])
                taken[fits[-1]] += 1
            if len(chosen) < len(patterns[j]):
                break
            times = min([r, *(left[n] // c for n, c in taken.items())])
            for n, c in taken.items():
                left[n] -= c * times
            put(tuple(sorted(chosen, reverse=True)), times)
            r -= times

    for n in sorted((n for n, c in left.items() if c), reverse=True):
        c = left[n]
        while c:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                per = capacity // n
                whole, rest = divmod(c, per)
                if whole:
                    put((n,) * per, whole)
                if rest:
                    put((n,) * rest, 1)
                break
            room = rooms[i]
            group = open_by_room[room]
            pattern, have = next(iter(group.items()))
            times = min(have, c)
            group[pattern] -= times
            if not group[pattern]:
                del group[pattern]
            if not group:
                del open_by_room[room]
                rooms.pop(i)
            put(pattern + (n,), times)
            c -= times
    for group in open_by_room.values():
        done.update(group)
    return sorted(done.items())


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) for every slot of every pattern."""
    out, first, rank = [], 0, Counter()
    for pattern, times in patterns:
        at = 0
        for n in pattern:
            out.append((n, rank[n], times, first, at))
            rank[n] += times
            at += n
        first += times
    return out


def place(pieces: DataFrame, capacity: int = 4096, rows_per_rank_task: int = 20_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces with ``length`` in 1..capacity.

    Pieces of one length are interchangeable. They are ranked in shares of about ``rows_per_rank_task``
    rows (a length that very many pieces have is split over many tasks), and a rank says which slot to take.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    shares = max(1, -(-total // rows_per_rank_task))
    salted = pieces.withColumn("share_", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)).cast("int"))
    per = salted.groupBy("length", "share_").agg(F.count(F.lit(1)).alias("n_"))
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n_").alias("n")).collect()}
    slots = _slots(fit_patterns(histogram, capacity))
    by_length = Window.partitionBy("length").orderBy("share_")
    starts = per.select("length", "share_", (F.sum("n_").over(by_length) - F.col("n_")).alias("before_"))
    rank = F.row_number().over(Window.partitionBy("length", "share_").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("rank_", rank).join(starts, ["length", "share_"]).withColumn("rank_", F.col("rank_") + F.col("before_"))
    # Slots in order of length and first rank. Their number depends on the histogram's lengths, not on the pieces: each step
    # of the fit uses up a length or a pattern, so that they are a few for each length up to the capacity.
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(((table[:, 0] << 40) + table[:, 1], table[:, 1], table[:, 3], table[:, 4]))
    own = [f.name for f in pieces.schema]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset = sent.value
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("rank_").to_numpy()
            at = np.searchsorted(key, (n.astype(np.int64) << 40) + r, side="right") - 1
            cols = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence[at] + r - first[at]), pa.array(offset[at])], [*own, "sequence_id", "offset"])

    return ranked.select(*own, "rank_").mapInArrow(rows, StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack every document into as few sequences of ``capacity`` tokens as the fit reaches.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer than
    ``capacity`` are cut. Null and empty texts are one piece that holds the end id; repeated rows are
    packed as often as they come; other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    pieces = keep(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
