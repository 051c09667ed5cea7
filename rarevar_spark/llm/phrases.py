"""Collocations: phrases of frequent words, counted without loss in quotient filters.

Texts are read and cut into words once, into shards that each have a dictionary of their own. The dictionaries are summed into word counts,
frequent words get dense ids, and shards are written anew as sequences of these ids. Phrases of two words are counted over the
sequences, then those of three whose pairs are frequent, and so on: a task counts packed ids in quotient filters, and the sorted
filters of each share of the keys are merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quotient_filter as Q
from .ordering import numbered
from .shared import keep
from .textkit import LOWER, slices, word_bounds

#: What ends a piece, and what parts words within one.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_WORD = np.ones(256, dtype=bool)
_WORD[list(PIECE_ENDS + BLANKS)] = False
_END = np.zeros(256, dtype=bool)
_END[list(PIECE_ENDS)] = True

SHARDS = "shard long, lang string, words array<string>, counts array<long>, n_words long, size long, sequence binary"
FREQUENT = "lang string, g array<long>, a long, probe array<long>"


def _squeeze(a: np.ndarray) -> bytes:
    """Numbers below 2^32 by planes of bytes, compressed."""
    return pa.compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _stretch(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=4 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, size).T).view("<u4").reshape(-1)


def cut_words(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Runs of the lower-cased words of some texts, and for each word whether a piece begins with it."""
    for _, _, raw, off in slices(texts):
        raw = LOWER[raw]
        start, end, doc = word_bounds(raw, off, _WORD)
        if not len(start):
            continue
        ends = np.concatenate([[0], np.cumsum(_END[raw])])
        opens = np.ones(len(start), dtype=bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (ends[start[1:]] > ends[end[:-1]])
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        inside = _WORD[raw]
        yield pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw[inside].tobytes())), opens


def word_shards(docs: DataFrame, words_per_shard: int = 500_000) -> DataFrame:
    """Texts as numbers of the words in a dictionary for each shard of one language; 0 stands before each piece."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list] = defaultdict(list)
        size = 0

        def shards() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, runs in held.items():
                coded = pa.concat_arrays([r[0] for r in runs]).dictionary_encode()
                opens = np.concatenate([r[1] for r in runs])
                at = coded.indices.to_numpy()
                sequence = np.zeros(len(at) + int(opens.sum()), np.int64)
                sequence[np.arange(len(at)) + np.cumsum(opens)] = at + 1
                counts = np.bincount(at, minlength=len(coded.dictionary))
                row = [first + made], [lang], [coded.dictionary.cast(pa.string())], [counts], [len(at)], [len(sequence)], [_squeeze(sequence)]
                kinds = pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(row, kinds)], [f.split()[0] for f in SHARDS.split(", ")])
                made += 1
            held.clear()

        for batch in batches:
            langs, texts = batch.column("lang"), batch.column("text")
            for lang in pc.unique(langs).to_pylist():
                for words, opens in cut_words(texts.filter(pc.equal(langs, lang))):
                    held[lang].append((words, opens))
                    size += len(words)
                    if size >= words_per_shard:
                        yield from shards()
                        size = 0
        yield from shards()

    return keep(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, SHARDS), "shards")


def frequent_words(shards: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """lang, word, f, id (dense, from 1) of every word that is frequent in its language; and shard, local, id of those in each shard's dictionary."""
    entries = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "e")).select("shard", "lang", (F.col("local") + 1).alias("local"), F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    words = entries.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = keep(words.withColumn("mark", F.monotonically_increasing_id()), "words")  # the task's number above 33 bits for the row's
    tasks = sorted(tuple(r) for r in words.groupBy(F.shiftrightunsigned("mark", 33).alias("task")).agg(F.count(F.lit(1)).alias("n")).collect())
    first, starts = 1, []
    for task, n in tasks:
        starts.append((task, first))
        first += n
    if first >= 1 << 32:
        raise ValueError("more frequent words than ids of 32 bits")
    starts = F.broadcast(words.sparkSession.createDataFrame(starts, "task long, first long"))  # a row for each task that wrote words
    words = words.withColumn("task", F.shiftrightunsigned("mark", 33)).join(starts, "task").select("lang", "word", "f", (F.col("first") + F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))
    return words, entries.join(words.select("lang", "word", "id"), ["lang", "word"]).select("shard", "local", "id")


def id_sequences(shards: DataFrame, local_ids: DataFrame) -> DataFrame:
    """lang, size, sequence: each shard with ids in the place of its own numbers, and 0 for what is not frequent or begins a piece."""
    kind = "lang string, size long, sequence binary"

    def rewrite(texts: pa.Table, ids: pa.Table) -> pa.Table:
        local, ids, out = ids.column("local").to_numpy(), ids.column("id").to_numpy(), []
        for r in texts.to_pylist():  # the one row of this shard
            sequence = _stretch(r["sequence"], r["size"])
            to = np.zeros(int(sequence.max(initial=0)) + 1, np.uint32)
            to[local] = ids
            out.append({"lang": r["lang"], "size": r["size"], "sequence": _squeeze(to[sequence])})
        return pa.Table.from_pylist(out, pa.schema([("lang", pa.string()), ("size", pa.int64()), ("sequence", pa.binary())]))

    local_ids = local_ids.toDF(*local_ids.columns)  # columns of its own, as both come from the same shards
    texts = shards.select("shard", "lang", "size", "sequence")
    return keep(texts.groupBy("shard").cogroup(local_ids.groupBy("shard")).applyInArrow(rewrite, kind), "sequences")


def _keys(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a phrase packed, 32 bits each: two in the upper half, four in both."""
    ids = [x.astype(np.uint64) for x in ids]
    half = lambda a, b: (a << np.uint64(32)) | b
    none = np.zeros(len(ids[0]), np.uint64)
    return half(ids[0], ids[1]), none if len(ids) == 2 else half(ids[2], ids[3] if len(ids) == 4 else none)


def _probes(hi: np.ndarray, lo: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a permuted key in a bitmap."""
    return (hi >> np.uint64(64 - bits)).astype(np.int64), ((hi ^ lo) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size that has both places of every frequent phrase, and rarely those of another."""
    p = F.explode("probe").alias("p")
    rows = frequent.select(p).select((F.col("p") + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("b")).collect()
    out = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["b"]), np.uint8)[: len(out) - at]
    return out


def frequent_phrases(sequences: DataFrame, n: int, least: int, shard_bits: int, shorter: DataFrame | None, bits: int = 26, most: int = 1_000_000) -> DataFrame:
    """lang, g (ids), a (count), probe of every phrase of ``n`` words that comes ``least`` times or more.

    Phrases with a part that is surely not in ``shorter`` (those of one word less) are left out before counting; the bitmap that tells has
    ``bits`` bits' places whatever the data, so that it is of bounded size, and what it lets pass wrongly is counted and found rare. A task holds
    ``most`` phrases before it hands out filters of ``2^shard_bits`` shares of the keys.
    """
    wide = n > 2
    sent = sequences.sparkSession.sparkContext.broadcast(_bitmap(shorter, bits)) if shorter is not None else None

    def phrases_of(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(sequence) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        ok = np.ones(m, dtype=bool)
        for i in range(n):
            ok &= sequence[i : i + m] > 0
        if sent is not None:
            at = np.flatnonzero(ok)
            for i in (0, 1):
                one, two = _probes(*Q.permute(*_keys([sequence[at + i + j] for j in range(n - 1)]), n - 1 > 2), bits)
                has = (sent.value[one >> 3] >> (one & 7)) & (sent.value[two >> 3] >> (two & 7)) & 1
                at = at[has.astype(bool)]
        else:
            at = np.flatnonzero(ok)
        return Q.permute(*_keys([sequence[at + j] for j in range(n)]), wide)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size = 0

        def filters() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                hi, lo = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                got = Q.split(hi, lo, None, shard_bits, wide)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array([s for s, _ in got], pa.int32()), pa.array([f for _, f in got], pa.binary())], ["lang", "share", "filter"])
            held.clear()

        for batch in batches:
            for lang, length, data in zip(*(batch.column(c) for c in ("lang", "size", "sequence"))):
                part = phrases_of(_stretch(data.as_py(), length.as_py()))
                held[lang.as_py()].append(part)
                size += len(part[0])
                if size >= most:
                    yield from filters()
                    size = 0
        yield from filters()

    def merged(table: pa.Table) -> pa.Table:
        hi, lo, a = Q.merge(list(zip(table.column("share").to_pylist(), table.column("filter").to_pylist())), wide)
        often = a >= least
        hi, lo, a = hi[often], lo[often], a[often]
        probe = np.stack(_probes(hi, lo, bits), axis=1)
        hi, lo = Q.restore(hi, lo, wide)
        low = np.uint64(0xFFFFFFFF)
        ids = np.stack([hi >> np.uint64(32), hi & low, lo >> np.uint64(32), lo & low][:n], axis=1).astype(np.int64)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
        return pa.table({"lang": pa.array(table.column("lang").to_pylist()[:1] * len(a), pa.string()), "g": lists(ids), "a": pa.array(a), "probe": lists(probe)})

    filters = sequences.mapInArrow(count, "lang string, share int, filter binary")
    return keep(filters.groupBy("lang", "share").applyInArrow(merged, FREQUENT), f"phrases{n}")


def score_phrases(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, g, a, l, r, score of the phrases that no longer one covers; the cut that scores least counts, of equal ones the first."""
    grams = phrases.select("g", "a").unionByName(words.select(F.array("id").alias("g"), F.col("f").alias("a")))
    size = F.size("g")
    cuts = phrases.select("lang", "g", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "g", "a", "k", F.expr("slice(g, 1, k)").alias("first"), F.expr("slice(g, k + 1, size(g) - k)").alias("rest"))
    cuts = cuts.join(grams.select(F.col("g").alias("first"), F.col("a").alias("l")), "first").join(grams.select(F.col("g").alias("rest"), F.col("a").alias("r")), "rest")
    # decimals, since products may pass 64 bits
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "g", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = phrases.where(size > 2).select("a", F.explode(F.array_distinct(F.expr(
        "flatten(transform(sequence(2, size(g) - 1), n -> transform(sequence(1, size(g) - n + 1), i -> slice(g, i, n))))"
    ))).alias("g"))
    covers = inner.groupBy("g").agg(F.max("a").alias("longer"))
    kept = best.join(covers, "g", "left").where(F.coalesce(100 * wide("longer") < 80 * wide("a"), F.lit(True)))
    return kept.select("lang", "g", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, words_per_share: int = 500_000, shard_words: int = 500_000) -> DataFrame:
    """The ``top`` phrases of two to ``longest`` (at most 4) words of every language, by score, count, then phrase (order of UTF-8 bytes).

    Returns lang, rank (from 1), phrase (words with a blank between), a (its count), l and r (counts of its first part and of the rest), n (words of
    the language) and score, floor(2000000 a / (l + r)) at the cut that scores least. Only phrases of ``least`` occurrences count, and none that
    stands in a longer one with four fifths of its count. Every word of every text is counted; null texts are empty, a null language is
    ``und``; repeated rows count again; texts of any length are read whole, in slices; other columns are ignored; an empty table gives no rows.
    """
    if not 2 <= longest <= 4:
        raise ValueError("longest must be 2, 3 or 4")
    shards = word_shards(docs, shard_words)
    words, local_ids = frequent_words(shards, least)
    sequences = id_sequences(shards, local_ids)
    total = shards.agg(F.sum("n_words")).first()[0] or 0
    shard_bits = max(0, (total // words_per_share).bit_length())
    found: list[DataFrame] = []
    for n in range(2, longest + 1):
        found.append(frequent_phrases(sequences, n, least, shard_bits, found[-1] if found else None))
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    scored = keep(score_phrases(phrases.drop("probe"), words), "scored")
    spelt = scored.select("g", F.posexplode("g").alias("i", "id")).join(words.select("id", "word"), "id").groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = scored.join(spelt, "g").select("lang", "phrase", "a", "l", "r", "score")
    placed = numbered(named, "lang", [F.desc("score"), F.desc("a"), "phrase"], named.columns, "rank").where(F.col("rank") < top)
    sizes = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return placed.join(sizes, "lang").select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
