"""Line dedup by pairwise alignment: common blocks of lines are deleted from the later document.

Every line that occurs in an earlier document is paired with the earliest document that has it, so the pairs of a line
are as many as its documents, and a group of copies gives one pair for each copy. Of the earlier documents that a document
meets so, the one that has most of its words is its main relative; these two are aligned on all lines they share, the others on
the lines that they have first. A line's n-th occurrence in a document counts as a line of its own, so that lines are unique
in a document and every shared line can be an anchor.
The patience diff of a pair keeps the longest run of shared lines that come in the same order in both documents, and
joins neighbours into blocks.

Long blocks don't hang on the pairing or on the order of blocks: every line opens and closes a window, the shortest run of
adjacent lines with ``block_words`` words, and a window that an earlier document has goes. Windows cover all lines of a block of that many words.
A window's n-th occurrence in a document counts as a window of its own too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep
from .textkit import BLANK_SEPARATED, list_array, mix, slices, span_hashes, word_bounds

NEWLINE = 10
ODD = 0x9E3779B97F4A7C15


def occurrences(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """How often each hash came before in its document."""
    order = np.lexsort((pos, h, doc))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(new)
    times = np.zeros(len(h), dtype=np.uint64)
    times[order] = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    return times


def block_windows(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, words: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, number of lines and hash of each window, the shortest run of adjacent lines from or up to a line that has
    ``block_words`` words; lines are in order of document and position."""
    n = len(h)
    opens = np.ones(n, dtype=bool)
    opens[1:] = (np.diff(doc) != 0) | (np.diff(pos) != 1)
    run = np.cumsum(opens)
    total = np.concatenate([[0], np.cumsum(words)])
    i = np.arange(n)
    stop = np.searchsorted(total, total[:-1] + block_words, side="left")
    begin = np.searchsorted(total, total[1:] - block_words, side="right") - 1
    forward, backward = stop <= n, begin >= 0
    forward[forward] = run[stop[forward] - 1] == run[forward]
    backward[backward] = run[begin[backward]] == run[backward]
    first, end = np.concatenate([i[forward], begin[backward]]), np.concatenate([stop[forward], i[backward] + 1])
    first, end = np.unique(np.stack([first, end]), axis=1) if len(first) else (first, end)
    with np.errstate(over="ignore"):  # a polynomial of the lines' hashes modulo 2^64
        power, inverse = np.ones(n + 1, dtype=np.uint64), np.ones(n + 1, dtype=np.uint64)
        power[1:], inverse[1:] = np.cumprod(np.full(n, ODD, dtype=np.uint64)), np.cumprod(np.full(n, pow(ODD, -1, 1 << 64), dtype=np.uint64))
        sums = np.zeros(n + 1, dtype=np.uint64)
        sums[1:] = np.cumsum(h * power[:-1])
        value = mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
        value = mix(value + occurrences(value, doc[first], pos[first]) * np.uint64(ODD))
    return first, end - first, value


def document_lines(docs: DataFrame, block_words: int = 20) -> DataFrame:
    """doc_id, pos (line number), key (hash of the line and of how often it came before), words of each line with a word, and
    windows: number of lines and hash of each window that begins there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in slices(batch.column(1)):
                if not len(raw):
                    continue
                breaks = np.flatnonzero(raw == NEWLINE)
                start = np.union1d(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]), [])
                start = start[start < len(raw)].astype(np.int64)
                stop = np.minimum(np.append(start[1:], len(raw)), len(raw))
                end = stop - (raw[stop - 1] == NEWLINE)
                doc = np.searchsorted(off, start, side="right") - 1
                # a newline at the end of a document belongs to its last line; the next start is another document's
                pos = np.searchsorted(breaks, start) - np.searchsorted(breaks, off[:-1])[doc]
                w_start, _, _ = word_bounds(raw, off, BLANK_SEPARATED)
                words = np.searchsorted(w_start, end) - np.searchsorted(w_start, start)
                some = words > 0
                start, end, doc, pos, words = (x[some] for x in (start, end, doc, pos, words))
                h = span_hashes(raw, start, end, lower=False)
                times = occurrences(h, doc, pos)
                key = mix(h + times * np.uint64(ODD))
                first, n, value = block_windows(h, doc, pos, words, block_words)
                windows = pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), pa.array(value.view(np.int64))], ["n", "window"])
                windows = list_array(windows, np.bincount(first, minlength=len(h)), windows.type)
                cols = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(words.astype(np.int32)), windows]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "pos", "key", "words", "windows"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(rows, "doc_id long, pos int, key long, words int, windows array<struct<n:int,window:long>>")


def patience(other: np.ndarray) -> np.ndarray:
    """Indices of a longest increasing run of ``other`` (positions in the earlier document, by position in the later)."""
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(other)
    for i, x in enumerate(other.tolist()):
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            last.append(i)
        else:
            tails[k], last[k] = x, i
        back[i] = last[k - 1] if k else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1], dtype=np.int64)


def aligned_lines(owner: np.ndarray, pos: np.ndarray, other: np.ndarray, rare: np.ndarray, words: np.ndarray, block_words: int) -> np.ndarray:
    """Positions to delete from one document, given its shared lines."""
    gone = []
    for o in np.unique(owner):
        mine = np.flatnonzero(owner == o)
        mine = mine[np.argsort(pos[mine])]
        mine = mine[patience(other[mine])]
        p, q = pos[mine], other[mine]
        block = np.concatenate([[0], np.cumsum((np.diff(p) != 1) | (np.diff(q) != 1))])
        counts = np.bincount(block, weights=rare[mine]) > 0
        counts |= np.bincount(block, weights=words[mine]) >= block_words
        gone.append(p[counts[block]])
    return np.unique(np.concatenate(gone)) if gone else np.zeros(0, np.int64)


def lines_to_delete(docs: DataFrame, rare_words: int = 5, block_words: int = 20, rare_share: float = 0.05) -> DataFrame:
    """doc_id and the numbers of the lines that go, for documents with any."""
    lines = keep(document_lines(docs, block_words), "lines")
    total = lines.agg(F.count_distinct("doc_id")).first()[0]
    first = lines.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    first = keep(first.where("at.doc_id < last").select("key", F.col("at.doc_id").alias("owner"), F.col("at.pos").alias("other"), "n"), "first-lines")
    # both sides come straight from tables, so that Spark can split the rows of a line that very many documents have
    known = keep(lines.drop("windows").join(first, "key"), "known")
    shared = known.where("owner < doc_id")
    met = shared.groupBy("doc_id", "owner").agg(F.sum("words").alias("words"))
    main = keep(met.groupBy("doc_id").agg(F.max_by("owner", F.struct("words", -F.col("owner"))).alias("main")), "main")
    theirs = known.select(F.col("doc_id").alias("main"), "key", F.col("pos").alias("other")).join(main.select("main").distinct(), "main", "left_semi")
    mine = known.select("doc_id", "pos", "key", "words", "n").join(main, "doc_id")
    cols = ["doc_id", "pos", "words", "n", "owner", "other"]
    aligned = mine.join(theirs, ["main", "key"]).withColumnRenamed("main", "owner").select(cols)
    shared = shared.join(main, "doc_id").where("owner != main").select(cols).unionByName(aligned)
    rare = (F.col("n") <= rare_share * total) & (F.col("words") >= rare_words)
    shared = shared.select("doc_id", F.struct("owner", "pos", "other", "words", rare.alias("rare")).alias("line"))
    by_doc = shared.groupBy("doc_id").agg(F.collect_list("line").alias("lines"))  # at most the lines of one document

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            owner, pos, other, words, rare = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            found = [aligned_lines(*(x[a:b] for x in (owner, pos, other, rare, words)), block_words) for a, b in zip(off, off[1:])]
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            cols = [batch.column(0), list_array(values.astype(np.int32), np.array([len(x) for x in found], dtype=np.int64), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "gone"])

    aligned = by_doc.mapInArrow(rows, "doc_id long, gone array<int>").select("doc_id", F.explode("gone").alias("pos"))
    gone = aligned.unionByName(repeated_windows(lines))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("gone"))  # at most the lines of one document


def repeated_windows(lines: DataFrame) -> DataFrame:
    """doc_id and pos of the lines in windows that an earlier document has; positions may come more than once."""
    at = lines.select("doc_id", "pos", F.explode("windows").alias("w")).select("doc_id", "pos", "w.n", "w.window")
    first = at.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("window", "owner")
    first = keep(first, "first-windows")
    later = at.join(first, "window").where("owner < doc_id")
    return later.select("doc_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos"))


def without_lines(text: Column, gone: Column) -> Column:
    """A text without the numbered lines, taken apart once, in time that grows with its lines alone."""
    both = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), gone.alias("gone")))
    left = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"])
    return F.transform(both, lambda s: F.array_join(F.transform(left(s), lambda i: F.get(s["lines"], i)), "\n"))[0]


def delete_repeated_lines(docs: DataFrame, rare_words: int = 5, block_words: int = 20, rare_share: float = 0.05) -> DataFrame:
    """``docs`` with the deleted lines gone from ``text``, and n_lines_removed.

    Lines are what stands between newlines, compared as they are. A block of aligned lines goes from the later document (of
    larger doc_id) if it has a rare line, one of at least ``rare_words`` words in at most the share ``rare_share`` of the
    documents with lines, or at least ``block_words`` words: lines that are short and common on their own, such as notices, stay.
    The share is the same for a table of any size. Lines without a word are in no block. Texts that lose nothing stay as they are, null ones too; a text that loses all its lines with words
    keeps its blank ones. doc_id is a key: the rows of a repeated one lose the same lines and don't count against
    each other. Other columns stay as they are (an old n_lines_removed is replaced); an empty table gives no rows.
    """
    gone = lines_to_delete(docs, rare_words, block_words, rare_share).select(F.col("doc_id").alias("gone_id_"), F.col("gone").alias("gone_"))
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id_"], "left")
    cols = [F.when(gone["gone_"].isNull(), docs["text"]).otherwise(without_lines(docs["text"], gone["gone_"])).alias("text") if c == "text" else docs[c] for c in docs.columns if c != "n_lines_removed"]
    return joined.select(*cols, F.coalesce(F.size(gone["gone_"]), F.lit(0)).alias("n_lines_removed"))
