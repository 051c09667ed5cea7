"""Removal of byte strings that an earlier document has as well, by suffix grouping in bounded pieces.

A byte goes if a string of ``span`` bytes covers it that also starts in a document of smaller doc_id.

Texts are cut at content: of the grams (``gram_bytes(span)`` bytes) inside a string, the one of least hash is its anchor, so equal strings
have equal anchors. The strings of one anchor stand next to each other and make a piece, of which a document has one for
every dozen bytes. Only pieces whose gram is also in another text are looked at; texts that are equal as a whole are one from the
start. Such pieces meet by their gram in one task, which orders the suffixes of the unequal ones by linear grouping (``suffix_order``) and
compares neighbours in that order, symbol by symbol: no decision hangs on a hash. What many documents have is settled before each
shuffle: of a gram that several texts of a batch have two witnesses travel, and of equal pieces of a batch the first document's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep
from .textkit import _R, _R_INV, _power, mix, prefix_hashes, slices

SPAN = 50
#: Bits that name a text or a gram where they are only looked for; what is found is compared as bytes.
NAME_BITS = 48
#: Symbols that are ordered at once, and bytes of text whose grams are compared before they are sent.
ORDERED, BATCH_BYTES = 1 << 16, 1 << 25


def gram_bytes(span: int) -> int:
    """Shorter grams give fewer pieces, and more of them meet by chance."""
    return max(1, span * 2 // 5)


def pieces(raw: np.ndarray, off: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Document, first string, number of strings, place of the gram and name of the gram (of ``NAME_BITS``) of each piece."""
    gram, n = gram_bytes(span), len(raw)
    if n < span:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    total = np.zeros(n + 1, dtype=np.uint64)
    body = raw.astype(np.uint64) + np.uint64(1)
    body *= _power(_R, n)[:n]
    np.cumsum(body, out=total[1:])
    h = total[gram:] - total[:-gram]
    h *= _power(_R_INV, n + 1)[: len(h)]
    h = mix(h)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
    width, wide = span - gram + 1, 1
    while wide < width:
        step = min(wide, width - wide)
        least = np.minimum(least[:-step], least[step:])
        wide += step
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    whole = doc[: len(anchor)] == doc[span - 1 :]  # strings don't cross documents
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (doc[1 : len(anchor)] != doc[: len(anchor) - 1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(anchor)))
    first, count = first[whole[first]], count[whole[first]]
    return doc[first], first, count, anchor[first], (h[anchor[first]] >> np.uint64(64 - NAME_BITS)).view(np.int64)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of ``symbols`` in order, by linear grouping; the last symbol is smaller than all others.

    Groups of suffixes with a common Lyndon prefix are taken in descending order. A suffix's pointer goes to the nearest one before it in a lower
    group; those pointed at leave their group for a new one right above it, the more pointers the higher. Afterwards every group's
    place is known, and a walk in ascending order, from each suffix to the one before it and along the pointers, fills the groups.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    begin = np.flatnonzero(np.diff(symbols[order], prepend=-1))
    bounds = np.append(begin, n)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(np.arange(len(begin)), np.diff(bounds))
    # suffixes are numbered from 1; 0 is none, never done and always put
    group, start, size = [0, *rank.tolist()], begin.tolist(), np.diff(bounds).tolist()
    numbered = (order + 1).tolist()
    members: list = [numbered[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]  # a group of one that was split off is its number
    ending = [0] * (n + 1)  # the group that ends there
    for g, e in enumerate(bounds[1:].tolist()):
        ending[e] = g
    back, done = [0] * (n + 1), bytearray(n + 1)
    groups, end = len(start), n
    while end:
        g = ending[end]
        own = members[g]
        if size[g] == 1:
            i = own if own.__class__ is int else own[0] if len(own) == 1 else next(i for i in own if group[i] == g)
            end -= 1
            done[i] = 1
            p = i - 1
            while done[p]:
                p = back[p]
            back[i] = p
            if p:
                q = group[p]
                left = size[q] - 1
                if left:
                    size[q] = left
                    left += start[q]
                    start.append(left)
                    size.append(1)
                    members.append(p)
                    group[p] = ending[left + 1] = groups
                    ending[left] = q
                    groups += 1
            continue
        if len(own) != size[g]:
            own = [i for i in own if group[i] == g]
        end = start[g]
        own.sort()
        times: dict[int, int] = {}
        for i in own:
            done[i] = 1
            p = i - 1
            while done[p]:
                p = back[p]
            back[i] = p
            if p:
                times[p] = times.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            moved.setdefault((-k, group[p]), []).append(p)
        for (_, q), some in sorted(moved.items()) if len(moved) > 1 else moved.items():
            left = size[q] - len(some)
            if not left:  # all that is left of the group
                continue
            stop = start[q] + size[q]
            size[q] = left
            left += start[q]
            start.append(left)
            size.append(len(some))
            members.append(some)
            ending[stop], ending[left] = groups, q
            for p in some:
                group[p] = groups
            groups += 1
    out, free, put = [0] * n, start, bytearray(n + 1)
    out[0], put[n], put[0] = n, 1, 1
    for i in range(n):
        p = out[i] - 1
        while not put[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            put[p] = 1
            p = back[p]
    return np.array(out, dtype=np.int64) - 1


def _first_holders(texts: list[bytes], at: np.ndarray, count: np.ndarray, holder: np.ndarray, span: int) -> np.ndarray:
    """For every string of distinct pieces (``at``: place of the gram, ``count``: number of strings) the least ``holder`` of a piece that has it."""
    gram = gram_bytes(span)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, gram)[off[:-1] + at]).view(f"S{gram}").ravel()
    _, gram_id, alike = np.unique(grams, return_inverse=True, return_counts=True)
    first = np.repeat(holder, count)
    string_of = np.cumsum(count) - count
    many = np.flatnonzero(alike[gram_id] > 1)  # a piece alone with its gram has nothing to be ordered with
    if not len(many):
        return first
    # Strings of unequal hashes are unequal: of a piece only the stretch between strings whose hash comes again is ordered.
    piece = np.repeat(np.arange(len(many)), count[many])
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
    _, same, times = np.unique(prefix_hashes(raw)(off[many][piece] + nth, span), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[same] > 1)
    if not len(again):
        return first
    low, high = np.full(len(many), span), np.full(len(many), -1)
    np.minimum.at(low, piece[again], nth[again])
    np.maximum.at(high, piece[again], nth[again])
    some = high >= 0
    many, low, strings = many[some], low[some], (high - low + 1)[some]
    place = at[many] - low
    # each piece: bytes before the gram, the gram as one symbol, bytes after it, an end of its own
    n = strings + span - gram + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(np.arange(len(many)), n)
    k = np.arange(begin[-1]) - begin[of]
    source = np.minimum((off[many] + low)[of] + np.where(k <= place[of], k, k + gram - 1), len(raw) - 1)
    symbols = raw[source].astype(np.int64) + len(many) + 1
    symbols[begin[:-1] + place] = gram_id[many] + len(many) + 257
    symbols[begin[1:] - 1] = len(many) - np.arange(len(many))
    is_start = k < strings[of]
    order = suffix_order(symbols)
    order = order[is_start[order]]
    depth = span - gram + 1
    heads = np.lib.stride_tricks.sliding_window_view(symbols, depth)
    new = np.ones(len(order), dtype=bool)
    for a in range(1, len(order), 1 << 14):
        x = order[a - 1 : a + (1 << 14)]
        new[a : a + len(x) - 1] = (heads[x[1:]] != heads[x[:-1]]).any(axis=1)
    cut = np.flatnonzero(new)
    least = np.minimum.reduceat(holder[many][of[order]], cut)
    first[(string_of[many] + low)[of[order]] + k[order]] = np.repeat(least, np.diff(np.append(cut, len(order))))
    return first


def solve(doc: np.ndarray, count: np.ndarray, at: np.ndarray, texts: list[bytes], span: int, most: int = 64 * ORDERED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end (exclusive, in the piece) of runs of bytes that go, among the pieces of some grams.

    Where unequal pieces have more than ``most`` bytes (very many near copies of one place), their strings are
    dealt to several orders by a hash of the string.
    """
    index: dict[bytes, int] = {}
    kind = np.array([index.setdefault(t, len(index)) for t in texts], dtype=np.int64)
    holder = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(holder, kind, doc)
    one = np.empty(len(index), dtype=np.int64)
    one[kind] = np.arange(len(kind))
    distinct = list(index)
    size = sum(map(len, distinct))
    offset = np.concatenate([[0], np.cumsum(count[one])])
    if size <= most:
        first = _first_holders(distinct, at[one], count[one], holder, span)
    else:
        shares: dict[int, tuple[dict[bytes, int], list[int], list[int]]] = defaultdict(lambda: ({}, [], []))
        gram = gram_bytes(span)
        parts = int(size * (span - gram) // most) + 1
        for p, t in enumerate(distinct):
            for w in range(int(count[one[p]])):
                s = t[w : w + span]
                strings, of, place = shares[hash(s) % parts]
                of.append(strings.setdefault(s, len(strings)))
                place.append(int(offset[p]) + w)
        first = np.empty(int(offset[-1]), dtype=np.int64)
        string_at = np.repeat(at[one], count[one]) - (np.arange(offset[-1]) - np.repeat(offset[:-1], count[one]))
        string_holder = np.repeat(holder, count[one])
        for strings, of, place in shares.values():
            of, place = np.array(of), np.array(place)
            least = np.full(len(strings), np.iinfo(np.int64).max)
            np.minimum.at(least, of, string_holder[place])
            where = np.empty(len(strings), dtype=np.int64)
            where[of] = string_at[place]
            first[place] = _first_holders(list(strings), where, np.ones(len(strings), dtype=np.int64), least, span)[of]
    n = count
    row = np.repeat(np.arange(len(doc)), n)
    w = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    gone = np.flatnonzero(first[offset[kind][row] + w] < doc[row])
    if not len(gone):
        return gone, gone, gone
    row, pos = row[gone], w[gone]
    opens = np.ones(len(gone), dtype=bool)
    opens[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
    head = np.flatnonzero(opens)
    tail = np.append(head[1:], len(gone)) - 1
    return row[head], pos[head], pos[tail] + span


def _data(docs: DataFrame) -> DataFrame:
    """doc_id, t (the first bits of the text's SHA-256, as a name of the text), sha and b (bytes)."""
    b = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), b.alias("b")).withColumn("sha", F.sha2("b", 256))
    data = data.withColumn("t", F.conv(F.substring("sha", 1, NAME_BITS // 4), 16, 10).cast("long"))
    return data.select("doc_id", "t", F.unhex("sha").alias("sha"), "b")


def shared_grams(data: DataFrame, span: int) -> DataFrame:
    """t and h for the pieces of a text whose gram another text has too.

    In a batch, a gram that several texts have is known to be shared: these rows go by their text, and two of the
    texts as witnesses by the gram; the others go by the gram.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(t: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((t, h))
            t, h = t[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            t, h = t[new], h[new]
            opens = np.ones(len(h), dtype=bool)
            opens[1:] = h[1:] != h[:-1]
            begin = np.flatnonzero(opens)
            end = np.append(begin[1:], len(h))
            known = np.repeat(end - begin > 1, end - begin)
            last = end[end - begin > 1] - 1
            k = np.concatenate([h[begin], h[last], t[known]])
            v = np.concatenate([t[begin], t[last], h[known]])
            own = np.zeros(len(k), dtype=bool)
            own[len(k) - int(known.sum()) :] = True
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(own)], ["k", "v", "known"])

        ts, hs, held = [], [], 0
        for batch in batches:
            t = batch.column(0).to_numpy()
            for i, _, raw, off in slices(batch.column(1)):
                doc, _, _, _, h = pieces(raw, off, span)
                ts.append(t[i:][doc])
                hs.append(h)
                held += len(raw)
                if held >= BATCH_BYTES:
                    yield flush(np.concatenate(ts), np.concatenate(hs))
                    ts, hs, held = [], [], 0
        if ts:
            yield flush(np.concatenate(ts), np.concatenate(hs))

    by_key = Window.partitionBy("k")
    sent = data.where(F.length("b") >= span).select("t", "b").mapInArrow(rows, "k long, v long, known boolean")
    sent = sent.withColumns({"least": F.min("v").over(by_key), "most": F.max("v").over(by_key)}).where("known or least < most")
    return sent.select(F.when(F.col("known"), F.col("k")).otherwise(F.col("v")).alias("t"), F.when(F.col("known"), F.col("v")).otherwise(F.col("k")).alias("h"))


PIECES = "k int, doc_id long, t long, starts array<int>, n int, place int, piece binary"


def _shared_pieces(span: int):
    """Function of (doc_id, t, b, hs) to the pieces with a gram in hs, each once for a document with all its starts; of equal ones in a batch
    only the first document's, the others are settled: without a piece, n is the number of bytes that go."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())
            ids, ts, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            bound = np.concatenate([[0], np.cumsum(size)])
            held: dict[bytes, tuple] = {}
            out: list[tuple] = []
            for i, j, raw, off in slices(batch.column(2)):
                doc, first, count, anchor, h = pieces(raw, off, span)
                own = lambda h, d: h.view(np.uint64) ^ mix(d.astype(np.uint64) + np.uint64(1))
                ok = np.isin(own(h, doc), own(flat[bound[i] : bound[j]], np.repeat(np.arange(j - i), size[i:j])))
                text = raw.tobytes()
                for d, a, n, x, k in zip(doc[ok].tolist(), first[ok].tolist(), count[ok].tolist(), anchor[ok].tolist(), (h[ok] >> (NAME_BITS - 31)).tolist()):
                    piece = text[a : a + n + span - 1]
                    begin = int(off[d])
                    row = (k, int(ids[i + d]), int(ts[i + d]), [a - begin], n, x - a, piece)
                    seen = held.setdefault(piece, row)
                    if seen is row:
                        continue
                    if seen[1:3] == row[1:3]:
                        seen[3].append(a - begin)
                        continue
                    if row[1] < seen[1]:
                        held[piece], row = row, seen
                    # rows of one doc_id are not judged against each other
                    out.append(row if row[1] == held[piece][1] else (row[2] & 0x7FFFFFFF, row[1], row[2], row[3], row[4] + span - 1, 0, None))
            out += held.values()
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=x) for c, x in zip(cols, kinds)], ["k", "doc_id", "t", "starts", "n", "place", "piece"])

    return rows


RUNS = "doc_id long, t long, begin int, end int"


def _runs(span: int):
    """Function of pieces, in order of k, to runs of bytes that go."""

    def at_starts(table: pa.Table, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        """Runs inside pieces, at every start of their pieces."""
        lists = table.column("starts").combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        again = np.repeat(np.arange(len(row)), size[row])
        k = np.arange(len(again)) - np.repeat(np.cumsum(size[row]) - size[row], size[row])
        start = lists.flatten().to_numpy()[first[row][again] + k]
        doc, t = table.column("doc_id").to_numpy()[row][again], table.column("t").to_numpy()[row][again]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(t), pa.array((start + begin[again]).astype(np.int32)), pa.array((start + end[again]).astype(np.int32))], ["doc_id", "t", "begin", "end"])

    def found(table: pa.Table) -> pa.RecordBatch:
        doc, n, at = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "n", "place"))
        return at_starts(table, *solve(doc, n, at, table.column("piece").to_pylist(), span))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            open_ = pa.compute.is_valid(table.column("piece"))
            settled = table.filter(pa.compute.invert(open_))
            if settled.num_rows:
                row = np.arange(settled.num_rows)
                yield at_starts(settled, row, np.zeros(len(row), dtype=np.int64), settled.column("n").to_numpy())
            table = table.filter(open_)
            k = table.column("k").to_numpy()
            weight = np.cumsum(pa.compute.binary_length(table.column("piece")).to_numpy())
            opens = np.flatnonzero(np.diff(k, prepend=held[-1].column("k")[-1].as_py() if held else k[:1] - 1))
            cut = 0
            for o in opens.tolist():  # a gram's pieces stay together
                before = int(weight[o - 1]) if o else 0
                if size + before - (int(weight[cut - 1]) if cut else 0) >= ORDERED:
                    yield found(pa.concat_tables([*held, table.slice(cut, o - cut)]))
                    held, size, cut = [], 0, o
            if cut < table.num_rows:
                held.append(table.slice(cut))
                size += int(weight[-1]) - (int(weight[cut - 1]) if cut else 0)
        if held:
            yield found(pa.concat_tables(held))

    return rows


def removed_runs(data: DataFrame, span: int) -> DataFrame:
    """doc_id, t and runs (array of begin, end; they may overlap) of the bytes to remove, for texts with any; of ``_data``."""
    ids = data.select("doc_id", "t", "sha", F.length("b").alias("size"))
    texts = ids.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("t").alias("t"))
    copies = ids.where(F.col("size") >= span).join(texts.where("first < last").select("sha", "first"), "sha").where("doc_id > first")
    whole = copies.select("doc_id", "t", F.lit(0).alias("begin"), F.col("size").alias("end")).distinct()
    grams = shared_grams(data, span).groupBy("t").agg(F.collect_list("h").alias("hs"))  # at most the pieces of a text
    grams = keep(grams.join(texts.select(F.col("first").alias("doc_id"), "t"), "t").select("doc_id", "t", "hs"), "grams")
    # by sorting at every size, and all documents, as in the last join: one exchange of the texts serves both
    asked = data.select("doc_id", "t", "b").join(grams.hint("merge"), ["doc_id", "t"], "left").select("doc_id", "t", "b", "hs")
    met = asked.mapInArrow(_shared_pieces(span), PIECES).repartition("k").sortWithinPartitions("k")
    runs = met.mapInArrow(_runs(span), RUNS).unionByName(whole)
    return runs.groupBy("doc_id", "t").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))  # at most the bytes of a text


def _without_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lists = batch.column(1), batch.column(2)
        removed, spans = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
        kept: list = [None] * batch.num_rows
        for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
            run = lists[i].values
            begin, end = run.field(0).to_numpy(), run.field(1).to_numpy()
            text = texts[i].as_py()
            change = np.zeros(len(text) + 1, dtype=np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, end, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed[i] = np.count_nonzero(gone)
            spans[i] = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[0])
            kept[i] = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
        left = pa.compute.coalesce(pa.array(kept, pa.binary()), texts.cast(pa.binary()))
        cols = [batch.column(0), pa.compute.binary_length(texts).cast(pa.int64()), pa.array(removed), pa.array(spans), left]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of every document.

    Texts are UTF-8 bytes, null ones empty; strings are judged on the input and never cross documents. Texts shorter than ``span``
    bytes lose nothing. Rows of a repeated doc_id are judged each by its own text and not against each other. An empty
    table gives no rows; other columns are ignored.
    """
    data = _data(docs)
    joined = data.select("doc_id", "t", "b").join(removed_runs(data, span).hint("merge"), ["doc_id", "t"], "left")
    return joined.select("doc_id", "b", "runs").mapInArrow(_without_runs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
