"""N-gram Jaccard self-join by a token-group matrix.

Documents are sets of word shingles. Equal sets are one class from the start. Sets that may be similar are
partitioned into groups; the token-group matrix holds each group's token union, a set opens a group only when enough of its
tokens are in that union, and only then is it compared with the group's sets, by exact intersection.

Which sets may be similar is found without loss: two linked sets whose larger one has at most n tokens differ in at
most ``2 n (1 - t) / (1 + t)`` tokens. Cut every set by ranges of the tokens' hashes into more parts than that, and at least
one part is equal in both. Sizes fall into classes that a link spans at most one border of; a set is cut for its own
class and for the next. A set joins the group of the set that leads
most of its shared parts (the smallest set that has the part), and asks the groups that hold as many of its parts as a link needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import keep
from .textkit import BLANK_SEPARATED, distinct_by_doc, list_array, mix, shingle_hashes, slices, word_hashes


class SizeClasses:
    """Lower bounds of the size classes, and for each the most tokens that linked sets differ in and the number of parts.

    A class is at least so wide that a set's links reach no further than the next class.
    """

    def __init__(self, share: Fraction, width: Fraction = Fraction(1)) -> None:
        self.share = share
        low = [1]
        while low[-1] < 1 << 40:
            low.append(int(low[-1] * max(width, 1 / share)) + 1)
        top = [b - 1 for b in low[1:]]
        self.low = np.array(low[:-1], dtype=np.int64)
        self.differ = np.array([int(2 * n * (1 - share) / (1 + share)) for n in top], dtype=np.int64)
        self.parts = np.where(self.differ > 0, self.differ * 12 // 10 + 2, 0)


def part_signatures(h: np.ndarray, d: np.ndarray, n_docs: int, classes: SizeClasses) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures (hash of size class, part number and content) and the document of each, from distinct sorted tokens; and for
    each document how many of its parts a linked set has at least: those in use less the most tokens that may differ."""
    need = np.full(n_docs, np.iinfo(np.int32).max, dtype=np.int64)
    n = np.bincount(d, minlength=n_docs)
    own = np.searchsorted(classes.low, np.maximum(n, 1), side="right") - 1
    sigs, docs = [], []
    for step in (0, 1):
        c = own + step
        m, differ = classes.parts[c], classes.differ[c]
        if step:  # only sets that a set of the next class may link with
            reaches = n * classes.share.denominator // classes.share.numerator >= classes.low[c]
            m = np.where(reaches, m, 0)
        ok = m[d] > 0
        hh, dd = h[ok], d[ok]
        if not len(hh):
            continue
        part = ((hh >> np.uint64(32)) * m[dd].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(hh), dtype=bool)
        new[1:] = (dd[1:] != dd[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        tag = c[dd[at]].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + part[at] * np.uint64(0x165667B19E3779F9)
        sigs.append(mix(np.add.reduceat(hh, at) + mix(tag)))
        docs.append(dd[at])
        # With as few parts in use as tokens may differ, the equal part may be one that is empty in both.
        in_use = np.bincount(dd[at], minlength=n_docs)
        need = np.where(m > 0, np.minimum(need, np.maximum(in_use - differ, 1)), need)
        for k in np.flatnonzero((in_use <= differ) & (n > 0) & (m > 0)):
            empty = np.setdiff1d(np.arange(m[k], dtype=np.uint64), part[at][dd[at] == k])
            tag = c[k : k + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + empty * np.uint64(0x165667B19E3779F9)
            sigs.append(mix(mix(tag)))
            docs.append(np.full(len(empty), k))
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), need
    sig, doc = np.concatenate(sigs), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return sig[order], doc[order], need


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _set_ids(h: np.ndarray, d: np.ndarray, n_docs: int) -> np.ndarray:
    """A 64-bit hash of each document's set of tokens."""
    s = np.bincount(d, minlength=n_docs).astype(np.uint64)
    if len(h):
        at = np.flatnonzero(np.diff(d, prepend=-1))
        s[d[at]] += np.add.reduceat(h, at) + mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at))
    return mix(s)


def _sliced(batches: Iterator[pa.RecordBatch], column: int, words: int) -> Iterator[tuple]:
    for batch in batches:
        for i, j, raw, off in slices(batch.column(column)):
            yield batch.slice(i, j - i), j - i, *distinct_by_doc(*shingle_hashes(*word_hashes(raw, off, BLANK_SEPARATED), j - i, words))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and set_id, a hash of the set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, h, d in _sliced(batches, 1, words):
            cols = [batch.column(0), pa.array(np.bincount(d, minlength=n).astype(np.int64)), pa.array(_set_ids(h, d, n).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set_id"])

    return _texts(docs).mapInArrow(rows, "doc_id long, n_shingles long, set_id long")


def set_parts(docs: DataFrame, words: int, share: Fraction, width: Fraction) -> DataFrame:
    """rep (the set's id), sig and need: the part signatures of every set; a task leaves out the sets it has seen before."""
    classes = SizeClasses(share, width)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, n, h, d in _sliced(batches, 1, words):
            ids = _set_ids(h, d, n)
            new = np.zeros(n, dtype=bool)
            for k, x in enumerate(ids.tolist()):
                new[k] = x not in seen
                seen.add(x)
            use = new[d]
            sig, doc, need = part_signatures(h[use], d[use], n, classes)
            cols = [pa.array(ids[doc].view(np.int64)), pa.array(sig.view(np.int64)), pa.array(need[doc].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["rep", "sig", "need"])

    return _texts(docs).mapInArrow(rows, "rep long, sig long, need int")


def _tokens(texts: DataFrame, words: int) -> DataFrame:
    """rep and the distinct shingle hashes of its text, of a table (rep, text); other texts under the id of a set's first document are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, h, d in _sliced(batches, 1, words):
            found = pa.RecordBatch.from_arrays([batch.column(0), list_array(h.view(np.int64), np.bincount(d, minlength=n), pa.int64())], ["rep", "tokens"])
            yield found.filter(pa.array(_set_ids(h, d, n).view(np.int64) == batch.column(0).to_numpy()))

    return texts.mapInArrow(rows, "rep long, tokens array<long>")


def _open_groups(share: Fraction):
    """Function of a cell's rows (members and queries of some groups) to the links found there."""

    def links(table: pa.Table) -> pa.Table:
        keys = np.rec.fromarrays([table.column(c).to_numpy() for c in ("rep", "grp", "role")])
        table = table.take(np.unique(keys, return_index=True)[1])  # a repeated doc_id counts once
        rep, grp, home, size, role = (table.column(c).to_numpy() for c in ("rep", "grp", "home", "size", "role"))
        tokens = table.column("tokens").combine_chunks()
        count = tokens.value_lengths().to_numpy().astype(np.int64)
        flat = tokens.flatten().to_numpy().view(np.uint64)
        flat = mix(flat ^ np.repeat(mix(grp.view(np.uint64).copy()), count))  # tokens of different groups never meet
        first = np.concatenate([[0], np.cumsum(count)])
        member = role == 0
        pos = np.repeat(np.arange(len(rep)), count)
        own = member[pos]
        order = np.argsort(flat[own], kind="stable")
        m_tok, m_of = flat[own][order], pos[own][order]
        parent = {int(r): int(r) for r in rep}
        degree: dict[int, int] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for q in np.flatnonzero(~member):
            t = flat[first[q] : first[q + 1]]
            lo, hi = np.searchsorted(m_tok, t, "left"), np.searchsorted(m_tok, t, "right")
            n = hi - lo
            if np.count_nonzero(n) * share.denominator < share.numerator * len(t):  # the bound of the token union
                continue
            n, lo = n[n > 0], lo[n > 0]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(m_of[at], minlength=len(rep))
            hit = np.flatnonzero(both)
            union = count[hit] + len(t) - both[hit]
            hit = hit[(both[hit] * share.denominator >= share.numerator * union) & (rep[hit] != rep[q])]
            if not len(hit):
                continue
            a = int(rep[q])
            degree[a] = degree.get(a, 0) + int(size[hit].sum())
            for k in hit:
                b = int(rep[k])
                if home[q] != grp[q]:  # else the other one asks as well
                    degree[b] = degree.get(b, 0) + int(size[q])
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        found = sorted(r for r in parent if r in degree or find(r) != r)  # a member that others join may have no links counted here
        return pa.table({"rep": pa.array(found, pa.int64()), "root": pa.array([find(r) for r in found], pa.int64()), "links": pa.array([degree.get(r, 0) for r in found], pa.int64())})

    return links


def similar_sets(docs: DataFrame, words: int = 3, threshold: float = 0.9, cell_tokens: int = 200_000, class_width: float = 1.0) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    Words are runs between blanks (space, \\t..\\r), A-Z lower-cased; a document's set is its distinct shingles of
    ``words`` words, or its whole sequence where it has fewer. Two documents link when the Jaccard similarity of
    their sets is at least ``threshold``; component_id is the smallest doc_id reachable by links, n_links the number of
    documents linked directly. Null, empty and blank texts have no shingles and link with nothing. Equal sets link whatever
    their number and are never paired with each other. doc_id is a key: rows that repeat one give
    repeated rows, each judged by its own text.
    An empty table gives no rows; other columns are ignored.

    Comparisons run in cells of about ``cell_tokens`` tokens on either side: a large group is a grid of cells, small
    groups share one. Size classes are at least ``class_width`` wide: wider ones make fewer parts, of fewer tokens, which suits longer shingles.
    """
    share = Fraction(str(threshold))
    sets = keep(shingle_sets(docs, words), "sets")
    classes = sets.where("n_shingles > 0").groupBy("n_shingles", "set_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("size"))
    classes = keep(classes.withColumnRenamed("set_id", "rep"), "classes")
    by_sig = Window.partitionBy("sig")  # one scan and one exchange; a frequent signature's rows spill
    parts = set_parts(docs, words, share, Fraction(str(class_width))).withColumns({"lead": F.min("rep").over(by_sig), "last": F.max("rep").over(by_sig)})
    parts = keep(parts.where("lead < last").select("rep", "sig", "need", "lead").distinct(), "parts")
    home = parts.groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("k")).groupBy("rep").agg(F.min_by("lead", F.struct(-F.col("k"), "lead")).alias("home"))
    homes = keep(home.join(classes.select("rep", "size", "first_doc", F.col("n_shingles").alias("n")), "rep"), "homes")
    placed = parts.select("sig", "rep", "need").join(homes.select("rep", "home"), "rep")
    present = placed.select("sig", F.col("home").alias("grp")).distinct()
    met = placed.join(present, "sig").where("grp <= home").groupBy("rep", "home", "grp").agg(F.count(F.lit(1)).alias("met"), F.min("need").alias("need"))
    asked = met.where("met >= need").select("rep", "home", "grp")
    asked = asked.join(homes.select("rep", "n", "size"), "rep")
    asked = keep(asked, "asked")
    # by sorting at every size: which sets come here grows with the input
    texts = _texts(docs).join(homes.select(F.col("first_doc").alias("doc_id"), "rep").hint("merge"), "doc_id").select("rep", "text")
    tokens = keep(_tokens(texts, words), "tokens")
    cut = lambda total: F.ceil(F.col(total) / F.lit(cell_tokens)).cast("int")
    grid = (
        homes.groupBy(F.col("home").alias("grp")).agg(F.sum("n").alias("m_total"))
        .join(asked.groupBy("grp").agg(F.sum("n").alias("q_total")), "grp")
        .select("grp", cut("m_total").alias("rows_"), cut("q_total").alias("cols_"), (F.col("m_total") + F.col("q_total")).alias("total"))
    )
    grid = keep(grid, "grid")
    small = grid.where("rows_ = 1 and cols_ = 1").agg(F.sum("total")).first()[0] or 0
    bins = int(-(-small // (2 * cell_tokens))) or 1
    cell = F.when((F.col("rows_") == 1) & (F.col("cols_") == 1), F.pmod(F.xxhash64("grp"), F.lit(bins))).otherwise(F.xxhash64("grp", "row_", "col_"))
    share_of = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = homes.select("rep", "home", F.col("home").alias("grp"), "size").join(grid, "grp").withColumn("row_", share_of("rows_")).withColumn("col_", every("cols_"))
    queries = asked.select("rep", "home", "grp", "size").join(grid, "grp").withColumn("col_", share_of("cols_")).withColumn("row_", every("rows_"))
    cols = ["rep", "home", "grp", "size"]
    cells = members.select(*cols, cell.alias("cell"), F.lit(0).alias("role")).unionByName(queries.select(*cols, cell.alias("cell"), F.lit(1).alias("role")))
    cells = cells.join(tokens, "rep")
    links = keep(cells.groupBy("cell").applyInArrow(_open_groups(share), "rep long, root long, links long"), "links")
    found = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    labelled = (
        classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        .join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
    )
    smallest = labelled.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    labelled = labelled.join(smallest, "component").select("n_shingles", F.col("rep").alias("set_id"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
    return sets.join(labelled, ["n_shingles", "set_id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links")
    )


def keep_one_of_each(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document, the one of smallest doc_id, of each group of linked documents."""
    dropped = similar_sets(docs, words, threshold, class_width=1.5).where("doc_id != component_id").select(F.col("doc_id").alias("drop_id_")).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["drop_id_"], "left_anti")
