"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

A text's word shingles are hashed once. The top bits of a hash choose one of ``BINS`` bins, and each bin keeps its
least hash. An empty bin takes the value of a bin with one: of the first such in a fixed random sequence of bins of its own
(``PROBES`` draws), or else of the one that comes first in a fixed random order of its own. Of each bin the low ``BITS``
bits are kept, packed into 64-bit words. Two texts' likeness is the share of equal bins, less what equal low bits of
different hashes are expected to add. All of it is column expressions.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
LANES = 64 // BITS
PROBES = 4
WORDS_PER_SHINGLE = 5
_SHIFT = 64 - BIN_BITS
_LOW = (1 << _SHIFT) - 1
#: log2 of the ids in a group, when the next id is looked for
_GROUP_BITS = 9


def _shingles(words: str) -> str:
    k = WORDS_PER_SHINGLE
    return (
        f"case when size({words}) >= {k} then transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64(slice({words}, i, {k})))"
        f" when size({words}) > 0 then array(xxhash64({words})) else cast(array() as array<bigint>) end"
    )


def _draws() -> list[list[int]]:
    """For each probe, the bin that every bin asks: a fixed pseudo-random table."""
    draw = random.Random(20_17)
    return [[draw.randrange(BINS) for _ in range(BINS)] for _ in range(PROBES)]


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with column ``name``, the packed words (array of 64-bit integers) of ``text``; an empty array if it has no word.

    Words are what white space separates, lower-cased; shingles are ``WORDS_PER_SHINGLE`` words, or the whole sequence of a
    shorter text. Null counts as empty.
    """
    half = BINS // 2
    empties = f"transform(sequence({-half}, {half - 1}), b -> shiftleft(cast(b as bigint), {_SHIFT}) | {_LOW}L)"
    probes = [f"{name}_m[array({', '.join(map(str, draw))})[b]]" for draw in _draws()]
    drawn = " ".join(f"when {p} & {_LOW}L != {_LOW}L then {p}" for p in probes)
    ordered = f"array_min(transform(filter({name}_m, y -> y & {_LOW}L != {_LOW}L), y -> struct(xxhash64(b, shiftright(y, {_SHIFT})) as o, y))).y"
    # low bits of a hash of value and bin: a value that fills many bins agrees with another by chance in each of them anew
    filled = f"transform({name}_m, (x, b) -> xxhash64(case when x & {_LOW}L != {_LOW}L then x {drawn} else {ordered} end, b))"
    packed = (
        f"transform(sequence(0, {BINS // LANES - 1}), w -> aggregate(slice({name}_f, w * {LANES} + 1, {LANES}), 0L,"
        f" (a, x) -> shiftleft(a, {BITS}) | (x & {(1 << BITS) - 1}L)))"
    )
    return (
        df.withColumn(f"{name}_w", F.expr(f"array_remove(split(lower(coalesce({text}, '')), '[ \\\\t-\\\\r]+'), '')"))
        .withColumn(f"{name}_s", F.expr(f"sort_array(concat({_shingles(f'{name}_w')}, {empties}))"))
        .withColumn(f"{name}_m", F.expr(f"filter({name}_s, (x, i) -> i = 0 or shiftright(x, {_SHIFT}) != shiftright({name}_s[i - 1], {_SHIFT}))"))
        .withColumn(f"{name}_f", F.expr(f"case when size({name}_w) = 0 then cast(array() as array<bigint>) else {filled} end"))
        # each step is used more than once by the next, so that the optimizer keeps it as a projection of its own
        .withColumn(name, F.expr(f"case when size({name}_f) = 0 then {name}_f else {packed} end"))
        .drop(*(f"{name}_{x}" for x in "wsmf"))
    )


def as_string(packed: Column) -> Column:
    """Packed words as lower-case hexadecimal digits, one for each bin."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two texts from their packed words; 1 for two texts without a word, 0 if one has none."""
    differ = "p ^ q"
    for step in (1 << k for k in range(BITS.bit_length() - 1)):  # ors all bits of a lane into its lowest
        differ = f"transform(array({differ}), x -> x | shiftrightunsigned(x, {step}))[0]"
    unequal = f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count({differ} & {int('01' * (64 // BITS), 16)}L)), 0, (s, y) -> s + y)"
    chance = 1.0 / (1 << BITS)
    share = f"((1.0D - {unequal} / {float(BINS)}D - {chance}D) / {1.0 - chance}D)"
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1.0D when size({a}) = 0 or size({b}) = 0 then 0.0D else greatest(0.0D, {share}) end")


def next_ids(ids: DataFrame) -> DataFrame:
    """id, next_id (the next larger one; the smallest for the largest) of a table of distinct ``id``.

    Ids of equal high bits are a group of at most ``2 ** _GROUP_BITS``; the next id is in the group, or is the least of the next
    group, and that is found likewise among the groups. No task sorts more than a few groups, however many ids there are.
    """
    low, high = ids.agg(F.min("id"), F.max("id")).first()

    def following(k: DataFrame, low: int, high: int) -> DataFrame:
        if high - low < 2 << _GROUP_BITS:
            return k.select("id", F.lead("id").over(Window.orderBy("id")).alias("next_id"))
        group = F.shiftright("id", _GROUP_BITS)
        inside = k.select("id", group.alias("g")).withColumn("next_id", F.lead("id").over(Window.partitionBy("g").orderBy("id")))
        first = keep(k.groupBy(group.alias("g")).agg(F.min("id").alias("first")), "id-groups")
        above = following(first.select(F.col("g").alias("id")), low >> _GROUP_BITS, high >> _GROUP_BITS)
        after = above.join(first, above["next_id"] == first["g"]).select(above["id"].alias("g"), "first")
        return inside.join(after, "g", "left").select("id", F.coalesce("next_id", "first").alias("next_id"))

    if low is None:
        return ids.select("id", F.col("id").alias("next_id"))
    return following(ids, low, high).select("id", F.coalesce("next_id", F.lit(low)).alias("next_id"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and how alike these and the next document's are.

    The edited text is the text with its last ``floor(n_chars / 4)`` code points replaced by the first as many (or all) of
    the next document's, by ascending doc_id; after the last comes the first. Null counts as empty. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint (hexadecimal; '' without a word), near_edited, near_next. A repeated
    doc_id counts once, with its least text. A null doc_id is one too, before all others. Texts of any length count whole. An empty table gives
    no rows; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if base.where("doc_id is null").limit(1).count():
        least = base.agg(F.min("doc_id")).first()[0]
        nobody = 0 if least is None else least - 1
        out = edited_fingerprints(base.withColumn("doc_id", F.coalesce("doc_id", F.lit(nobody))))
        return out.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(nobody)))
    sizes = keep(base.select("doc_id", F.length("text").cast("long").alias("n")), "sizes")
    ids = sizes.select(F.col("doc_id").alias("id")).distinct()
    if sizes.count() != ids.count():
        base = base.groupBy("doc_id").agg(F.min("text").alias("text"))
        sizes = keep(base.select("doc_id", F.length("text").cast("long").alias("n")), "sizes")
    follow = keep(next_ids(ids).join(sizes.withColumnRenamed("doc_id", "id"), "id"), "follow")
    asked = follow.select(F.col("next_id").alias("doc_id"), F.col("id").alias("for_id"), F.expr("n div 4").alias("want"))
    both = base.join(asked, "doc_id")
    heads = both.select(F.col("for_id").alias("doc_id"), F.expr("substring(text, 1, cast(want as int))").alias("head"))
    edited = base.join(heads, "doc_id").withColumn("n_chars", F.length("text").cast("long"))
    edited = edited.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), head)"))
    edited = edited.select("doc_id", "n_chars", "text", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    edited = with_fingerprint(edited, "edited", "edited_words").drop("edited")
    marked = keep(with_fingerprint(edited, "text", "words").drop("text"), "fingerprints")
    marked = marked.join(follow.select(F.col("id").alias("doc_id"), "next_id"), "doc_id")
    theirs = marked.select(F.col("doc_id").alias("next_id"), F.col("words").alias("next_words"))
    return marked.join(theirs, "next_id").select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("words")).alias("fingerprint"), as_string(F.col("edited_words")).alias("edited_fingerprint"),
        likeness("words", "edited_words").alias("near_edited"), likeness("words", "next_words").alias("near_next"),
    )
