"""Lines of block-compressed text (BGZF), read by as many tasks as the file has splits.

Spark's text source splits a raw file at any separator, and here that is the header of a block, so that each row is one block with its deflated
bytes. A line that runs over the end of a split comes as pieces, which are put together by their order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import keep

# Fixed values of the format: what every block starts with, up to the two bytes that say how long it is, and how long its last two numbers are.
BLOCK_START = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
TRAILER = 8
#: A block has at most 65,536 bytes of text, so no more line ends.
LINES_OF_BLOCK_BITS = 17
#: Bytes of lines in one Arrow batch.
BATCH_BYTES = 4 << 20
PIECES = pa.schema([("value", pa.binary()), ("ord", pa.int64()), ("ends", pa.bool_())])


def _raw(spark: SparkSession, file: str, sep: bytes) -> DataFrame:
    """The undecoded file, split at ``sep``. A link without the ending .gz keeps Spark from taking the file as one stream."""
    name = "blocks-" + hashlib.sha256(file.encode()).hexdigest()[:32]  # a name for each file, since Hadoop keeps a file system by its name
    link = {f"fs.viewfs.mounttable.{name}.link./file": file}
    return spark.read.options(**link).option("encoding", "ISO-8859-1").option("lineSep", sep.decode("latin-1")).text(f"viewfs://{name}/file")


def is_blocked(spark: SparkSession, file: str) -> bool:
    """Whether a file starts as block-compressed ones do; looks at its first bytes only."""
    want = BLOCK_START.split(b"\0")[:-1]
    rows = _raw(spark, file, b"\0").select(F.col("value").cast("binary").alias("b")).take(len(want))
    return [bytes(r.b) for r in rows] == want


def inflate(record: bytes) -> bytes:
    """The text of a block from what follows BLOCK_START; its stated length, size and checksum have to agree."""
    if len(record) < 2 + TRAILER or struct.unpack_from("<H", record)[0] + 1 != len(BLOCK_START) + len(record):
        raise ValueError("a block of another length than it states: cut short, or its header has other fields")
    crc, size = struct.unpack_from("<II", record, len(record) - TRAILER)
    text = zlib.decompress(record[2:-TRAILER], -15)
    if len(text) != size or zlib.crc32(text) != crc:
        raise ValueError("a block whose text disagrees with its checksum")
    return text


def _split_pieces(blocks: Iterator[tuple[int, int, bytes]], edges: bool) -> Iterator[tuple[bytes, int, bool]]:
    """(value, ord, ends) of the lines that lie within a split, or (``edges``) of the pieces at its ends.

    ``blocks`` are (split, place, record) in order. A split gives one piece up to its first line end, if it has one, and one after its last.
    """
    split, rest, begin, first = None, [], 0, True
    for at, place, record in blocks:
        if at != split:
            if split is not None and edges:
                yield b"".join(rest), begin, False
            split, rest, begin, first = at, [], place << LINES_OF_BLOCK_BITS, True
        parts = inflate(record).split(b"\n")
        if len(parts) > 1:
            if first == edges:
                yield b"".join([*rest, parts[0]]), begin, True
            if not edges:
                for k, line in enumerate(parts[1:-1], 1):
                    yield line, place << LINES_OF_BLOCK_BITS | k, True
            rest, begin, first = [], place << LINES_OF_BLOCK_BITS | (len(parts) - 1), False
        rest.append(parts[-1])
    if split is not None and edges:
        yield b"".join(rest), begin, False


def _unpack(edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        split, place = None, 0
        for batch in batches:
            for at, record in zip(batch["split"].to_pylist(), batch["record"].to_pylist(), strict=True):
                if at != split:
                    split, place = at, at
                if record:  # nothing stands before the first block
                    yield at, place, record
                    place += len(BLOCK_START) + len(record)  # below the next split's start, as its blocks start in it

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in _split_pieces(blocks(batches), edges):
            rows.append(row)
            size += len(row[0]) + 16
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return unpack


def block_lines(spark: SparkSession, file: str) -> DataFrame:
    """value and ord (rising with the place in the file) of the lines of one block-compressed file.

    The pieces at the ends of splits, two for each, are found by a pass of their own and kept as a table; only their places and whether
    they end a line pass through one task, their bytes meet line by line. Line ends are \\n or \\r\\n; the last line may lack one.
    """
    raw = _raw(spark, file, BLOCK_START).select(F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("record"))
    schema = "value binary, ord long, ends boolean"
    pieces = keep(raw.mapInArrow(_unpack(True), schema), "line-pieces")
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    numbers = pieces.select("ord", F.coalesce(F.sum(F.col("ends").cast("long")).over(before), F.lit(0)).alias("line"))
    met = pieces.join(numbers, "ord").groupBy("line").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("p"), F.max("ends").alias("ends"))
    met = met.select(F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.value))").alias("value"), F.col("p")[0]["ord"].alias("ord"), "ends")
    met = met.where(F.col("ends") | (F.length("value") > 0)).select("value", "ord")
    lines = raw.mapInArrow(_unpack(False), schema).select("value", "ord").unionByName(met)
    text = F.col("value").cast("string")
    return lines.select(F.when(text.endswith("\r"), F.expr("left(cast(value as string), length(cast(value as string)) - 1)")).otherwise(text).alias("value"), "ord")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and ord of a text file, plain or compressed. Block-compressed ones (.gz, .bgz) are read split by split, other compressed ones by one task."""
    plain = spark.read.text(path)
    if path.endswith((".gz", ".bgz")):
        files = plain.inputFiles()
        if len(files) == 1 and is_blocked(spark, files[0]):
            return block_lines(spark, files[0])
        if path.endswith(".bgz"):
            raise ValueError(f"{path}: not one block-compressed file")
        return plain.withColumn("ord", F.monotonically_increasing_id()).repartition(F.xxhash64("ord"))  # a stream is one task: deal its lines out
    return plain.withColumn("ord", F.monotonically_increasing_id())
