"""Block-compressed text read by many tasks, held against the plain file."""

import gzip
import random
import struct
import zlib

import pytest

from rarevar_spark.sources import blocks, readers


def packed(text: bytes, sizes) -> bytes:
    """A block-compressed file with blocks of the given sizes in turn, and the empty block at its end."""
    out, at, k = b"", 0, 0
    while True:
        part = text[at : at + sizes[k % len(sizes)]]
        at, k = at + len(part), k + 1
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        z = c.compress(part) + c.flush()
        out += blocks.BLOCK_START + struct.pack("<H", len(z) + 25) + z + struct.pack("<II", zlib.crc32(part), len(part))
        if not part:
            return out


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def lines_of(df):
    return [r.value for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize("ending", ["gz", "bgz"])
def test_lines_are_those_of_the_plain_file(spark, tmp_path, small_splits, ending):
    rng = random.Random(3)
    rows = [f"{i}\t" + "".join(rng.choice("abcé") for _ in range(rng.choice([0, 3, 40, 400]))) for i in range(3000)]
    rows[100] = "".join(rng.choice("0123456789abcdef") for _ in range(40000))  # one line over many splits
    rows[200:230] = [""] * 30
    for tail, name in ("\n", "ended"), ("", "open"), ("\n\n", "blank"):
        text = ("\n".join(rows) + tail).encode()
        path = tmp_path / f"{name}.{ending}"
        path.write_bytes(packed(text, [700, 1, 5000, 64, 20000]))
        df = blocks.text_lines(spark, str(path))
        assert df.rdd.getNumPartitions() > 20
        assert lines_of(df) == text.decode().split("\n")[: None if tail == "" else -1]


def test_line_ends_at_the_ends_of_blocks(spark, tmp_path, small_splits):
    text = b"".join(b"%d\r\n" % i for i in range(20000))
    path = tmp_path / "a.gz"
    path.write_bytes(packed(text, [1, 2, 3, 4, 5, 6, 7, 65280]))
    assert lines_of(blocks.text_lines(spark, str(path))) == [str(i) for i in range(20000)]
    path = tmp_path / "b.gz"  # nothing but line ends, as many as a block can hold
    path.write_bytes(packed(b"\n" * 200000, [65536]))
    assert lines_of(blocks.text_lines(spark, str(path))) == [""] * 200000


def test_empty_plain_and_broken_files(spark, tmp_path):
    (tmp_path / "empty.gz").write_bytes(packed(b"", [1]))
    assert lines_of(blocks.text_lines(spark, str(tmp_path / "empty.gz"))) == []
    (tmp_path / "stream.gz").write_bytes(gzip.compress(b"a\nb\n"))
    assert lines_of(blocks.text_lines(spark, str(tmp_path / "stream.gz"))) == ["a", "b"]
    (tmp_path / "stream.bgz").write_bytes(gzip.compress(b"a\nb\n"))
    with pytest.raises(ValueError, match="not one block-compressed"):
        blocks.text_lines(spark, str(tmp_path / "stream.bgz"))
    good = packed(b"some text\n" * 100, [300])
    for name, bad in ("cut", good[:-40]), ("flipped", good[:-60] + bytes([good[-60] ^ 1]) + good[-59:]):
        (tmp_path / f"{name}.gz").write_bytes(bad)
        with pytest.raises(Exception, match="block|Error -3"):
            blocks.text_lines(spark, str(tmp_path / f"{name}.gz")).collect()


def test_a_vcf_is_the_same_in_blocks(spark, tmp_path, small_splits):
    rng = random.Random(5)
    names = [f"s{i}" for i in range(40)]
    gts = ["0/0", "0|1", "1/1", "./.", "0/0:7", "1|0:3"]
    body = [f"chr21\t{i + 1}\t.\tA\t{rng.choice(['G', 'C', 'G,T'])}\t.\t{rng.choice(['PASS', '.', 'low'])}\t.\tGT\t" + "\t".join(rng.choices(gts, k=40)) for i in range(400)]
    text = "\n".join(["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(names), *body]) + "\n"
    (tmp_path / "a.vcf").write_text(text)
    (tmp_path / "a.vcf.gz").write_bytes(packed(text.encode(), [997, 4001]))
    plain, tight = (readers.read_vcf(spark, str(tmp_path / f), names[::2]) for f in ("a.vcf", "a.vcf.gz"))
    of = lambda df, *by: [tuple(r) for r in df.orderBy(*by).collect()]
    assert of(plain[2], "variant_key", "sample_id") == of(tight[2], "variant_key", "sample_id")
    assert of(plain[1], "ord") == of(tight[1], "ord")
    order = lambda t: [tuple(r) for r in t.orderBy("ord").drop("ord").collect()]
    assert order(plain[0]) == order(tight[0])
    assert tight[0].rdd.getNumPartitions() > 1
