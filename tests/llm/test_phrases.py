import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from rarevar_spark.llm import phrases, queries
from rarevar_spark.llm import quotient_filter as Q

DOCS = "doc_id long, text string, lang string"


def brute(rows, least=30, longest=4, top=2000):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    covered = set()
    for g, a in often.items():
        for k in range(2, len(g) - 1):
            covered |= {s for s in ((g[0], *g[i : i + k]) for i in range(1, len(g) - k + 1)) if 100 * a >= 80 * f[s]}
    out = {}
    for g, a in often.items():
        if g not in covered:
            cuts = [(f[g[: k + 1]], f[(g[0], *g[k + 1 :])], k) for k in range(1, len(g) - 1)]
            score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for l, r, k in cuts)
            out.setdefault(g[0], []).append((-score, -a, " ".join(g[1:]).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def docs():
    """Few words, so that phrases of every length are frequent, in languages of very different sizes, with odd blanks, ends and characters."""
    rng = random.Random(3)
    words = ["the", "The", "of", "café", "É", "x-1", " ", "zz", "new york", "in in in", "a\x1fb", "日本"]
    rows = [(i, rng.choice([" ", "\t ", ""]).join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n", "!", "\x0b"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "de", None])) for i in range(400)]
    rows += [(900, None, "en"), (901, "", None), (902, "one two three four five", "fr"), (903, "und und " * 20, "und"), *rows[:30]]
    return rows


@pytest.mark.parametrize("kw", [{}, {"shard_words": 300, "words_per_share": 100}, {"top": 7, "least": 12}, {"longest": 2}])
def test_collocations(spark, docs, kw):
    out = got(phrases.collocations(spark.createDataFrame(docs, DOCS), **kw))
    assert out == brute(docs, **{k: v for k, v in kw.items() if k in ("top", "least", "longest")})
    assert len({r[0] for r in out}) >= 3


def test_edges(spark):
    long = [(1, "alpha beta. " * 200_000 + "x" * 3_000_000, "en"), (1, "gamma  delta," * 40, "")]
    df = spark.createDataFrame([(*r, 1, "w", [1], "s") for r in long], DOCS + ", n int, word string, g array<int>, shard string")
    assert got(phrases.collocations(df, shard_words=50_000)) == brute(long)
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, " .", "x"), (3, "rare words", "y")], DOCS)).collect() == []
    with pytest.raises(ValueError):
        phrases.collocations(df, longest=5)


def test_scores_pass_64_bits(spark):
    big = 10**13
    words = spark.createDataFrame([("x", "a", 3 * big, 1), ("x", "b", big, 2)], "lang string, word string, f long, id long")
    pairs = spark.createDataFrame([("x", [1, 2], big - 1)], "lang string, g array<long>, a long")
    assert [r.score for r in phrases.score_phrases(pairs, words).collect()] == [2_000_000 * (big - 1) // (4 * big)]


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op11_phrase_collocations"])
    assert want.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    out = got(queries.op11_phrase_collocations(spark, path))
    assert out == sorted(want.fetchall()) and len(out) > 200
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert out == brute(map(tuple, rows))


def test_permutation_is_invertible():
    rng = np.random.default_rng(0)
    hi, lo = (np.concatenate([rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2), np.arange(3, dtype=np.uint64), ~np.arange(3, dtype=np.uint64)]) for _ in "ab")
    for wide in (False, True):
        back = Q.restore(*Q.permute(hi, lo, wide), wide)
        assert np.array_equal(back[0], hi) and np.array_equal(back[1], lo)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("n, shard_bits", [(0, 3), (1, 0), (1, 5), (300, 0), (5000, 4), (5000, 9)])
def test_filters_keep_every_count(n, shard_bits, wide):
    rng = np.random.default_rng(n)
    shards, want = {}, Counter()
    for _ in range(40):
        hi, lo = rng.integers(0, max(n, 1), n, dtype=np.uint64), rng.integers(0, 2, n, dtype=np.uint64) * np.uint64(wide)
        count = rng.choice([1, 2, 254, 255, 256, 10**12], n)
        for h, x, c in zip(hi.tolist(), lo.tolist(), count.tolist()):
            want[h, x] += c
        for s, f in Q.split(*Q.permute(hi, lo, wide), count, shard_bits, wide):
            shards.setdefault(s, []).append((s, f))
    found = {}
    for filters in shards.values():
        hi, lo, count = Q.merge(filters, wide)
        assert (np.diff(hi.astype(object)) >= 0).all()
        hi, lo = Q.restore(hi, lo, wide)
        found |= dict(zip(zip(hi.tolist(), lo.tolist()), count.tolist()))
    assert found == dict(want)
