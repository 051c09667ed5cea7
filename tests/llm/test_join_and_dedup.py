import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from rarevar_spark.llm import components, line_dedup, ngram_join, repeated_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_join(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    inverted = {}
    for i, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(i)
    parent, links = {i: i for i in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inverted[x]).items():
            if j != i and den * n >= num * (len(s) + len(sets[j]) - n):
                links[i] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i), links[i]) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 160)))) for i in range(120)]
    base = rng.choices(vocabulary, k=150)
    for i in range(200, 330):  # a chain of near copies, many of them not linked with each other
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    rows += [(400 + i, " ".join(rng.choices("ab", k=rng.randint(0, 9)))) for i in range(50)]
    rows += [(500 + i, rows[5][1].upper()) for i in range(20)] + [(600, None), (601, ""), (602, " \n\t"), (603, "one"), (604, "ONE")]
    rows.append((700, " ".join(rng.choices(vocabulary, k=20_000))))
    rows.append((701, rows[-1][1] + " end"))
    return rows


@pytest.mark.parametrize(
    "k, threshold, num, den, cell_tokens", [(3, 0.9, 9, 10, 3000), (5, 0.8, 4, 5, 3000), (2, 0.5, 1, 2, 3000), (3, 0.9, 9, 10, 700), (3, 0.9, 9, 10, 200_000)]
)
def test_join_equals_brute_force(spark, corpus, k, threshold, num, den, cell_tokens):
    """Cells of 700 tokens cut the group of near copies into a grid of more than 20 by 20."""
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in ngram_join.similar_sets(docs, k, threshold, cell_tokens=cell_tokens).collect()]
    assert len(got) == len(corpus) and set(got) == brute_join(corpus, k, num, den)


def test_cells_report_every_member_of_a_class():
    """A links with B and C, which don't link with each other, and only the cell where A asks sees that."""
    a, b, c = list(range(20)), list(range(20)) + [90, 91], [95, 96] + list(range(20))
    cell = lambda asks: pa.table({
        "rep": pa.array([1, 2, 3, asks]), "grp": pa.array([1] * 4), "home": pa.array([1] * 4), "size": pa.array([1] * 4), "role": pa.array([0, 0, 0, 1]),
        "tokens": pa.array([a, b, c, (a, b, c)[asks - 1]], pa.list_(pa.int64())),
    })
    found = ngram_join._open_groups(Fraction(9, 10))(cell(1)).to_pylist()
    assert found == [{"rep": 1, "root": 1, "links": 2}, {"rep": 2, "root": 1, "links": 0}, {"rep": 3, "root": 1, "links": 0}]


def test_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_sets(empty).count() == 0
    rows = [(1, "a b c d", 7, 1), (1, "a b c d", 8, 2), (2, "a b c d", 9, 3)]
    named = spark.createDataFrame(rows, "doc_id int, text string, rep int, sig int")
    assert sorted(tuple(r)[:3] for r in ngram_join.similar_sets(named).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    two = [(1, "a b c d"), (1, "x y z x"), (2, "a b c d"), (3, "x y z x"), (4, "x y z x")]  # an id with two texts
    got = sorted(tuple(r) for r in ngram_join.similar_sets(spark.createDataFrame(two, "doc_id long, text string")).collect())
    assert got == [(1, 2, 1, 1), (1, 2, 1, 2), (2, 2, 1, 1), (3, 2, 1, 2), (4, 2, 1, 2)]
    kept = ngram_join.keep_one_of_each(spark.createDataFrame(rows[1:], "doc_id int, text string, rep int, sig int"))
    assert kept.columns == ["doc_id", "text", "rep", "sig"] and [r.doc_id for r in kept.collect()] == [1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(5, 5)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_patience_is_longest():
    rng = random.Random(2)

    for _ in range(50):
        p = list(range(9))
        rng.shuffle(p)
        run = [p[i] for i in line_dedup.patience(np.array(p))]
        best = max((len(c) for m in range(512) for c in [[p[i] for i in range(9) if m >> i & 1]] if c == sorted(c)), default=0)
        assert run == sorted(run) and len(run) == best


def test_line_dedup(spark):
    a, b, c, d, e = (f"{w} line of some words here" for w in ("first", "second", "third", "fourth", "fifth"))
    rows = [
        (1, f"{a}\n{b}\nshort\n{c}"), (2, f"{a}\n{b}\nshort\n{c}"), (3, f"new one here\n{b}\n{c}\n"), (4, "short\nonly this line is new to all"), (5, None), (6, ""),
        (7, f"{d}\n{d}\n{e}"), (8, f"{d}\n{e}\n{d}\n{d}"), (9, f"{c}\n{a}"), (10, "\n\n"),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id int, text string, owner string").repartition(3)
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in line_dedup.delete_repeated_lines(docs, rare_share=0.6).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("", 4)
    assert got[3] == ("new one here\n", 2)
    assert got[4] == (rows[3][1], 0), "a short line that documents share by chance stays"
    assert got[5] == (None, 0) and got[6] == ("", 0) and got[10] == ("\n\n", 0)
    assert got[7] == (rows[6][1], 0) and got[8][1] == 2, "of repeated lines, as many go as an earlier document has in order"
    assert got[9][1] == 1, "lines in another order are aligned once"
    assert line_dedup.delete_repeated_lines(docs).columns == ["doc_id", "text", "owner", "n_lines_removed"]
    assert line_dedup.delete_repeated_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_many_copies(spark):
    copy = "\n".join(f"line {i} of the copied page" for i in range(12))
    common = "a notice that stands on every page"
    rows = [(i, f"{copy}\nown words of page {i}" if i % 2 else f"{common}\nunlike page number {i}") for i in range(200)]
    got = {r.doc_id: r.text for r in line_dedup.delete_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[1][1] and all(got[i] == f"own words of page {i}" for i in range(3, 200, 2))
    assert all(got[i] == rows[i][1] for i in range(0, 200, 2)), "a common line that is no long block stays"


@pytest.mark.parametrize("size", [100, 600, 1300, 6000])
def test_line_dedup_is_the_same_at_any_size(spark, size):
    often, everywhere = "a repeated line of one in twenty-five", "a notice on every tenth page here"
    rows = [(i, f"page {i} alone\n{often if i % 25 == 1 else everywhere if i % 10 == 0 else i}") for i in range(size)]
    got = {r.doc_id: r.n_lines_removed for r in line_dedup.delete_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, n in got.items() if n} == {i for i in range(2, size) if i % 25 == 1}


def test_line_dedup_finds_every_long_block(spark):
    p, q = ([f"{w} {i} of the passage" for i in range(5)] for w in ("upper", "lower"))
    short = [f"bit {i} here now" for i in range(6)]  # too few words to be rare
    rows = [(1, p + ["between"] + q), (2, q + ["other"] + p)]  # both passages, in the other order
    rows += [(10 + i, [f"start of {i}", x, f"end of {i}"]) for i, x in enumerate(short)]  # each line has an earlier holder of its own
    rows += [(20, short), (21, [f"long line {i} of the main relative alone" for i in range(9)])]
    rows += [(22, [f"long line {i} of the main relative alone" for i in range(9)] + ["own"] + short)]
    rows += [(30, ["one long line of " + "many " * 20, "tail"]), (31, ["lead", "one long line of " + "many " * 20, "tail", "", "tail"]), (32, short[:3] + ["own line"] + short[3:])]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.delete_repeated_lines(docs).collect()}
    assert got[2] == "other" and got[20] == "\n".join(short), "single lines of few words stay"
    assert got[22] == "own" and got[31] == "lead\n\ntail" and got[32] == "\n".join(rows[-1][1])


def lines_of_all_pairs(texts, rare_documents, rare_words, block_words):
    """The lines that go if every document is aligned with every earlier one."""
    known = {i: [(p, x) for p, x in enumerate(t.split("\n")) if x.split()] for i, t in texts.items()}
    held, own = Counter(), {}
    for i, lines in known.items():
        seen = Counter()
        own[i] = {}
        for p, x in lines:
            own[i][x, seen[x]] = p
            seen[x] += 1
        held.update(own[i].keys())
    gone = set()
    for i in own:
        for j in own:
            if j >= i:
                continue
            both = sorted((p, own[j][k], k) for k, p in own[i].items() if k in own[j])
            if not both:
                continue
            run = [both[n] for n in line_dedup.patience(np.array([q for _, q, _ in both]))]
            block = []
            for n, (p, q, k) in enumerate(run):
                if n and (p != run[n - 1][0] + 1 or q != run[n - 1][1] + 1):
                    block = []
                block.append((p, k))
                if n + 1 < len(run) and (run[n + 1][0], run[n + 1][1]) == (p + 1, q + 1):
                    continue
                words = sum(len(k[0].split()) for _, k in block)
                if words >= block_words or any(held[k] <= rare_documents and len(k[0].split()) >= rare_words for _, k in block):
                    gone |= {(i, p) for p, _ in block}
    return gone


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    stock = [" ".join(word() for _ in range(rng.randint(1, 12))) + f" {i}" for i in range(150)]
    passages = [rng.sample(stock, rng.randint(2, 6)) for _ in range(25)]
    texts = {}
    for i in range(160):
        lines = []
        for _ in range(rng.randint(1, 5)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [f"own line {i} {rng.random()} of some more words"]
        texts[i] = "\n".join(lines)
    want = lines_of_all_pairs(texts, 48, 5, 20)
    found = line_dedup.lines_to_delete(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), rare_share=0.3)
    got = {(r.doc_id, p) for r in found.collect() for p in r.gone}
    earlier = {}
    for i, t in texts.items():
        for x in t.split("\n"):
            earlier.setdefault(x, i)
    assert len(want) > 300 and len(got & want) >= 0.95 * len(want), (len(got & want), len(want))
    assert all(earlier[texts[i].split("\n")[p]] <= i for i, p in got) and len(got - want) <= 0.05 * len(want)


def test_line_dedup_edges(spark):
    """Rows of a repeated doc_id lose the same lines and don't count against each other; very long texts; ties."""
    long = "\n".join(f"line {i} of a very long text with words" for i in range(60_000))
    rows = [(1, long), (2, "own start\n" + long), (3, "a line of five words here"), (3, "a line of five words here"), (4, "a line of five words here\nnew"), (5, None)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_lines_removed int")
    got = sorted((r.doc_id, r.text, r.n_lines_removed) for r in line_dedup.delete_repeated_lines(docs, rare_share=0.8).where("text is not null").collect())
    assert [(i, n) for i, _, n in got] == [(1, 0), (2, 60_000), (3, 0), (3, 0), (4, 1)]
    assert got[1][1] == "own start" and got[-1][1] == "new"


def brute_spans(rows, span):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        grams = [b[p : p + span] for p in range(len(b) - span + 1)]
        gone = bytearray(len(b))
        for p, g in enumerate(grams):
            if g in seen:
                gone[p : p + span] = b"\1" * span
        seen.update(grams)
        kept = bytes(c for c, k in zip(b, gone) if not k)
        out[i] = (len(b), sum(gone), sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_spans(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdé \n", k=n))
    shared = [text(70), text(49), text(50), "z" * 80]
    rows = [(i, "".join(rng.choice([text(rng.randint(0, 40)), *shared]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, "z" * 300), (104, "".join(shared) * 40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeated_spans.remove_repeats(docs).collect()}
    assert got == brute_spans(rows, 50)
    assert repeated_spans.remove_repeats(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "x" * 60), (1, "y" * 60), (1, "x" * 60), (2, "y" * 55 + "x" * 60), (3, "x" * 60)], "doc_id int, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeated_spans.remove_repeats(twice).collect())
    assert got == [(1, 60, 0, 0), (1, 60, 0, 0), (1, 60, 0, 0), (2, 115, 115, 1), (3, 60, 60, 1)]


def test_suffix_order():
    rng = random.Random(5)
    for _ in range(400):
        s = [rng.randint(1, rng.randint(1, 5)) for _ in range(rng.randint(0, 40))] + [0]
        assert repeated_spans.suffix_order(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("most", [1 << 22, 3000])
def test_pieces_of_one_place(most):
    """Very many near copies of one place are dealt to several orders and give the same runs."""
    rng = random.Random(6)
    base = bytes(rng.choices(range(97, 123), k=400))
    rows = []
    for i in range(60):
        t = bytearray(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(400)] = rng.randrange(97, 123)
        rows.append((i, bytes(t).decode()))
    doc, start, n, at, texts = [], [], [], [], []
    for i, t in rows:
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        for _, a, count, x, _ in zip(*repeated_spans.pieces(raw, np.array([0, 400]), 50)):
            doc.append(i), start.append(a), n.append(count), at.append(x - a), texts.append(t.encode()[a : a + count + 49])
    row, begin, end = repeated_spans.solve(np.array(doc), np.array(n), np.array(at), texts, 50, most)
    gone = {i: bytearray(400) for i, _ in rows}
    for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist()):
        gone[doc[r]][start[r] + a : start[r] + b] = b"\1" * (b - a)
    want = brute_spans(rows, 50)
    assert {i: sum(g) for i, g in gone.items()} == {i: w[1] for i, w in want.items()} and sum(map(sum, gone.values())) > 5000


def test_unequal_spans_of_one_hash_stay(spark):
    a, b = "dwtgmlqucavltalsfyxaaoyjfkaflmggflhavoqezwdissykvr", "slqcjtwbnpchtyxfmpxiuuoyvheiewoyJ`@&uTR(zwdissykvr"
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert len({r[0] for r in docs.selectExpr("xxhash64(cast(text as binary))").collect()}) == 1
    assert {r.doc_id: r.n_removed for r in repeated_spans.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 50}
