import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rarevar_spark.llm import decontaminate, fingerprints, packing
from rarevar_spark.llm import license_scan as S

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_packing_fit():
    rng = np.random.default_rng(0)
    for lengths in (np.clip(rng.lognormal(6, 1, 5000).astype(int), 1, 4096), np.array([4096] * 5), np.array([1]), np.array([2049] * 7), np.array([1365] * 9)):
        n, c = np.unique(lengths, return_counts=True)
        histogram = dict(zip(n.tolist(), c.tolist()))
        patterns = packing.fit_patterns(histogram, 4096)
        got = {}
        for p, times in patterns:
            assert sum(p) <= 4096 and times > 0
            for x in p:
                got[x] = got.get(x, 0) + times
        assert got == histogram
        assert sum(t for _, t in patterns) <= 1.02 * lengths.sum() / 4096 + 1 or (lengths > 2048).mean() > 0.5
    assert packing.fit_patterns({}, 4096) == []


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 5)), np.array([3.0, 0, 2, 0, 7])
    assert packing.nnls(a, a @ x, 20_000) == pytest.approx(x, abs=0.05)


def test_ranks_give_the_ids_of_the_merges():
    """Every token comes out of its own symbols alone as one token, by merges of pairs, and no merge is of a lower rank than its parts'."""
    with open(WORD_BPE, encoding="utf-8") as f:
        model = json.load(f)["model"]
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    made = {"".join(m): i for m, i in rank.items()}
    assert len(made) == len(rank)
    assert all(made.get(part, -1) < i for m, i in rank.items() for part in m)
    end = model["end_of_word_suffix"]
    for token in made:
        core = token.removesuffix(end)
        s = [*core[:-1], core[-1] + token[len(core) :]]
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: rank.get((s[i], s[i + 1]), 1 << 30))
            assert (s[best], s[best + 1]) in rank, token
            s[best : best + 2] = [s[best] + s[best + 1]]
        assert s == [token]
    ranks, ids = packing.word_ranks(WORD_BPE)
    assert len(ranks) >= len(made) + 512 and len(set(ranks.values())) == len(ranks)


def test_part_encoder_forgets(tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdeéßñthing", k=rng.randint(1, 12))) + rng.choice(["", ".", ",", "***", "!?", "'s", "1"]) for _ in range(30)) for _ in range(300)]
    tok, encoder = Tokenizer.from_file(WORD_BPE), packing.PartEncoder(WORD_BPE, remembered=200)
    got = [b for i in range(0, 300, 7) for b in encoder.encode([t.encode() for t in texts[i : i + 7]])]
    assert got == [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


@pytest.mark.parametrize("capacity", [16, 4096])
def test_pack_documents(spark, capacity):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    odd = ["A,B. C.. d,, Don't won't. 'S X's", "Ⅷ ² İstanbul ΣΑΣ Σ. ǅ éa, ́x", "<|endoftext|> a<|startoftext|>, b", "tab\tnew\r\nline\x0bv nbsp ,　w", "한국어. 日本, é. 12,3. a_b."]
    texts = [" ".join(rng.choices("Alpha beta, gamma. delta EPSILON".split(), k=rng.randint(0, 60))) for _ in range(60)] + odd + [None, "", " ", "same", "same", "word " * 5000]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id int, text string, length int").repartition(3)
    got = packing.pack_documents(docs, WORD_BPE, capacity).toPandas().sort_values(["doc_id", "piece"])
    tok = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want += [(i, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert [tuple(r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)] == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= capacity
    assert packing.pack_documents(docs.limit(0), WORD_BPE).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "another"), (2, "a b c")], "doc_id long, text string")
    got = packing.pack_documents(twice, WORD_BPE).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == [(1, 0, 2), (1, 0, 4), (1, 0, 4), (2, 0, 4)] and sorted(r.offset for r in got) == [0, 4, 8, 12]


def test_decontamination(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(40)] + [(50, None), (51, "!!"), (52, "w1 w2"), (53, "w1 w2")]
    docs = []
    for i in range(150):
        w = rng.choices(words, k=rng.randint(0, 400))
        if i % 3 == 0:
            part = rng.choice(items[:40])[1].split()
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [part[0].upper() + ",", *part[1:]]
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "W1 w2."), (903, " ".join(words * 400) + " " + items[0][1])]

    def shingles(t):
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = {(i, k) for i, t in docs for k, q in items if shingles(q) and 5 * len(shingles(q) & shingles(t)) >= 4 * len(shingles(q))}
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (500_000, 60):  # in one block, and in many
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(d, b, block_shingles=size).collect()} == want
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.find_items(d, b.limit(0)).count() == 0 and decontaminate.find_items(d.limit(0), b).count() == 0


def test_next_ids(spark):
    rng = random.Random(7)
    for ids in ([5], [1, 2], [-(1 << 40), -1, 0, 3, 1 << 20, (1 << 62) + 1], rng.sample(range(10**9), 300), list(range(2000))):
        got = dict(fingerprints.next_ids(spark.createDataFrame([(i,) for i in ids], "id long")).collect())
        s = sorted(ids)
        assert got == dict(zip(s, [*s[1:], s[0]]))


def test_fingerprints(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 4, 5, 30, 300, 1500]))) for _ in range(40)] + [None, "", "  ", "é" * 9, "same text of five words", "Same  text of five words", " ".join(rng.choices(words, k=30_000))]
    rows = [(10 * i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)

    def jaccard(a, b):
        def s(t):
            w = t.lower().split()
            return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

        a, b = s(a), s(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    errors = []
    for k, (i, t, _) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, after)]
    assert np.abs(errors).max() < 0.2 and np.std(errors) < 0.05
    assert got[440].fingerprint == got[450].fingerprint and got[440].near_next == 1 and got[410].fingerprint == ""
    repeated = fingerprints.edited_fingerprints(docs.unionByName(docs.where("doc_id = 0")))
    assert repeated.count() == len(rows)
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "text of no id at all", "x"), (None, "text of no id at all", "x")], docs.schema)
    more = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs.unionByName(null)).collect()}
    assert len(more) == len(rows) + 1 and more[None].n_chars == 20 and more[0].fingerprint == got[0].fingerprint
    first = rows[0][1] or ""
    assert more[None].edited_sha256 == hashlib.sha256(("text of no id at all"[:15] + first[:5]).encode()).hexdigest()
    assert [r.doc_id for r in fingerprints.edited_fingerprints(null).collect()] == [None]


def test_low_bits_do_not_bias(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(rng.choice([5, 6, 40])))) for i in range(300)]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.agg(F.max("near_next")).first()[0] < 0.1, "texts without a shared shingle are not alike"


MIT = "Released under the MIT License."
GPL = "This work is licensed under the GNU General Public License, version 3."


def test_license_scan(spark):
    filler = "\n".join(f"ordinary words number {i} in a long file" for i in range(200))
    rows = [
        (1, "a/LICENSE", MIT), (2, "a/b/x.txt", filler), (3, "a/b/c/COPYING", GPL), (4, "a/b/c/d/y.txt", filler), (5, "a/b/z.txt", f"{filler}\n{GPL.upper()}\n{MIT}"),
        (6, "e/f.txt", filler), (7, None, None), (8, "", ""), (9, "a/b/w.txt", f"{filler}\n// {MIT} //"), (10, "a/ab.txt", filler), (11, "root.txt", filler),
    ]
    files = spark.createDataFrame([(*r, 0) for r in rows], "file_id long, path string, text string, score int").repartition(3)
    got = {r.file_id: (r.license, r.how, r.from_dir) for r in S.scan(files).collect()}
    assert got[1] == ("MIT", "file", None) and got[3] == ("GPL-3.0-only", "file", None)
    assert got[2] == ("MIT", "inherited", "a") and got[4] == ("GPL-3.0-only", "inherited", "a/b/c") and got[10] == ("MIT", "inherited", "a")
    assert got[5] == ("GPL-3.0-only", "header", None), "of equally near lines the first"
    assert got[9][:2] == ("MIT", "header")
    assert got[6] == got[7] == got[8] == got[11] == (None, "none", None)
    assert S.scan(files.limit(0)).count() == 0
    assert S.scan(files.unionByName(files.where("file_id = 1"))).where("file_id = 1").count() == 2


def test_license_texts(spark):
    """Standard texts as LICENSE files, in upper directories, and multi-line headers; files of a name with a notice alone."""
    texts = {name: text for name, text in S.TEXTS}
    code = "\n".join(f"call_{i}(value_{i % 7}, other)" for i in range(300))
    comment = lambda text: "/*\n" + "\n".join(f" * {' '.join(text.split()[i : i + 9])}" for i in range(0, len(text.split()), 9)) + "\n */"
    notice = [t for name, t in S.TEXTS if name == "GPL-3.0-or-later"][0].split("\n")
    rows = [
        (1, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + texts["MIT"]), (2, "m/src/deep/er/x.c", code), (3, "m/src/y.c", comment("Copyright 2021 Other. " + texts["Apache-2.0"]) + "\n\n" + code),
        (4, "b/LICENCE.txt", "Copyright (c) 2019, Name\n" + texts["BSD-3-Clause"]), (5, "b/z.c", code), (6, "g/COPYING", code + "\n\n" + "\n\n".join(notice) + "\n\n" + code), (7, "g/sub/w.c", code),
        (8, "i/LICENSE-ISC", texts["ISC"]), (9, "i/v.c", code), (10, "n/u.c", code), (11, "b/deep/LICENSE", "nothing of the kind"), (12, "b/deep/t.c", ""), (13, None, "long " * 200_000), (14, "i/v.c", code), (9, "i/v.c", code),
    ]
    got = {r.file_id: (r.license, r.how, r.from_dir) for r in S.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "file", None) and got[2] == ("MIT", "inherited", "m") and got[3] == ("Apache-2.0", "header", None)
    assert got[4] == ("BSD-3-Clause", "file", None) and got[5] == ("BSD-3-Clause", "inherited", "b") and got[12] == ("BSD-3-Clause", "inherited", "b")
    assert got[6] == ("GPL-3.0-or-later", "file", None) and got[7] == ("GPL-3.0-or-later", "inherited", "g")
    assert got[8] == ("ISC", "file", None) and got[9] == got[14] == ("ISC", "inherited", "i") and got[10] == got[13] == (None, "none", None)
    assert got[11] == ("BSD-3-Clause", "inherited", "b")


def test_license_titles(spark):
    """Licences of many pages by their titles: any name, versions apart, inherited; sentences about a licence and parts of titles are none."""
    page = "\n\n".join(" ".join(f"term{(i * 7 + j) % 91}" for j in range(60)) for i in range(40))
    notice = dict(S.TEXTS)["GPL-3.0-or-later"]
    rows, want = [], {}
    for k, (name, title) in enumerate(S.TITLES):
        cut = title.index(" Version") if " Version" in title else None
        head = title.upper() if cut is None else f"   {title[:cut].upper()}\n      {title[cut:]}"
        # further in: a notice of another licence, and a line that is a notice by itself
        rows += [(k, f"d{k}/page-{k}.md", f"\n{head}\n\n{page}\n\n{notice}\n\nAll rights reserved.\n\n{page}"), (1000 + k, f"d{k}/src/a.c", "int main")]
        want |= {k: (name, "file", None), 1000 + k: (name, "inherited", f"d{k}")}
    prose = "people say much about the GNU General Public License version 2 of June 1991 and other such texts in long sentences like this one here"
    rows += [(2000, "p/a.txt", f"{page}\n{prose}"), (2001, "p/b.txt", f"{page}\nGNU General Public License\n{page}"), (2002, "q/LICENSE", notice)]
    want |= {2000: (None, "none", None), 2001: (None, "none", None), 2002: ("GPL-3.0-or-later", "file", None)}
    rows += [(3000, "r/long.txt", ("words of a very long text\n" * 100_000) + "\n\nMozilla Public License Version 1.1\n")]
    want |= {3000: ("MPL-1.1", "file", None)}
    got = {r.file_id: (r.license, r.how, r.from_dir) for r in S.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == want


def test_license_anchors_lose_nothing():
    rng = random.Random(1)
    terms = sorted({t for c in S.template_terms(S.TEMPLATES) for t in c})
    shares = {t: rng.random() ** 4 for t in terms}
    idf, vectors, unknown = S.template_weights(S.TEMPLATES, shares)
    anchors = set(S.anchor_terms(idf, vectors, 0.6))
    for _ in range(3000):
        v = rng.choice(vectors)
        words = rng.sample(sorted(v), rng.randint(0, len(v))) + rng.choices(terms, k=rng.randint(0, 3))
        w = {t: words.count(t) * idf[t] for t in words}
        norm = sum(x * x for x in w.values()) ** 0.5
        if norm and sum(x * v.get(t, 0) for t, x in w.items()) / norm >= 0.6:
            assert anchors & set(words)
