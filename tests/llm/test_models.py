import numpy as np
import pytest
import public_tokenizers

from rarevar_spark.llm import language_id as L
from rarevar_spark.llm import quality_mil as Q

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_forward_sums_all_segmentations():
    vocabulary = {b"a": 0, b"b": 1, b" ": 2, b"ab": 3, b" a": 4, b"ba": 5, b" ab": 6}
    rng = np.random.default_rng(0)
    p = rng.random((7, 2))

    def total(s, lang):
        return 1.0 if not s else sum(p[i, lang] * total(s[len(k) :], lang) for k, i in vocabulary.items() if s.startswith(k))

    words = ["a", "ab", "aba", "abab", "bbab"]
    pieces = L.Pieces(vocabulary)
    got = L.log_likelihoods(words, pieces, p)
    for w, row in zip(words, got):
        assert np.exp(row) == pytest.approx([total(b" " + w.encode(), k) for k in (0, 1)])
    # a run of letters of any length, beyond what a double holds unscaled
    long = "ab" * 3000
    whole = b" " + long.encode()
    logs = np.full((len(whole) + 1, 2), -np.inf)
    logs[0] = 0
    for e in range(1, len(whole) + 1):
        steps = [logs[e - len(k)] + np.log(p[i]) for k, i in vocabulary.items() if whole[:e].endswith(k)]
        logs[e] = np.logaddexp.reduce(steps, axis=0)
    assert (logs[-1] < -800).any() and L.log_likelihoods(["a", long, "b"], pieces, p)[1] == pytest.approx(logs[-1], rel=1e-9)


def test_learning_raises_likelihood():
    vocabulary = L.read_vocabulary(VOCABULARY)
    counts = {("x", w): n for w, n in (("thing", 5), ("other", 3), ("nation", 2))} | {("y", w): 4 for w in ("maison", "être", "nation")}
    scores = []
    for rounds in (1, 2, 4):
        p = L.learn_pieces(counts, ["x", "y"], vocabulary, rounds=rounds, smoothing=1e-9)
        assert p.sum(axis=0) == pytest.approx([1, 1])
        scores.append(sum(n * L.log_likelihoods([w], L.Pieces(vocabulary), p)[0, int(lang == "y")] for (lang, w), n in counts.items()))
    assert scores == sorted(scores)


def test_language_edges(spark):
    rng = np.random.default_rng(1)
    en, de = "the and of that thing nation water other house".split(), "der und nicht eine straße haus wasser über schön".split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else de, 30)), "en" if i % 2 else "de", "s") for i in range(120)]
    rows += [(200, None, "en", "s"), (201, "", "en", "s"), (202, "123 456 !!", "en", "s"), (203, "the nation 12", None, "s"), (204, " ".join(["straße"] * 50_000), "de", "s"), (205, "²½", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in L.language_of(docs, VOCABULARY).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == r[2] for i, r in enumerate(rows[:120]))
    assert [got[i].lang_pred for i in (200, 201, 202, 203, 204, 205)] == ["und", "und", "und", "en", "de", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = L.keep_identified(docs, VOCABULARY)
    assert kept.columns == docs.columns and kept.count() == 122
    assert L.language_of(docs.limit(0), VOCABULARY).count() == 0
    twice = spark.createDataFrame([*rows[:120], rows[0], (300, "ab " * 9, "xx", "s"), (301, "straße" * 2000, None, "s"), (302, "the straße", None, "s")], "doc_id long, text string, lang string, score string")
    again = L.language_of(twice, VOCABULARY).collect()  # repeated rows, a language of one text, a very long run, a clashing name
    assert len(again) == 124 and {r.lang_pred for r in again if r.doc_id == 0} == {"de"}
    assert {r.doc_id: r.lang_pred for r in again}[301] == "de"
    assert {r.lang_pred for r in L.language_of(docs.where("lang is null"), VOCABULARY).collect()} == {"und"}, "no language learned"


def test_training_in_tasks_equals_training_on_all_counts(spark):
    """Every word counts, however many there are and however rare and long they are."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join("".join(rng.choice(list("abcdeäß"), rng.integers(1, 9))) for _ in range(60)) + (" " + "abc" * 900 if i == 5 else ""), "xy"[i % 2]) for i in range(300)]
    docs, vocabulary = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), L.read_vocabulary(VOCABULARY)
    counts = {}
    for _, text, lang in rows:
        for w in L.words_of(text):
            for i in range(0, len(w), 2048):
                counts[lang, w[i : i + 2048]] = counts.get((lang, w[i : i + 2048]), 0) + 1
    assert len(counts) > 8000
    languages, p = L.train(docs, vocabulary, rounds=2)
    assert languages == ["x", "y"] and np.allclose(p, L.learn_pieces(counts, languages, vocabulary, rounds=2), rtol=1e-9)


def test_languages_are_learned_each_from_its_own_words(spark):
    """A language of few documents keeps its words beside one of many, ties go to the language first by name."""
    rows = [(i, " ".join(f"thing{chr(97 + i % 26)}{chr(97 + k)}" for k in range(26)), "en") for i in range(400)] + [(1000 + i, "fjord skål", "no") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, p = L.train(docs, L.read_vocabulary(VOCABULARY))
    assert languages == ["en", "no"]
    got = {r.doc_id: r.lang_pred for r in L.identify(docs, languages, p, L.read_vocabulary(VOCABULARY)).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    even = np.repeat(p[:, :1], 2, axis=1)
    assert {r.lang_pred for r in L.identify(docs.limit(3), languages, even, L.read_vocabulary(VOCABULARY)).collect()} == {"en"}


def plain_score(w, bag):
    """The probability of one document, passage by passage and unit by unit."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    encoded, weight = [], []
    for x in bag:
        z = [(x[i] - w["mean"][i]) / w["scale"][i] for i in range(len(x))]
        h = [np.tanh(sum(z[i] * w["E"][i, j] for i in range(len(z))) + w["e"][j]) for j in range(w["E"].shape[1])]
        gate = [np.tanh(sum(h[j] * w["V"][j, k] for j in range(len(h)))) * sigmoid(sum(h[j] * w["U"][j, k] for j in range(len(h)))) for k in range(w["V"].shape[1])]
        encoded.append(h)
        weight.append(np.exp(sum(gate[k] * w["a"][k] for k in range(len(gate)))))
    pooled = [sum(a * h[j] for a, h in zip(weight, encoded)) / sum(weight) for j in range(len(encoded[0]))]
    return sigmoid(sum(p * c for p, c in zip(pooled, w["c"])) + w["d"][0])


def test_gradient():
    rng = np.random.default_rng(3)
    x, of, y = rng.normal(size=(12, Q.N_FEATURES)), np.repeat([0, 1, 2], [4, 7, 1]), np.array([1.0, 0.0, 1.0])
    w = Q.fit(x, of, y, width=5, gates=4, epochs=200)
    p = Q.score(w, x, of, 3)
    assert ((p > 0.5) == (y == 1)).all()
    assert p == pytest.approx([plain_score(w, x[of == k]) for k in range(3)])
    # a bag's score doesn't depend on the order of its passages
    turned = np.concatenate([np.arange(4)[::-1], np.arange(4, 12)])
    assert Q.score(w, x[turned], of, 3) == pytest.approx(p)
    w = Q.fit(x, of, y, width=5, gates=4, epochs=1)
    loss = lambda: -(y * np.log(q := Q.score(w, x, of, 3)) + (1 - y) * np.log(1 - q)).sum()
    f = Q._forward(w, x, of, 3)
    for name, g in Q.gradient(w, f, of, f["p"] - y).items():
        for at in [np.unravel_index(i, w[name].shape) for i in range(min(w[name].size, 15))]:
            was, side = w[name][at], []
            for step in (1e-6, -1e-6):
                w[name][at] = was + step
                side.append(loss())
            w[name][at] = was
            assert g[at] == pytest.approx((side[0] - side[1]) / 2e-6, rel=1e-4, abs=1e-8), name


def test_quality(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "ka lo mi ne su".split() for b in "ra ti von de".split()]
    good = lambda: ". ".join(" ".join(rng.choice(words, 9)).capitalize() for _ in range(rng.integers(1, 30)))
    bad = lambda: " ".join(f"{w}###" for w in rng.choice(words, 40)) if rng.random() < 0.5 else " ".join([rng.choice(words)] * 60)
    rows = [(i, good() if i % 2 else bad(), "en") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1, 0), (7, None), (900, 1)], "doc_id long, quality int")
    rows += [(500, None, "en"), (501, "", "en"), (502, " \n ", "en"), (503, " ".join(words * 3000), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(3)
    got = {r.doc_id: r for r in Q.quality(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    twice = Q.quality(docs.unionByName(docs.where("doc_id < 9")), labels).collect()  # repeated rows are scored each, and alike
    assert len(twice) == len(rows) + 9 and len({(r.doc_id, round(r.score, 9)) for r in twice}) == len(rows)
    few = Q.train(docs.where(~Q.held_out()), labels, sample_passages=40)  # the long documents don't fit in
    assert few is not None and Q.train(docs.where(~Q.held_out()), labels, sample_passages=0) is None
    held = [r for i, r in got.items() if r.held_out and i < 300]
    assert held and np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held]) > 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert {r.score for r in Q.quality(docs, labels.where("quality = 1 and doc_id != 1")).collect()} == {0.5}, "nothing to learn from"
    assert Q.quality(docs.limit(0), labels).count() == 0
