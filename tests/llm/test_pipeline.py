import importlib.util
import random

import corpus_pipeline
from rarevar_spark.llm import language_id, ngram_join


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    en, de = [f"{a}{b}" for a in "the and of that water".split() for b in ("", "ing", "s", "ly")], [f"{a}{b}" for a in "der und nicht haus straße".split() for b in ("", "en", "lich", "ung")]
    sentence = lambda w, n: " ".join(rng.choices(w, k=n)).capitalize() + "."
    rows = []
    for i in range(150):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, "\n".join(sentence(de if lang == "de" else en, 25) for _ in range(4)), lang))
    item = "quick brown foxes jump over lazy dogs while seven wizards brew strange potions under green lamps"
    rows += [(200, rows[0][1], "de"), (201, rows[1][1].replace("\n", " ") , "en"), (202, rows[1][1].replace("\n", " ") + " Last.", "en"), (203, sentence(en, 20) + "\n" + item + "\n" + sentence(en, 20), "en"), (204, "12 34", "en"), (205, None, "en"), (206, "", "de")]
    docs = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, left = docs, [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        out = tmp_path / name
        at.write.parquet(str(out))
        at = spark.read.parquet(str(out))
        assert at.columns == docs.columns
        left.append({r.doc_id for r in at.collect()})
    assert left[0] - left[1] == {204, 205, 206}
    assert left[1] - left[2] == {200}, "a copy of which no line is left"
    assert left[2] - left[3] == {201, 202}
    assert left[3] - left[4] == {203}
    texts = dict((r.doc_id, r.text) for r in at.collect())
    assert all(texts[i] == t for i, t, _ in rows[:150]), "clean documents stay as they are"
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == left[4]
    again = language_id.keep_identified(at, corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert again.count() == at.count()
    assert ngram_join.keep_one_of_each(at).count() == at.count()


def test_stage_edges(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows, a very long text and columns of the operators' own names."""
    spark.createDataFrame([(1, "five words of one item"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, rep long, gone_ array<int>, score double"
    words = "the and of that water with from house under stone".split()
    long = "\n".join(" ".join(words[(i * k + k) % 10] for k in range(1, 9)) + f" {i}" for i in range(4000))
    rows = [(i, " ".join(words[(i + k) % 10] for k in range(30)) + f" number {i}", "en" if i % 5 else None, "s", 99, 1, [1], 0.5) for i in range(20)]
    rows += [rows[3], (30, long, "en", None, None, None, None, None), (31, None, "en", "s", 0, 1, None, None), (32, "", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert ids.count(3) in (0, 2) and 30 in ids, name
        assert (31 in ids and 32 in ids) == (name != "language"), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.doc_id == 3 for r in packed) == 2 and {31, 32} < {r.doc_id for r in packed}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names and sum(n.startswith("op") for n in names) == 13
    assert importlib.util.find_spec("corpus_pipeline") is not None and len(corpus_pipeline.STAGES) == 5
    assert set(entry.oracle_sql()) <= names
