import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rarevar_spark.llm import private_data as P
from rarevar_spark.llm import queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base(text):
    out = []
    for k, kind in enumerate(P.KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


NOTHING = P.Selector(0.0, [], {})


def found(spark, texts, selector=NOTHING):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [([tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in P.find_private(df, selector).orderBy("doc_id").collect()]


def test_base_formats(spark):
    rng = random.Random(0)
    parts = ["a", "Z9", "@", ".", "..", "_", "-", "+", "%", " ", "(", ")", "1", "23", "255", "256", "000255", "4111 1111 1111 1111", "4111111111111112", "+1 (614) 555-8001", "x@y.z", "é", "日", "\n", "\t", "1.2.3.4", "𝒳"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "a@b.c.@d.e", "a@b.c@d.e", "@a@b.c", "1.2.3.4.5.6.7.8", "+1+23456789012", None, "", "a@b.c" * 300]
    got = found(spark, texts)
    assert [g[0] for g in got] == [base(t) for t in texts]
    assert all(b == s for b, s in got) and sum(len(b) for b, _ in got) > 500


def test_very_long_texts_take_one_pass(spark):
    texts = ["a" * 3_000_000, "1." * 700_000, "1 " * 700_000, "+" * 200_000 + "1" * 200_000, ("x@y.z, 10.0.0.1 " * 20_000), "a@" * 200_000, "1" + " " * 500_000 + "2", "a.b@c" + ".d" * 300_000]
    got = found(spark, texts)
    for (b, _), text in zip(got[4:], texts[4:]):
        assert b == base(text)
    assert got[0][0] == [] and len(got[1][0]) == 175_000 and got[2][0] == []


def corpus(rng, n):
    """Base formats with context, plain numbers that are none, and no other form."""
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        head = "4" + digit(14)
        return next(head + c for c in "0123456789" if luhn(head + c))

    for _ in range(n):
        yield rng.choice([
            f"call me at +1 ({digit(3)}) 555-{digit(4)} today", f"mail to user{digit(2)}@mail{digit(1)}.example.com please", f"paid by card {card()} now", f"host at {rng.randrange(256)}.{rng.randrange(256)}.3.7 is up",
            f"order no {digit(9)} was sent", f"version {digit(3)}.{digit(3)}.{digit(3)}.{digit(4)} of it", f"ref {digit(16)}", f"foo@{digit(2)} bar", "nothing here at all",
        ])


def test_trees_select_forms_without_the_base_mark(spark):
    texts = list(corpus(random.Random(5), 3000))
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    selector = P.fit_selector(train)
    assert set(selector.thresholds) == {0, 1, 2, 3} and selector == P.fit_selector(train.repartition(3))
    more = ["call me at 1 (614) 555-8001 today", "mail to user12 (at) mail4 (dot) example (dot) com please", "host at 10[.]20[.]3[.]7 is up", "order no 123456789 was sent", "ref 4111111111111112", "nothing here", "x call 1 (614) 555-8001x"]
    got = found(spark, more, selector)
    assert all(b == [] for b, _ in got)
    spans = [[(P.KINDS[k], t[a:e]) for a, k, e in s] for (_, s), t in zip(got, more)]
    assert spans == [[("phone", "1 (614) 555-8001")], [("email", "user12 (at) mail4 (dot) example (dot) com")], [("ip", "10[.]20[.]3[.]7")], [], [], [], []]
    own = found(spark, texts, selector)
    assert [b for b, _ in own] == [base(t) for t in texts]
    assert all(set(b) <= set(s) for b, s in own) and sum(len(s) - len(b) for b, s in own) < 0.01 * len(texts)


def test_overlapping_candidates_leave_the_best(spark):
    always = P.Selector(0.0, [("kind", 2, 0.5, 0.25)], {2: -9.0, 3: -9.0})  # cards above phones
    assert found(spark, ["a 4111111111112 b"], always)[0][1] == [(2, 2, 15)]
    mixed = found(spark, ["x@y.zz 4111111111111 10.0.0.1"], always)[0]
    assert mixed[0] == base("x@y.zz 4111111111111 10.0.0.1") and all(a[2] <= b[0] for a, b in zip(mixed[1], mixed[1][1:]))


def test_boosting_fits_cells():
    cell = lambda **kw: dict.fromkeys(P.FEATURES, -1) | kw
    cells = [(cell(digits=d, groups=g), *((90, 10) if d == 16 and g > 1 else (5, 95))) for d in (12, 16) for g in (1, 2, 3)]
    start, trees = P.boost(cells, rounds=60)
    s = P.Selector(start, trees, {})
    for f, a, b in cells:
        assert 1 / (1 + 2.718281828 ** -s.raw(f)) == pytest.approx(a / (a + b), abs=0.06)
    assert P.boost([]) == (0.0, []) and P.boost([(cell(), 3, 1)])[1] == []


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.fit_selector(empty) == P.Selector(0.0, [], {}) and P.find_private(empty).collect() == []
    rows = [(None, "a@b.cc", "old", 1), (1, None, "x", 2), (1, None, "x", 2), (2, "", "y", 3)]
    out = P.find_private(spark.createDataFrame(rows, "doc_id long, text string, spans string, found int"))
    assert out.columns == ["doc_id", "text", "found", "base", "spans"]
    assert sorted((r.found, len(r.base), len(r.spans)) for r in out.collect()) == [(1, 1, 1), (2, 0, 0), (2, 0, 0), (3, 0, 0)]
    text = "é to a@b.cc and +1 (614) 555-8001."
    r = P.find_private(spark.createDataFrame([(1, text)], "doc_id long, text string"), NOTHING).select(P.redacted(F.col("text"), F.col("spans")).alias("t"), P.spelt(F.col("spans")).alias("s")).first()
    assert (r.t, r.s) == ("é to [email] and [phone].", "email:5:11,phone:16:33")
    both = F.expr("array(named_struct('start', 0L, 'kind', 1, 'end', 5L), named_struct('start', 3L, 'kind', 0, 'end', 8L), named_struct('start', 9L, 'kind', 2, 'end', 10L))")
    assert spark.range(1).select(P.redacted(F.lit("0123456789z"), both)).first()[0] == "[ip]8[card]z"


def test_query(spark):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.op12_pii(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in b) for i in range(4)]
        spelt = ",".join(f"{P.KINDS[k]}:{a}:{e}" for a, k, e in b)
        assert r.base_sha256 == hashlib.sha256(spelt.encode()).hexdigest() and set(spelt.split(",")) <= set(r.spans.split(","))
