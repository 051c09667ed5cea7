"""Personal data in texts: base formats, and further spans chosen among candidates by boosted trees.

Everything on the texts is column expressions, without a shuffle; very long texts are searched by patterns that never go back over what they have
read. Generators propose candidates of high recall, which may overlap: mail addresses written around the at-sign, numbers
in groups, quads in brackets. Candidates that have a base format and pass its check are the positive examples. Their features leave out
what alone makes the base format (the at-sign, the plus), so that the trees know the others by format and context. Features are a few small
numbers, so the whole corpus is summed into a table of cells, of which there are at most some ten thousand whatever the input; trees and thresholds
are fitted on these on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
#: The base formats. Java's possessive loops, and starts only where a run begins, keep them to one pass; the matches are those of the plain formats
#: (``\G``: a mail address may begin right after another).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OPEN, _SHUT = r" ?[\[({]", r"[\])}] ?"
#: The generators: name, pattern, what a text must hold to be searched, kinds that it proposes.
GENERATORS = [
    ("mail", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|{_OPEN}(?:at|AT|@){_SHUT})[A-Za-z0-9-]++(?:(?:\.|{_OPEN}(?:dot|DOT|\.){_SHUT})[A-Za-z0-9-]++)*+", r"@|[\[({](?:at|AT)[\])}]", ["email"]),
    ("number", r"(?<![A-Za-z0-9])[+(]?[0-9](?:[ ().-]{0,3}+[0-9]){6,}+", "[0-9]", ["card", "phone"]),
    ("quad", rf"(?<![0-9])[0-9]{{1,3}}+(?:(?:\.|{_OPEN}(?:dot|DOT|\.){_SHUT})[0-9]{{1,3}}+){{3}}", "[0-9]", ["ip"]),
]
#: Words before a candidate, by what they speak of.
CONTEXT = [
    r"(?:mail|contact|kontakt|correo|contacto|call|phone|tel|telefon|t[ée]l[ée]phone|mobile|fax)[^a-z]*$",
    r"(?:card|visa|credit|payment|karte|carte|tarjeta)[^a-z]*$",
    r"(?:ip|host|server|addr|address|node)[^a-z]*$",
    r"(?:order|id|no|nr|invoice|version|isbn|ref|serial|ticket|license|commit)[^a-z]*$",
]
FEATURES = ["kind", "digits", "luhn", "groups", "parted", "octets", "context", "glued", "labels", "suffix", "local"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def occurrences(text: Column, pattern: str, block: int = 512) -> Column:
    """Array of (start, end, found, before, after): all matches from left to right, in code points, with up to 24 characters before and one after.

    Starts are running sums of what stands between matches and of the matches, by blocks, so that the work is in proportion to their number.
    """
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint, found: string, before: string, after: string>>)")

    def placed(v: Column) -> Column:
        found, between = v["found"], v["between"]
        lengths = F.transform(found, lambda x, i: (F.length(x) + F.length(between[i])).cast("long"))
        last = lambda a: F.element_at(a, -1)
        grow = lambda a, x: F.array_append(a, last(a) + x)
        zero = F.array(F.lit(0).cast("long"))

        def blocks(lens: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(lens, b * block + 1, F.lit(block)), zero, grow))

        def spans(w: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                at = F.floor(i / block).cast("int")
                start = w["bases"][at] + w["blocks"][at][F.pmod(i, F.lit(block))] + F.length(between[i])
                return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("found"), F.right(between[i], F.lit(24)).alias("before"), F.left(between[i + 1], F.lit(1)).alias("after"))

            return F.transform(found, one)

        sums = lambda b: F.struct(b.alias("blocks"), F.aggregate(b, zero, lambda a, x: grow(a, last(x))).alias("bases"))
        return let(lengths, lambda lens: let(blocks(lens), lambda b: let(sums(b), spans)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, empty).otherwise(
        let(F.struct(m.alias("found"), F.split(text, pattern, -1).alias("between")), placed)
    ))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _octets(s: Column) -> Column:
    """Every run of digits is a number of at most 255."""
    return ~F.exists(F.split(s, "[^0-9]+"), lambda x: let(F.ltrim(x, F.lit("0")), lambda y: (F.length(y) > 3) | ((F.length(y) == 3) & (y > "255"))))


def _passes(kind: str, found: Column) -> Column:
    """The check of a base format; what fails is dropped."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(found)
    n = F.length(_digits(found))
    return n.between(12, 19) & F.call_function("luhn_check", _digits(found)) if kind == "card" else n.between(9, 15)


def _span(kind: Column | int, x: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(kind).alias("kind") if isinstance(kind, int) else kind.alias("kind"), x["end"].alias("end"))


def base_spans(text: Column) -> Column:
    """Array of (start, kind: index in ``KINDS``, end) of the base formats, by start, then kind."""
    has = {"email": text.contains("@"), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}

    def found(i: int, kind: str) -> Column:
        passing = F.filter(occurrences(text, BASE[kind]), lambda x: _passes(kind, x["found"]))
        return F.coalesce(F.when(has[kind], F.transform(passing, lambda x: _span(i, x))), F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)"))

    return F.array_sort(F.concat(*(found(i, k) for i, k in enumerate(KINDS))))


def _features(kind: int, x: Column) -> Column:
    """Small numbers for one candidate; -1 where a kind has no such feature."""
    s, before = x["found"], F.lower(x["before"])
    digits, number, mail = _digits(s), kind in (2, 3), kind == 0
    none = F.lit(-1)
    context = F.coalesce(*(F.when(before.rlike(p), i + 1) for i, p in enumerate(CONTEXT)), F.lit(0))
    glued = x["after"].rlike("[A-Za-z0-9@_]").cast("int") + 2 * before.rlike("[a-z0-9@_+./:=#-]$").cast("int")
    domain = F.regexp_replace(F.regexp_replace(F.lower(s), r"^[^@]*?(?:@| ?[\[({](?:at|@)[\])}] ?)", ""), r" ?[\[({](?:dot|\.)[\])}] ?", ".")
    local = F.length(F.regexp_extract(s, "^[A-Za-z0-9._%+-]*", 0))
    return F.struct(
        F.lit(kind).alias("kind"), (F.least(F.length(digits), F.lit(20)) if number else none).alias("digits"),
        (F.coalesce(F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)), F.lit(False)).cast("int") if number else none).alias("luhn"),
        (F.least(F.size(F.split(F.regexp_replace(s, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")), F.lit(6)) if number else none).alias("groups"),
        (F.when(s.contains("("), 3).when(s.contains("."), 2).when(s.rlike("[ -]"), 1).otherwise(0) if number else none).alias("parted"),
        (_octets(s).cast("int") if kind == 1 else none).alias("octets"), context.alias("context"), glued.alias("glued"),
        (F.least(F.size(F.split(domain, "[.]")), F.lit(4)) if mail else none).alias("labels"), (domain.rlike("[.][a-z]{2,6}$").cast("int") if mail else none).alias("suffix"),
        (F.when(local < 2, 0).when(local < 4, 1).when(local <= 32, 2).otherwise(3) if mail else none).alias("local"),
    )


def _is_base(kind: int, s: Column) -> Column:
    plain = {0: r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$", 1: r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$", 2: r"^[0-9](?:[ -]?[0-9])+$", 3: r"^\+[0-9][ ().0-9-]+[0-9]$"}[kind]
    return s.rlike(plain) & _passes(KINDS[kind], s)


def candidates(text: Column) -> Column:
    """Array of (start, end, kind, features, positive) of all proposals; they may overlap."""

    def proposed(a: Column, kind: int) -> Column:
        lengths = {2: (12, 19), 3: (7, 15)}.get(kind)
        fit = F.filter(a, lambda x: F.length(_digits(x["found"])).between(*lengths)) if lengths else a
        return F.transform(fit, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), _features(kind, x).alias("features"), _is_base(kind, x["found"]).alias("positive")))

    def of_all_kinds(kinds: list[str]) -> Callable[[Column], Column]:
        return lambda a: F.concat(*(proposed(a, KINDS.index(k)) for k in kinds))

    parts = [F.when(text.rlike(need), let(occurrences(text, pattern), of_all_kinds(kinds))) for _, pattern, need, kinds in GENERATORS]
    fields = ", ".join(f"{f}: int" for f in FEATURES)
    none = F.expr(f"cast(array() as array<struct<start: bigint, end: bigint, kind: int, features: struct<{fields}>, positive: boolean>>)")
    return F.concat(*(F.coalesce(p, none) for p in parts))


@dataclass
class Selector:
    """Boosted trees of two levels over the features, and for each kind the score from which candidates are taken (none: never)."""

    start: float
    trees: list[tuple]
    thresholds: dict[int, float]

    def raw(self, features) -> float:
        return self.start + sum(self._leaf(t, features) for t in self.trees)

    @staticmethod
    def _leaf(tree, features) -> float:
        while isinstance(tree, tuple):
            name, most, low, high = tree
            tree = low if features[name] <= most else high
        return tree

    def column(self, features: Column) -> Column:
        """The sum of the leaves, as one expression."""

        def leaf(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            name, most, low, high = tree
            return F.when(features[name] <= most, leaf(low)).otherwise(leaf(high))

        return sum((leaf(t) for t in self.trees), F.lit(float(self.start)))

    def takes(self, candidate: Column) -> Column:
        raw, out = self.column(candidate["features"]), F.lit(False)
        for kind, least in sorted(self.thresholds.items()):
            out = F.when(candidate["kind"] == kind, raw >= least).otherwise(out)
        return out


def boost(cells: list[tuple[dict, int, int]], rounds: int = 30, rate: float = 0.4, ridge: float = 1.0) -> tuple[float, list[tuple]]:
    """Gradient boosting of the logistic loss on (features, positive, negative) cells: the start and trees of two levels, by Newton steps."""
    pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = math.log((pos + 1) / (neg + 1))
    raw = [start] * len(cells)
    cuts = [(name, v) for name in FEATURES for v in sorted({c[0][name] for c in cells})[:-1]]
    trees = []
    for _ in range(rounds if cuts else 0):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        g = [a - (a + b) * q for (_, a, b), q in zip(cells, p)]
        h = [(a + b) * q * (1 - q) for (_, a, b), q in zip(cells, p)]
        gain = lambda i: sum(g[j] for j in i) ** 2 / (sum(h[j] for j in i) + ridge)

        def grow(rows: list[int], depth: int):
            best = None
            for name, v in cuts if depth else ():
                low, high = [j for j in rows if cells[j][0][name] <= v], [j for j in rows if cells[j][0][name] > v]
                if low and high and (best is None or gain(low) + gain(high) > best[0] + 1e-9):
                    best = gain(low) + gain(high), name, v, low, high
            if best is None or best[0] <= gain(rows) + 1e-9:
                step = rate * sum(g[j] for j in rows) / (sum(h[j] for j in rows) + ridge)
                for j in rows:
                    raw[j] += step
                return step
            return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)

        trees.append(grow(list(range(len(cells))), 2))
    return start, trees


def fit_selector(docs: DataFrame, precision: float = 0.95, rounds: int = 30) -> Selector:
    """Trees and thresholds of the candidates in ``docs`` (doc_id, text).

    All candidates count, summed by features. A fifth of the texts, by their hash, is held out: for each kind, the threshold is the lowest score
    down to which at least ``precision`` of these candidates are positive, one more negative assumed. A kind without positives takes nothing.
    """
    held = F.pmod(F.crc32(F.encode("text", "utf-8")), F.lit(5)) == 0
    c = docs.where("text is not null").select(held.alias("held"), F.explode(candidates(F.col("text"))).alias("c")).select("held", "c.positive", "c.features.*")
    count = lambda *conditions: F.count_if(F.expr(" and ".join(conditions)))
    cells = c.groupBy(*FEATURES).agg(count("not held", "positive").alias("a"), count("not held", "not positive").alias("b"), count("held", "positive").alias("x"), count("held", "not positive").alias("y")).collect()
    cells = sorted((tuple(r[f] for f in FEATURES), r["a"], r["b"], r["x"], r["y"]) for r in cells)
    cells = [(dict(zip(FEATURES, k)), *n) for k, *n in cells]
    start, trees = boost([c[:3] for c in cells if c[1] + c[2]], rounds)
    selector, thresholds = Selector(start, trees, {}), {}
    for kind in range(len(KINDS)):
        seen = sorted(((selector.raw(f), x, y) for f, _, _, x, y in cells if f["kind"] == kind and x + y), reverse=True)
        good = bad = 0
        for i, (score, x, y) in enumerate(seen):
            good, bad = good + x, bad + y
            if (i + 1 == len(seen) or seen[i + 1][0] < score) and good >= precision * (good + bad + 1):
                thresholds[kind] = score - 1e-9
    return Selector(start, trees, thresholds)


def find_private(docs: DataFrame, selector: Selector | None = None, precision: float = 0.95) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind: index in ``KINDS``, end), by start, then kind; code points, end exclusive.

    ``base`` has the base formats, leftmost and without overlaps within a kind, that pass their checks. ``spans`` has these, and the candidates that
    ``selector`` (fitted on ``docs`` if none is given) takes, overlap no base span, and score best among those that they overlap
    (ties: the first, then the first kind). Candidates glued to letters, digits or at-signs are never taken.

    A null text is an empty one and has none; repeated rows are each their own; texts of any length are searched whole; other columns
    stay, but those named ``base`` or ``spans`` are replaced; an empty table stays empty.
    """
    if selector is None:
        selector = fit_selector(docs.select("text"), precision)
    text = F.coalesce("text", F.lit(""))
    scored = lambda c: F.struct((-selector.column(c["features"])).alias("rank"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    taken = F.transform(F.filter(candidates(text), lambda c: ~c["positive"] & (c["features"]["glued"] == 0) & selector.takes(c)), scored) if selector.thresholds else None
    out = docs.drop("base", "spans").withColumn("base", base_spans(text))
    if taken is None:
        return out.withColumn("spans", F.col("base"))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = lambda t: F.filter(t, lambda c: ~F.exists(F.col("base"), lambda b: meets(b, c)))
    best = lambda t: F.filter(t, lambda c: ~F.exists(t, lambda d: meets(c, d) & (d < c)))
    more = let(taken, lambda t: F.when(F.size(t) == 0, F.col("base")).otherwise(F.array_sort(F.concat(F.col("base"), F.transform(let(free(t), best), lambda c: _span(c["kind"], c))))))
    return out.withColumn("spans", more)


def spelt(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with ``[kind]`` in the place of each span; of overlapping spans, the name of the first stands for all."""
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    first = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def add(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] < a["at"], F.struct(a["text"].alias("text"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(F.struct(F.concat(a["text"], gap, names[s["kind"]]).alias("text"), s["end"].alias("at")))

    return F.aggregate(spans, first, add, lambda a: F.concat(a["text"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
