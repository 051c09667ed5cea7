"""The canonical tables as views of the star-schema test tables, in SQL that Spark and DuckDB both read.

Customers are samples, parts variants, order lines calls, suppliers gene intervals. Names in braces are tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dealt

VIEWS = {
    "parts": """SELECT p_partkey, concat(p_brand, '_', p_type) AS gene_id, p_brand AS gene_symbol, CAST(21 + length(p_type) % 2 AS STRING) AS chrom,
        1000 + 10 * p_partkey AS pos, concat('chr', CAST(21 + length(p_type) % 2 AS STRING), ':', CAST(1000 + 10 * p_partkey AS STRING), ':A:G') AS variant_key,
        CASE WHEN p_size % 10 = 0 THEN 'LowQual' ELSE 'PASS' END AS filter FROM {part}""",
    "variants": "SELECT variant_key, chrom, CAST(pos AS BIGINT) AS pos, 'A' AS ref, 'G' AS alt, filter, CAST(p_partkey AS BIGINT) AS ord, CAST(p_partkey AS BIGINT) AS p_partkey FROM {parts}",
    "annotations": """SELECT variant_key, gene_id, gene_symbol FROM {parts}
        UNION ALL SELECT variant_key, concat(gene_symbol, '_X', chrom) AS gene_id, gene_symbol FROM {parts} WHERE p_partkey % 7 = 0""",
    "gene_ids": """SELECT DISTINCT gene_id, gene_symbol, chrom FROM {parts}
        UNION SELECT DISTINCT concat(gene_symbol, '_X', chrom) AS gene_id, gene_symbol, chrom FROM {parts}""",
    "genes": "SELECT gene_id, gene_symbol, chrom, CAST(row_number() OVER (PARTITION BY chrom ORDER BY gene_id) - 1 AS INT) AS order_index FROM {gene_ids}",
    "people": """SELECT CAST(c_custkey AS STRING) AS sample_id, CAST(c_custkey AS BIGINT) AS ord, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS site, r_name AS ancestry,
        CAST(c_acctbal AS DOUBLE) AS y0, o.y1, CAST(c_nationkey AS DOUBLE) AS x0
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT o_custkey, avg(CAST(o_totalprice AS DOUBLE)) / 1000 AS y1 FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey""",
    "raw_calls": """SELECT CAST(o_custkey AS STRING) AS sample_id, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS site, l_partkey,
        NOT bool_and(l_linestatus = 'F' AND l_returnflag = 'R' AND l_linenumber = 7) AS called, CAST(count(*) AS BIGINT) AS lines
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "available": """SELECT 'A' AS site, variant_key, chrom FROM {variants} WHERE p_partkey % 10 < 8
        UNION ALL SELECT 'B' AS site, variant_key, chrom FROM {variants} WHERE p_partkey % 10 < 6 OR p_partkey % 10 > 7""",
    "calls": """SELECT c.site, c.sample_id, v.variant_key, CAST(CASE WHEN c.called THEN least(2, c.lines) ELSE 0 END AS INT) AS dosage, c.called
        FROM {raw_calls} c JOIN {variants} v ON c.l_partkey = v.p_partkey JOIN {available} a ON a.variant_key = v.variant_key AND a.site = c.site""",
    "turned_calls": """SELECT c.site, c.sample_id, c.variant_key, c.dosage, c.called FROM {calls} c JOIN {variants} v ON v.variant_key = c.variant_key WHERE v.p_partkey % 50 != 3
        UNION ALL SELECT p.site, p.sample_id, a.variant_key, CAST(2 - coalesce(c.dosage, 0) AS INT) AS dosage, TRUE AS called
        FROM {eligible} p JOIN {available} a ON a.site = p.site JOIN {variants} v ON v.variant_key = a.variant_key AND v.p_partkey % 50 = 3
        LEFT JOIN {calls} c ON c.site = p.site AND c.sample_id = p.sample_id AND c.variant_key = a.variant_key WHERE coalesce(c.dosage, 0) < 2""",
    "typed_dosages": """SELECT sample_id, variant_key, CAST(CASE WHEN bought THEN (base + 1) % 3 ELSE base END AS INT) AS dosage FROM
        (SELECT p.sample_id, y.p_type AS variant_key, (length(p.ancestry) * (ascii(substr(y.p_type, 1, 1)) + 3 * ascii(substr(y.p_type, length(y.p_type), 1)) + length(y.p_type))) % 3 AS base, c.p_type IS NOT NULL AS bought
            FROM {people} p CROSS JOIN (SELECT DISTINCT p_type FROM {part}) y
            LEFT JOIN (SELECT DISTINCT r.sample_id, t.p_type FROM {raw_calls} r JOIN {part} t ON t.p_partkey = r.l_partkey) c ON c.sample_id = p.sample_id AND c.p_type = y.p_type)""",
    "typed_variants": """SELECT p_type AS variant_key, CAST(21 + length(p_type) % 2 AS STRING) AS chrom, CAST(1000 + 10 * min(p_partkey) AS BIGINT) AS pos, CAST(min(p_partkey) AS BIGINT) AS ord FROM {part} GROUP BY p_type""",
    "placed_consequences": """SELECT v.chrom, v.pos, v.ref, v.alt, c.gene_id, c.gene_symbol, c.mane, c.lof, c.ord
        FROM {consequences} c JOIN {variants} v ON c.variant_key = concat('v', CAST(v.p_partkey AS STRING))""",
    "asked_variants": """SELECT p_partkey, chrom, CASE WHEN p_partkey % 5 = 3 THEN pos + 1 ELSE pos END AS pos, CASE WHEN p_partkey % 5 = 1 THEN 'C' ELSE ref END AS ref,
        CASE WHEN p_partkey % 7 = 0 THEN 'T,G' WHEN p_partkey % 7 = 1 THEN 'G,G' WHEN p_partkey % 7 = 2 THEN 'T' ELSE alt END AS alt,
        CASE WHEN p_partkey % 2 = 0 THEN substr(variant_key, 4) ELSE variant_key END AS variant_key FROM {variants}
        UNION ALL SELECT p_partkey, chrom, pos, ref, alt, variant_key FROM {variants} WHERE p_partkey % 11 = 0""",
    "eligible": "SELECT sample_id, ord, site, ancestry, y0, y1, x0 FROM {people} WHERE y1 IS NOT NULL",
    "consequences": """SELECT concat('v', CAST(l_partkey AS STRING)) AS variant_key, concat('g', CAST(l_suppkey AS STRING)) AS gene_id, concat('s', CAST(l_suppkey AS STRING)) AS gene_symbol,
        CASE WHEN l_linestatus = 'F' THEN 'NM' WHEN l_linenumber % 2 = 0 THEN '.' ELSE '' END AS mane, CASE WHEN l_returnflag = 'R' THEN 'HC' ELSE 'LC' END AS lof, CAST(l_orderkey AS BIGINT) * 100 + l_linenumber AS ord FROM {lineitem}""",
    "intervals": "SELECT CAST(21 + s_suppkey % 2 AS STRING) AS chrom, CAST(100 * s_suppkey AS BIGINT) AS start, CAST(100 * s_suppkey + 250 AS BIGINT) AS \"end\", s_name AS gene_id, s_name AS gene_symbol FROM {supplier}",
    "results": """SELECT a.ancestry, g.chrom AS chromosome, g.order_index AS gene_index, g.gene_id, h.phenotype_index, h.phenotype_name,
        (((g.order_index + 1) * (37 + h.phenotype_index) * length(a.ancestry) + length(g.gene_id) * 13) % 9973 + 1) / 1e4 AS p_a,
        CASE WHEN g.order_index % 17 = 3 THEN CAST('NaN' AS DOUBLE) ELSE (((g.order_index + 1) * (37 + h.phenotype_index) * length(a.ancestry) + length(g.gene_id) * 13) % 9973 + 1 + g.order_index % 5) / 1.001e4 END AS p_b,
        CAST(CASE WHEN g.order_index % 11 = 0 THEN 0 ELSE 1 END AS STRING) AS converged
        FROM {genes} g CROSS JOIN (SELECT DISTINCT r_name AS ancestry FROM {region}) a
        CROSS JOIN (SELECT 0 AS phenotype_index, 'acctbal' AS phenotype_name UNION ALL SELECT 1 AS phenotype_index, 'totalprice' AS phenotype_name) h""",
    "metrics": """SELECT concat('anc', CAST(user_id % 3 AS STRING)) AS ancestry, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'chromosome_total' END AS stage,
        CAST(user_id % 4 AS STRING) AS chromosome, CAST(value AS DOUBLE) AS duration_seconds, CAST(length(props) AS BIGINT) AS sent_bytes, CAST(length(props) * 2 AS BIGINT) AS received_bytes FROM {events}""",
}


def uses(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name])))


class Tables:
    """Views and stored tables of a folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir, self._seen = spark, sf_dir, {}

    def replaced(self, **tables: DataFrame) -> Tables:
        """The same tables with some of them replaced."""
        out = Tables(self._spark, self._dir)
        out._seen |= tables
        return out

    def _dealt_calls(self) -> DataFrame:
        """The view calls, in as many tasks as the order lines need: these are dealt by order, then once by part, for both grouping them and joining the variants."""
        rows = self.lineitem.count()  # from the files' footers
        last = F.expr("l_linestatus = 'F' AND l_returnflag = 'R' AND l_linenumber = 7")
        lines = dealt(self.lineitem.select("l_orderkey", "l_partkey", last.alias("last")), rows, "l_orderkey")
        c = lines.join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        c = dealt(c.select("o_custkey", "l_partkey", "last"), rows, "l_partkey").groupBy("o_custkey", "l_partkey").agg((~F.bool_and("last")).alias("called"), F.count(F.lit(1)).alias("lines"))
        c = c.withColumn("at", F.expr("CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END"))
        have = self.variants.select("p_partkey", "variant_key").join(self.available.select("site", "variant_key"), "variant_key")
        # not an equality of the sites, by which the calls would be dealt anew
        c = c.join(have, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("at") <= F.col("site")) & (F.col("at") >= F.col("site")))
        return c.select("site", F.col("o_custkey").cast("string").alias("sample_id"), "variant_key", F.expr("CAST(CASE WHEN called THEN least(2, lines) ELSE 0 END AS INT)").alias("dosage"), "called")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name == "calls":
                self._seen[name] = self._dealt_calls()
            elif name in VIEWS:
                self._seen[name] = self._spark.sql(VIEWS[name].replace('"end"', "`end`"), **{t: getattr(self, t) for t in uses(name)})
            else:
                self._seen[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._seen[name]


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, with the views that it uses (in braces) as common table expressions before it."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for t in uses(name):
                need(t)
            order.append(name)

    for t in re.findall(r"\{(\w+)\}", sql):
        need(t)
    plain = lambda s: re.sub(r"\{(\w+)\}", lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], s)
    ctes = [f"v_{n} AS ({plain(VIEWS[n])})" for n in order]
    body = plain(sql).strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ",\n".join([*ctes, body[len(start) :]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
