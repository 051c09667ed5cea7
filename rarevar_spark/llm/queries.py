"""The registered queries of this subpackage: thin, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, fingerprints, language_id, license_scan, line_dedup, ngram_join, packing, phrases, prefix_trie, private_data, quality_mil, repeated_spans


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file: every fortieth as <source>/LICENSE.<doc_id>, other eighths in <source>/<doc_id div 4000>, the rest a directory below."""
    docs = _table(spark, sf_dir, "documents")
    path = F.expr(
        "case when doc_id % 40 = 0 then concat(source, '/LICENSE.', doc_id) when doc_id % 8 = 0 then concat(source, '/', doc_id div 4000, '/', doc_id, '.txt')"
        " else concat(source, '/', doc_id div 4000, '/', doc_id div 400, '/', doc_id, '.txt') end"
    )
    return license_scan.scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")


#: The tool that conversations are taken to call: the assistant's turns are its calls.
ANSWER_SCHEMA = [("answer", "text", "string", True), ("answer", "n_words", "integer", True), ("answer", "final", "boolean", False)]


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as a call of the tool answer, every later user turn as a result.

    Results answer the call before them, or, in every fourth conversation, the one after them. By conv_id mod 5, calls wait for the call two turns
    before; for the one two turns later (a chain against the turns); in circles of two; for two later ones; or for none. Some calls repeat the
    identifier of an earlier one or name another tool, and some have arguments that are malformed, of a wrong type, missing or unexpected.
    """
    t = _table(spark, sf_dir, "conversations")
    n_words, odd = "size(split(text, ' '))", "conv_id + turn"
    arguments = F.expr(
        f"case when ({odd}) % 17 = 0 then '{{' when conv_id % 10 = 0 then to_json(named_struct('text', text, 'n_words', cast({n_words} as string)))"
        f" when ({odd}) % 7 = 0 then to_json(named_struct('extra', text, 'n_words', {n_words})) else to_json(named_struct('text', text, 'n_words', {n_words})) end"
    )
    is_call, is_result = F.col("role") == "assistant", (F.col("role") == "user") & (F.col("turn") > 0)
    ident = lambda n: f"concat('c', turn + {n})"
    own = F.expr(f"case when ({odd}) % 11 = 0 and turn > 2 then {ident(-2)} else {ident(0)} end")
    answers = F.expr(f"case when conv_id % 4 = 1 then {ident(1)} else {ident(-1)} end")
    after = F.expr(
        f"case conv_id % 5 when 0 then if(turn > 2, array({ident(-2)}), null) when 1 then array({ident(2)})"
        f" when 2 then array(if(turn % 4 in (1, 2), {ident(2)}, {ident(-2)})) when 3 then array({ident(2)}, {ident(4)}) end"
    )
    messages = t.select(
        "conv_id", "turn", F.when(is_call, "call").when(is_result, "result").otherwise("text").alias("kind"), "role",
        F.when(is_call, own).when(is_result, answers).alias("call_id"), F.when(is_call, F.expr(f"if(({odd}) % 13 = 0, 'other', 'answer')")).alias("name"),
        F.when(is_call, arguments).alias("arguments"), F.col("text").alias("content"), F.when(is_call, after).alias("after"),
    )
    schemas = spark.createDataFrame(ANSWER_SCHEMA, "tool string, param string, type string, required boolean")
    out = chat_format.format_chats(messages, schemas)
    return out.withColumn("problems", F.array_join("problems", "; "))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_of(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.delete_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "n_lines_removed", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(_table(spark, sf_dir, "documents"), words=3, threshold=0.9)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=30, longest=4, top=2000)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = private_data.find_private(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(private_data.KINDS)]
    return out.select("doc_id", *counts, F.sha2(private_data.spelt(F.col("base")), 256).alias("base_sha256"), private_data.spelt(F.col("spans")).alias("spans"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(_table(spark, sf_dir, "conversations"), borrow=6, among=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [f for name, f in globals().items() if name.startswith("op")]
    return {f.__name__: f for f in sorted(own, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def _license_sql() -> str:
    templates = license_scan.TEMPLATES + license_scan.TITLES
    values = ", ".join(f"({k}, '{t}', {n})" for k, c in enumerate(license_scan.template_terms(templates)) for t, n in sorted(c.items()))
    spdx = ", ".join(f"({k}, '{name}')" for k, (name, _) in enumerate(templates))
    titles = len(license_scan.TEMPLATES)
    rare, block = license_scan.RARE, "\\n[ \\t]*\\n"
    return f"""
    WITH tt(k, term, n) AS (VALUES {values}), spdx(k, license) AS (VALUES {spdx}),
    line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
        UNION ALL SELECT * FROM (SELECT doc_id, unnest(string_split_regex(text, '{block}')) AS text, generate_subscripts(string_split_regex(text, '{block}'), 1) - 1 + {license_scan.FIRST_BLOCK} AS line FROM documents) WHERE contains(text, chr(10))),
    tok AS (SELECT doc_id, line, term, count(*) AS tf FROM (SELECT doc_id, line, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM line) GROUP BY ALL),
    tf AS (SELECT * FROM tok UNION ALL SELECT doc_id, -1 AS line, term, sum(tf) AS tf FROM tok WHERE line < {license_scan.FIRST_BLOCK} GROUP BY doc_id, term),
    idf AS (SELECT t.term, -ln((coalesce(d.n, 0) / (SELECT count(*)::DOUBLE FROM documents) + {rare}) / (1 + {rare})) AS idf FROM (SELECT DISTINCT term FROM tt) t
        LEFT JOIN (SELECT term, count(DISTINCT doc_id) AS n FROM tok GROUP BY term) d ON d.term = t.term),
    v AS (SELECT k, term, n * idf / sqrt(sum(pow(n * idf, 2)) OVER (PARTITION BY k)) AS v FROM tt JOIN idf USING (term)),
    norm AS (SELECT doc_id, line, sqrt(sum(pow(tf * coalesce(idf, -ln({rare} / (1 + {rare}))), 2))) AS norm FROM tf LEFT JOIN idf USING (term) GROUP BY doc_id, line),
    dot AS (SELECT doc_id, line, k, round(sum(tf * idf * v), 9) AS dot FROM tf JOIN idf USING (term) JOIN v USING (term) GROUP BY doc_id, line, k),
    reached AS (SELECT doc_id, line, k, dot, round(dot / norm, 6) AS score FROM dot JOIN norm USING (doc_id, line) WHERE round(dot / norm, 6) >= CASE WHEN k < {titles} THEN 0.6 ELSE {license_scan.TITLE_SCORE} END),
    best AS (SELECT doc_id, line, k, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dot DESC, k) AS r FROM reached) WHERE r = 1),
    header AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k >= {titles} DESC, score DESC, line) AS r FROM best WHERE line >= 0) WHERE r = 1),
    body AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k >= {titles} DESC, score DESC, line) AS r FROM best WHERE line = -1 OR k >= {titles}) WHERE r = 1),
    f AS (SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN source WHEN doc_id % 8 = 0 THEN concat(source, '/', doc_id // 4000) ELSE concat(source, '/', doc_id // 4000, '/', doc_id // 400) END AS dir,
        CASE WHEN doc_id % 40 = 0 THEN concat('LICENSE.', doc_id) ELSE concat(doc_id, '.txt') END AS name, [source, concat(source, '/', doc_id // 4000), concat(source, '/', doc_id // 4000, '/', doc_id // 400)] AS dirs FROM documents),
    whole AS (SELECT f.doc_id, coalesce(w.k, h.k) AS k, coalesce(w.score, h.score) AS score, f.dir, concat(f.dir, '/', f.name) AS path FROM f LEFT JOIN body w ON w.doc_id = f.doc_id
        LEFT JOIN header h ON h.doc_id = f.doc_id AND f.doc_id % 40 = 0 WHERE coalesce(w.k, h.k) IS NOT NULL),
    licence AS (SELECT dir, score, k FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, doc_id) AS r FROM whole) WHERE r = 1),
    near AS (SELECT * FROM (SELECT u.doc_id, l.dir AS above, l.score, l.k, row_number() OVER (PARTITION BY u.doc_id ORDER BY length(l.dir) DESC) AS r
        FROM (SELECT doc_id, dir, unnest(dirs) AS up FROM f) u JOIN licence l ON l.dir = u.up AND starts_with(concat(u.dir, '/'), concat(u.up, '/'))) WHERE r = 1)
    SELECT f.doc_id, concat(f.dir, '/', f.name) AS path, s.license, CASE WHEN w.k IS NOT NULL THEN 'file' WHEN h.k IS NOT NULL THEN 'header' WHEN n.k IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
        coalesce(w.score, h.score, n.score) AS score, CASE WHEN w.k IS NULL AND h.k IS NULL THEN n.above END AS from_dir
    FROM f LEFT JOIN whole w ON w.doc_id = f.doc_id LEFT JOIN header h ON h.doc_id = f.doc_id LEFT JOIN near n ON n.doc_id = f.doc_id LEFT JOIN spdx s ON s.k = coalesce(w.k, h.k, n.k)"""


#: A message's place by the paths to all that must come before it: pos is the largest turn among them and its own, level the longest path to that one.
CHAT_SQL = """
    WITH RECURSIVE m AS (SELECT *, CASE WHEN role = 'assistant' THEN 'call' WHEN role = 'user' AND turn > 0 THEN 'result' ELSE 'text' END AS kind,
        len(string_split(text, ' ')) AS n, conv_id + turn AS odd FROM conversations),
    x AS (SELECT *, CASE kind WHEN 'call' THEN CASE WHEN odd % 11 = 0 AND turn > 2 THEN concat('c', turn - 2) ELSE concat('c', turn) END
            WHEN 'result' THEN CASE WHEN conv_id % 4 = 1 THEN concat('c', turn + 1) ELSE concat('c', turn - 1) END END AS call_id,
        CASE WHEN kind = 'call' THEN CASE conv_id % 5 WHEN 0 THEN CASE WHEN turn > 2 THEN [concat('c', turn - 2)] END WHEN 1 THEN [concat('c', turn + 2)]
            WHEN 2 THEN [CASE WHEN turn % 4 IN (1, 2) THEN concat('c', turn + 2) ELSE concat('c', turn - 2) END] WHEN 3 THEN [concat('c', turn + 2), concat('c', turn + 4)] END END AS after FROM m),
    calls AS (SELECT conv_id, call_id, min(turn) AS call_turn FROM x WHERE kind = 'call' GROUP BY 1, 2),
    answered AS (SELECT DISTINCT conv_id, call_id FROM x WHERE kind = 'result'),
    waits AS (SELECT w.conv_id, w.turn, c.call_turn FROM (SELECT conv_id, turn, unnest(after) AS call_id FROM x) w LEFT JOIN calls c ON c.conv_id = w.conv_id AND c.call_id = w.call_id),
    edges AS (SELECT conv_id, turn, call_turn AS dep FROM waits WHERE call_turn != turn UNION SELECT x.conv_id, x.turn, c.call_turn AS dep FROM x JOIN calls c ON c.conv_id = x.conv_id AND c.call_id = x.call_id WHERE x.kind = 'result'),
    size AS (SELECT conv_id, count(*) AS messages FROM conversations GROUP BY 1),
    paths AS (SELECT conv_id, turn, dep, 1 AS steps FROM edges UNION SELECT p.conv_id, p.turn, e.dep, p.steps + 1 FROM paths p JOIN edges e ON e.conv_id = p.conv_id AND e.turn = p.dep JOIN size s ON s.conv_id = p.conv_id WHERE p.steps < s.messages),
    top AS (SELECT x.conv_id, x.turn, greatest(x.turn, coalesce(max(p.dep), x.turn)) AS t FROM x LEFT JOIN paths p ON p.conv_id = x.conv_id AND p.turn = x.turn GROUP BY x.conv_id, x.turn),
    round AS (SELECT DISTINCT c.conv_id, c.turn, c.t FROM top c JOIN paths p ON p.conv_id = c.conv_id AND p.turn = c.turn AND p.dep = c.turn),
    cyclic AS (SELECT conv_id, turn FROM round UNION SELECT a.conv_id, a.turn FROM top a JOIN paths p ON p.conv_id = a.conv_id AND p.turn = a.turn JOIN round r ON r.conv_id = p.conv_id AND r.turn = p.dep AND r.t = a.t),
    place AS (SELECT a.conv_id, a.turn, a.t, max(p.steps) AS steps FROM top a JOIN paths p ON p.conv_id = a.conv_id AND p.turn = a.turn AND p.dep = a.t WHERE a.t != a.turn GROUP BY 1, 2, 3),
    y AS (SELECT x.*, c.call_turn, c.call_turn = x.turn AND r.call_id IS NOT NULL AS answered, l.turn IS NOT NULL AS lost, z.turn IS NOT NULL AS cyclic, p.t, p.steps FROM x
        LEFT JOIN calls c ON c.conv_id = x.conv_id AND c.call_id = x.call_id LEFT JOIN answered r ON r.conv_id = x.conv_id AND r.call_id = x.call_id
        LEFT JOIN (SELECT DISTINCT conv_id, turn FROM waits WHERE call_turn IS NULL) l ON l.conv_id = x.conv_id AND l.turn = x.turn
        LEFT JOIN cyclic z ON z.conv_id = x.conv_id AND z.turn = x.turn LEFT JOIN place p ON p.conv_id = x.conv_id AND p.turn = x.turn)
    SELECT conv_id, turn, kind, call_id, CASE kind WHEN 'call' THEN coalesce(answered, false) WHEN 'result' THEN call_turn IS NOT NULL END AS linked,
        concat_ws('; ', CASE WHEN kind = 'call' THEN CASE WHEN odd % 13 = 0 THEN 'unknown tool' WHEN odd % 17 = 0 THEN 'not an object' WHEN conv_id % 10 = 0 THEN 'type n_words' WHEN odd % 7 = 0 THEN 'missing text; unexpected extra' END END,
            CASE WHEN kind = 'call' AND NOT coalesce(answered, false) THEN 'no result' END, CASE WHEN kind = 'result' AND call_turn IS NULL THEN 'no call' END, CASE WHEN kind = 'call' AND call_turn < turn THEN 'call_id used before' END,
            CASE WHEN kind = 'call' AND lost THEN 'waits for unknown call' END, CASE WHEN cyclic THEN 'circle' END) AS problems,
        CASE WHEN cyclic THEN turn ELSE coalesce(t, turn) END AS pos, CAST(CASE WHEN cyclic THEN 0 ELSE coalesce(steps, 0) END AS INT) AS level,
        concat('{', CASE WHEN kind = 'call' THEN CASE WHEN odd % 17 = 0 THEN '"arguments":"{",' ELSE concat('"arguments":{', CASE WHEN conv_id % 10 != 0 AND odd % 7 = 0 THEN concat('"extra":', to_json(text), ',') END,
                '"n_words":', CASE WHEN conv_id % 10 = 0 THEN concat('"', n, '"') ELSE n::VARCHAR END, CASE WHEN conv_id % 10 = 0 OR odd % 7 != 0 THEN concat(',"text":', to_json(text)) END, '},') END END,
            CASE WHEN kind != 'text' THEN concat('"call_id":"', call_id, '",') END, CASE WHEN kind != 'call' THEN concat('"content":', to_json(text), ',') END,
            '"conv_id":', conv_id, ',"kind":"', kind, '",', CASE WHEN kind = 'call' THEN concat('"name":"', CASE WHEN odd % 13 = 0 THEN 'other' ELSE 'answer' END, '",') END, '"role":"', role, '","turn":', turn, '}') AS json FROM y"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str, word: str, k: int) -> str:
    """The distinct k-word shingles of each text, or its whole sequence where it has fewer words."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {k} THEN [array_to_string(w[i:i + {k - 1}], ' ') for i in range(1, len(w) - {k - 2})] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM (SELECT {key}, regexp_extract_all({_LOWER}, '{word}') AS w FROM {table})"""


ITEMS_SQL = f"""
    WITH d AS ({_shingles("documents", "doc_id", r"[a-z0-9\x{80}-\x{10FFFF}]+", 5)}), i AS ({_shingles("benchmark", "item_id", r"[a-z0-9\x{80}-\x{10FFFF}]+", 5)}),
    n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1)
    SELECT d.doc_id, i.item_id, CAST(count(*) AS INT) AS n_shared, CAST(any_value(n) AS INT) AS n_item, count(*) / any_value(n)::DOUBLE AS containment
    FROM d JOIN i ON i.s = d.s JOIN n ON n.item_id = i.item_id GROUP BY 1, 2 HAVING 5 * count(*) >= 4 * any_value(n)"""

BYTES_SQL = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
    f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
    m AS (SELECT g.doc_id, g.p FROM g JOIN f ON f.s = g.s WHERE f.first < g.doc_id),
    o AS (SELECT doc_id, p, CASE WHEN p - lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) > 50 THEN 1 ELSE 0 END AS opens FROM m),
    r AS (SELECT doc_id, min(p) AS b, max(p) + 50 AS e FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o) GROUP BY doc_id, run),
    k AS (SELECT doc_id, string_agg(part, '' ORDER BY place) AS kept FROM (SELECT q.doc_id, q.b AS place, substr(h, 2 * before + 1, 2 * (b - before)) AS part
        FROM (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM r) q JOIN d ON d.doc_id = q.doc_id
        UNION ALL SELECT d.doc_id, d.n AS place, substr(d.h, 2 * t.e + 1) AS part FROM d JOIN (SELECT doc_id, max(e) AS e FROM r GROUP BY doc_id) t ON t.doc_id = d.doc_id) GROUP BY doc_id),
    c AS (SELECT doc_id, sum(e - b) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
    SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

JOIN_SQL = f"""
    WITH RECURSIVE s AS ({_shingles("documents", "doc_id", r"[^\x20\x09-\x0D]+", 3)}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id, coalesce(l.links, 0) AS n_links FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
    LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) r ON r.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS links FROM link GROUP BY 1) l ON l.a = d.doc_id"""


def _phrase_sql() -> str:
    """Phrases as lists of words, counted by all their occurrences; cuts and covers by joins."""
    spans = " UNION ALL ".join(f"SELECT lang, w[i:i + {n - 1}] AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM piece)" for n in (1, 2, 3, 4))
    inner = " UNION ALL ".join(f"SELECT lang, g[{i}:{i + m - 1}] AS g, a FROM phrase WHERE len(g) = {n}" for n in (3, 4) for m in range(2, n) for i in range(1, n - m + 2))
    return f"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER.replace("text", "coalesce(text, '')", 1)}, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
    size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY 1),
    gram AS (SELECT lang, g, count(*) AS f FROM ({spans}) GROUP BY 1, 2 HAVING count(*) >= 30),
    phrase AS (SELECT lang, g, f AS a FROM gram WHERE len(g) > 1),
    cut AS (SELECT p.*, x.f AS l, y.f AS r, k, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, len(g))) AS k FROM phrase) p
        JOIN gram x ON x.lang = p.lang AND x.g = p.g[1:k] JOIN gram y ON y.lang = p.lang AND y.g = p.g[k + 1:]),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS c FROM cut) WHERE c = 1),
    cover AS (SELECT lang, g, max(a) AS longer FROM ({inner}) GROUP BY 1, 2),
    kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN cover c ON c.lang = b.lang AND c.g = b.g WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
    SELECT p.lang, rank, phrase, a, l, r, n, score FROM placed p JOIN size s ON s.lang = p.lang WHERE rank <= 2000"""


#: The other operators have no SQL equivalent that runs on whole tables; tests hold them against brute force.
def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scans": _license_sql(), "op2_chat_formatting": CHAT_SQL, "op5_benchmark_decontamination": ITEMS_SQL,
        "op8_suffix_array_dedup": BYTES_SQL, "op9_ngram_jaccard_join": JOIN_SQL, "op11_phrase_collocations": _phrase_sql(),
    }
