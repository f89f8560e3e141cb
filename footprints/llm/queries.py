"""The registered queries of this subpackage, each over its whole table, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from footprints.llm import iblt, katz, laesa, langid, licences, line_dedup, merkle, ngram_join, packing, pieces, pseudonyms, quality, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


_TEXT = "coalesce(text, '')"
_LOWERED = f"translate({_TEXT}, '{licences.UPPER}', '{licences.LOWER}')"
_WORD = r"'[^\x20\x09-\x0D]+'"


@query(
    "op1_line_dedup",
    f"""
WITH l AS (SELECT doc_id, unnest(string_split({_TEXT}, chr(10))) AS t, unnest(string_split({_LOWERED}, chr(10))) AS s,
           unnest(range(len(string_split({_TEXT}, chr(10))))) AS i FROM documents),
w AS (SELECT doc_id, i, t, doc_id * 10000000 + i AS pos, regexp_extract_all(s, {_WORD}) AS w FROM l),
k AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS s FROM w),
f AS (SELECT s, any_value(w) AS w, any_value(n) AS n, min(pos) AS pos FROM k WHERE n >= {line_dedup.MIN_WORDS} GROUP BY s),
g AS (SELECT * FROM f WHERE n >= {line_dedup.MIN_NEAR_WORDS}),
p AS (SELECT s, w, pos, unnest(range(1, n + 1)) AS j FROM g),
c AS (SELECT s, pos, j, array_to_string(list_concat(list_slice(w, 1, j - 1), list_slice(w, j + 1, len(w))), ' ') AS v FROM p),
r AS (SELECT v, j, min(pos) AS pos FROM c GROUP BY v, j),
m AS (SELECT v, min(pos) AS pos FROM c GROUP BY v),
near AS (SELECT c.s FROM c JOIN r ON r.v = c.v AND r.j = c.j WHERE r.pos < c.pos
         UNION SELECT c.s FROM c JOIN g ON g.s = c.v WHERE g.pos < c.pos UNION SELECT g.s FROM g JOIN m ON m.v = g.s WHERE m.pos < g.pos),
d AS (SELECT k.doc_id, k.i, k.t, near.s IS NOT NULL AS is_near, coalesce(near.s IS NOT NULL OR f.pos < k.pos, false) AS gone
      FROM k LEFT JOIN f ON f.s = k.s AND k.n >= {line_dedup.MIN_WORDS} LEFT JOIN near ON near.s = f.s)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed, CAST(sum(CAST(is_near AS INT)) AS BIGINT) AS n_near,
       md5(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_md5 FROM d GROUP BY doc_id""",
)
def _(spark, folder):
    return line_dedup.line_dedup(documents(spark, folder)).select("doc_id", "n_lines", "n_removed", "n_near", F.md5("text").alias("kept_md5"))


@query(
    "op2_ngram_jaccard_join",
    f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_WORD}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
       ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS z FROM documents UNION SELECT r.a, b.y FROM r JOIN b ON b.x = r.z)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(z) AS component_id FROM r GROUP BY 1) k ON k.a = d.doc_id""",
)
def _(spark, folder):
    return ngram_join.linked(documents(spark, folder), n=3, num=90, den=100)


@query("op3_pii_pseudonyms")
def _(spark, folder):
    found = pseudonyms.pseudonymised(documents(spark, folder))

    def number(kind):
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    numbers = [number(kind) for kind in pseudonyms.KINDS]
    return found.select("doc_id", *numbers, "text")


_REJECTED = [(rule, i, cutoff) for rule, cutoffs in quality.RULES.items() for i, cutoff in enumerate(cutoffs)]
_W = quality.WINDOW


@query(
    "op4_quality_rules",
    f"""
WITH t AS (SELECT doc_id, lang, {_TEXT} AS text, regexp_extract_all({_TEXT}, {_WORD}) AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM l WHERE regexp_matches(l, {_WORD}) GROUP BY 1),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {_W - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_W - 2})) AS i FROM t WHERE len(w) >= {_W})),
rg AS (SELECT doc_id, i FROM g WHERE (doc_id, g) IN (SELECT (doc_id, g) FROM g GROUP BY doc_id, g HAVING count(*) > 1)),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rg, range({_W}) r(k) GROUP BY 1),
b AS (SELECT t.doc_id, coalesce(lang, '') AS lang, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
      FROM t LEFT JOIN ln ON ln.doc_id = t.doc_id LEFT JOIN rw ON rw.doc_id = t.doc_id),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbol_ratio,
      n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio,
      word_chars / greatest(n_words, 1) AS word_chars_high, -word_chars / greatest(n_words, 1) AS word_chars_low FROM b),
good AS (SELECT v.* FROM v JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) q ON q.doc_id = v.doc_id WHERE NOT base_failed),
c AS ({" UNION ALL ".join(f"SELECT lang, '{r}' AS rule, {i} AS i, CAST({x} AS DOUBLE) AS cutoff, count(*) AS n, sum(CAST({r} > {x} AS INT)) AS k FROM good GROUP BY lang" for r, i, x in _REJECTED)}),
z AS (SELECT *, {quality.ALPHA} / {len(quality.RULES)} AS p, {quality.DELTA} / ((SELECT count(DISTINCT lang) FROM good) * {len(quality.RULES)}) AS level FROM c),
e AS (SELECT *, k <= n * p AND list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))
      FOR j IN range(CAST(least(k, n * p) AS BIGINT) + 1)]) <= level AS ok FROM z),
h AS (SELECT lang, rule, max_by(cutoff, i) AS cutoff FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY i) AS on_ FROM e) WHERE on_ GROUP BY 1, 2),
x AS (SELECT v.doc_id, bool_or(CASE h.rule {" ".join(f"WHEN '{r}' THEN {r} > h.cutoff" for r in quality.RULES)} END) AS bad FROM v JOIN h ON h.lang = v.lang GROUP BY 1)
SELECT v.doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM v LEFT JOIN x ON x.doc_id = v.doc_id""",
)
def _(spark, folder):
    found = quality.judged(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_iblt_fingerprints")
def _(spark, folder):
    return iblt.compared(documents(spark, folder)).drop("differing")


def _licence_sql() -> str:
    known = ", ".join(f"('{form}', '{name}')" for name, forms in licences.SENTENCES.items() for form in forms)
    source = f"""
SELECT doc_id, string_agg(k.name, ' ' ORDER BY i) AS sentence_ids, ' ' || string_agg(k.name, '  ' ORDER BY i) || ' ' AS rest, '' AS found FROM (
  SELECT doc_id, i, trim(regexp_replace(s, '{licences.OTHER}', ' ', 'g')) AS s FROM (
    SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(regexp_replace({_LOWERED}, '([.!?;:])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS p FROM documents))) x
JOIN (VALUES {known}) k(s, name) ON k.s = x.s GROUP BY doc_id"""
    for licence, kind, ids in licences.RULES:
        wanted = "' " + "  ".join(ids) + " '"
        name = f"{licence}:{kind}"
        source = f"""SELECT doc_id, sentence_ids, replace(rest, {wanted}, ' | ') AS rest,
 CASE WHEN contains(rest, {wanted}) AND NOT contains(' ' || found || ' ', ' {name} ') THEN trim(found || ' {name}') ELSE found END AS found FROM ({source})"""
    return f"SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(found, '') AS licences FROM documents d LEFT JOIN ({source}) x ON x.doc_id = d.doc_id"


@query("op6_license_rules", _licence_sql())
def _(spark, folder):
    return licences.scanned(documents(spark, folder)).select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licences"))


@query("op7_katz_scores")
def _(spark, folder):
    docs = documents(spark, folder)
    model = katz.train(docs.where(~katz.held_out(F.col("doc_id"))))
    return katz.score(docs, model).select("doc_id", katz.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_length_buckets")
def _(spark, folder):
    counted = packing.token_counts(documents(spark, folder).select("doc_id", "text"))
    return packing.packed(counted.select("doc_id", F.xxhash64("text").alias("text_hash"), "n_tokens"), "n_tokens").drop("text_hash")


@query("op9_language_id")
def _(spark, folder):
    docs = documents(spark, folder)
    held = katz.held_out(F.col("doc_id"), 3)
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op10_sentencepiece")
def _(spark, folder):
    model = pieces.load(spark)
    coded = pieces.decode(pieces.encode(documents(spark, folder).select("doc_id", "text"), model), model)
    return coded.select(
        "doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("bigint").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("restored")
    )


def _round_sql(i: int) -> str:
    """The nearest centroid of each vector, and the centroids that follow."""
    return f"""
n{i} AS MATERIALIZED (SELECT vec_id, v, min_by(c, (d, c)) AS c, min(d) AS d FROM
  (SELECT vec_id, v, c, CAST(list_sum([(v[i] - m[i]) * (v[i] - m[i]) FOR i IN range(1, {laesa.COMPONENTS + 1})]) AS BIGINT) AS d FROM v, c{i}) GROUP BY vec_id, v),
s{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({laesa.COMPONENTS})) AS i FROM n{i}) GROUP BY c, i),
m{i} AS (SELECT c, list(s // n - CAST(s < 0 AND s % n <> 0 AS INT) ORDER BY i) AS m FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)"""


@query(
    "op11_laesa_clusters",
    f"""
WITH v AS MATERIALIZED (SELECT vec_id, [CAST(floor({laesa.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {laesa.COMPONENTS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {laesa.CENTROIDS})),
{",".join(_round_sql(i) for i in range(laesa.ROUNDS + 1))},
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM n{laesa.ROUNDS} GROUP BY c)
SELECT vec_id, CAST(n.c AS INT) AS cluster, d AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM n{laesa.ROUNDS}) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM n{laesa.ROUNDS} n JOIN t ON t.c = n.c JOIN c{laesa.ROUNDS} k ON k.c = n.c""",
)
def _(spark, folder):
    return laesa.described(laesa.cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))).drop("tested")


# Eight levels of eight hold 16 million rows of a language.
_LEVELS = 8


def _rise_sql(name: str, i: int) -> str:
    """Nodes of level i + 1, from those of level i: (g, pos, n, h)."""
    return f"""
{name}{i + 1} AS MATERIALIZED (SELECT g, pos // 8 AS pos, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{i} WHERE n > 1 GROUP BY g, pos // 8, n)"""


def _fold_sql(rows: str, nodes: str, i: int) -> str:
    """Each row's way through level i: own digest f, siblings so far p; rows whose tree has ended stay as they are."""
    return f"""
{rows}{i + 1} AS MATERIALIZED (SELECT r.key, any_value(r.g) AS g, any_value(r.pos // 8) AS pos, any_value((r.n + 7) // 8) AS n,
  CASE WHEN any_value(r.n) > 1 THEN sha256(string_agg(CASE WHEN x.pos = r.pos THEN r.f ELSE x.h END, '' ORDER BY x.pos)) ELSE any_value(r.f) END AS f,
  any_value(r.p) || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos <> r.pos), '') AS p
  FROM {rows}{i} r LEFT JOIN {nodes}{i} x ON x.g = r.g AND x.pos // 8 = r.pos // 8 AND r.n > 1 GROUP BY r.key)"""


def _leaf_sql(text: str) -> str:
    shown = [f"coalesce(CAST(octet_length(encode(CAST({v} AS VARCHAR))) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(shown)})"


# One step a bit, the lowest bit of each byte first.
_BITS = "flatten([[(ascii(c) >> k) & 1 FOR k IN range(8)] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(b AS BIGINT) FOR b IN {_BITS}]), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
_ENDED = " UNION ALL ".join(f"SELECT g, h FROM t{i} WHERE n = 1" for i in range(_LEVELS + 1))


@query(
    "op12_merkle_manifest",
    f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, {_leaf_sql("text")} AS h, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")} ELSE h END AS o FROM documents),
l AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) AS n FROM d GROUP BY lang),
w AS MATERIALIZED (SELECT row_number() OVER () AS key, d.doc_id, l.g, l.n, row_number() OVER (PARTITION BY l.g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h, o FROM d JOIN l ON l.lang IS NOT DISTINCT FROM d.lang),
t0 AS MATERIALIZED (SELECT g, pos, n, h FROM w),
{",".join(_rise_sql("t", i) for i in range(_LEVELS))},
e AS (SELECT g, h FROM ({_ENDED})),
u0 AS MATERIALIZED (SELECT 0 AS g, g AS pos, (SELECT count(*) FROM l) AS n, h FROM e),
{",".join(_rise_sql("u", i) for i in range(_LEVELS))},
r0 AS MATERIALIZED (SELECT key, g, pos, n, o AS f, '' AS p FROM w),
{",".join(_fold_sql("r", "t", i) for i in range(_LEVELS))},
q0 AS MATERIALIZED (SELECT key, 0 AS g, g AS pos, (SELECT count(*) FROM l) AS n, f, p FROM r{_LEVELS}),
{",".join(_fold_sql("q", "u", i) for i in range(_LEVELS))},
z AS (SELECT h AS root FROM ({" UNION ALL ".join(f"SELECT h FROM u{i} WHERE n = 1" for i in range(_LEVELS + 1))}))
SELECT w.doc_id, w.h AS leaf, e.h AS subroot, root, sha256(q.p) AS proof_sha256, q.f AS folded_root, q.f = root AS verified
FROM w JOIN q{_LEVELS} q ON q.key = w.key JOIN e ON e.g = w.g, z""",
)
def _(spark, folder):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(documents(spark, folder), tampered, merkle.lowered()).drop("lang", "path")


@query("op13_toxicity")
def _(spark, folder):
    docs = documents(spark, folder)
    held = katz.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs.where(~held), spark.read.parquet(f"{folder}/labels.parquet"), docs)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")
