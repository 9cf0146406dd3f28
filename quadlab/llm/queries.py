"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadlab.llm import (centroids, decontamination, line_dedup, near_dedup, packing, passage_dedup, pii, quality_model, quality_rules, secret_scan,
                         sharding, toxicity, vector_codes)
from quadlab.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages to remove: where they are, and the document that keeps its copy."""
    out = passage_dedup.repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "first_doc_id", "start", "end", F.col("n_words").cast("long").alias("n_words"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(g)) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.v)
SELECT n.doc_id, n.n AS n_shingles, min(r.m) AS component_id, n.doc_id = min(r.m) AS kept
FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines cut, and length and digest of what is left."""
    out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars"),
                      F.md5("text").alias("text_md5"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("sentences").cast("long").alias("n_sentences"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


OP4_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, site, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM t),
k AS (SELECT doc_id, site, pos, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
b AS (SELECT line, min((doc_id, pos)) AS first FROM k WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 6),
m AS (SELECT k.doc_id, k.pos, k.raw, b.line IS NOT NULL AND (k.doc_id, k.pos) <> b.first AS cut FROM k LEFT JOIN b USING (line)),
o AS (SELECT doc_id, count(*) FILTER (cut) AS n_removed,
        coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN length(o.text) END AS n_chars,
  CASE WHEN d.text IS NOT NULL THEN md5(o.text) END AS text_md5
FROM documents d LEFT JOIN o USING (doc_id)
"""


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they overlap with."""
    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)
    return found.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"))


def _op5_sql() -> str:
    def texts(table_: str, key: str) -> str:
        return rf"""SELECT {key}, w FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'),
          lambda x: x <> '') AS w FROM {table_}) WHERE len(w) >= 11"""

    def seeds(name: str, key: str) -> str:
        masks = ", ".join("'" + str(m) + " ' || " + " || ' ' || ".join(f"w[p + {i}]" for i, c in enumerate(mask) if c == "1")
                          for m, mask in enumerate(decontamination.MASKS))
        return f"SELECT {key}, p, unnest([{masks}]) AS seed FROM (SELECT {key}, w, unnest(range(1, len(w) - 9)) AS p FROM {name})"
    same = " + ".join("CASE WHEN da + o + {0} >= 1 AND ba + o + {0} >= 1 AND dt.w[da + o + {0}] = bt.w[ba + o + {0}] THEN 1 ELSE 0 END".format(i)
                      for i in range(13))
    return f"""
WITH dt AS ({texts("documents", "doc_id")}), bt AS ({texts("benchmark", "item_id")}),
h AS (SELECT DISTINCT d.doc_id, b.item_id, d.p AS da, b.p AS ba FROM ({seeds("dt", "doc_id")}) d JOIN ({seeds("bt", "item_id")}) b USING (seed)),
s AS (SELECT h.doc_id, h.item_id, len(bt.w) AS n, {same} AS matched
      FROM h JOIN dt ON dt.doc_id = h.doc_id JOIN bt ON bt.item_id = h.item_id, (SELECT unnest([-2, -1, 0]) AS o))
SELECT doc_id, item_id, max(matched) AS matched FROM s WHERE matched >= least(13, n) - 2 GROUP BY doc_id, item_id
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: entities of each kind, and the text with surrogates."""
    out = pii.replaced(table(spark, sf_dir, "documents"), key="surrogates")

    def count(kind: str) -> Column:
        return F.size(F.filter("entity_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[count(k) for k in pii.PATTERNS], "text")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.base_digest(table(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    ctes, union = [], []
    for rank, r in enumerate(secret_scan.RULES):
        # leftmost matches begin where a run begins anyway; the check's engine has no look-behind
        pattern = (("(?i)" if r.ignore_case else "") + r.pattern.removeprefix("(?<![a-z])")).replace("'", "''")
        ctes.append(f"""m{rank} AS (SELECT doc_id, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS g,
          regexp_extract_all(t, '{pattern}', 0) AS f, regexp_extract_all(t, '{pattern}', {r.value}) AS v FROM d)""")
        union.append(f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, length(v[i]) AS n, list_sum(g[:i]) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0) AS a,
          length(f[i]) AS len FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m{rank}) WHERE length(v[i]) >= {r.at_least}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(ctes)},
s AS (SELECT doc_id, rank, kind, CAST(a AS BIGINT) AS a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + len AS BIGINT) AS span FROM ({" UNION ALL ".join(union)})),
o AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (rank < 3), '') AS base, string_agg(span, ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN o USING (doc_id)
"""


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


#: Components times 256, rounded down; the rows without a null, NaN or infinite component.
_WHOLE = """SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
#: floor(s / n) of whole numbers.
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _op11_sql() -> str:
    ctes = [f"k AS ({_WHOLE})", "v AS (SELECT vec_id, label, p, x[4 * p + 1:4 * p + 4] AS v FROM k, (SELECT unnest(range(16)) AS p))",
            "b0 AS (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM v) WHERE e < 64)"]
    square = " + ".join(f"(v.v[{i}] - b.v[{i}]) * (v.v[{i}] - b.v[{i}])" for i in range(1, 5))
    for r in range(3):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, v.p, v.v, min(({square}, e)) AS m FROM v JOIN b{r} b ON b.p = v.p GROUP BY ALL)")
        ctes.append(f"n{r} AS (SELECT p, e, list({_FLOOR} ORDER BY i) AS v FROM (SELECT p, m[2] AS e, i, sum(v[i]) AS s, count(*) AS n "
                    f"FROM a{r}, (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL) GROUP BY ALL)")
        ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN n{r} n USING (p, e))")
    return f"""
WITH {", ".join(ctes)},
c AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m[2]), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a2 GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h
"""


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    ctes = [f"k AS (SELECT vec_id, x FROM ({_WHOLE}) WHERE len(x) = 64)",
            "b0 AS (SELECT c, x FROM (SELECT x, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM k) WHERE c < 40)"]
    square = "CAST(list_sum(list_transform(list_zip(k.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for r in range(6):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(k.x) AS x, min(({square}, c)) AS m FROM k, b{r} b GROUP BY vec_id)")
        ctes.append(f"n{r} AS (SELECT c, list({_FLOOR} ORDER BY i) AS x FROM (SELECT m[2] AS c, i, sum(x[i]) AS s, count(*) AS n "
                    f"FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY c)")
        ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN n{r} n USING (c))")
    return f"""
WITH {", ".join(ctes)}
SELECT vec_id, CAST(m[2] AS INT) AS cluster, m[1] AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(b5.x, ',')) AS centroid_sha256
FROM a5 JOIN b5 ON b5.c = m[2]
"""


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_best_fit_packing, op3_quality_classifier, op4_line_dedup, op5_benchmark_decontamination, op6_toxicity, op7_quality_rules, op8_minhash_near_dedup, op9_pii, op10_secret_scan,
    op11_vector_code_compression, op12_centroid_clustering, op13_sharding)}
ORACLES = {"op4_line_dedup": OP4_SQL, "op5_benchmark_decontamination": _op5_sql(), "op8_minhash_near_dedup": OP8_SQL,
           "op10_secret_scan": _op10_sql(), "op11_vector_code_compression": _op11_sql(), "op12_centroid_clustering": _op12_sql()}
