"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm import fill_middle, hilbert, language_id, mixing, near_dup, packing, quality, secret_scan, simhash, tokenfiles, topk, toxicity, vector_codes
from aerolake.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    model = language_id.fit(docs.filter(~F.col("held_out")))
    found = language_id.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


@query("op6_mix_sources")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def learning(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with ``held_out``, the documents to learn from and their labels; the split by id never looks at a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    marks = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "quality", "toxic")
    return docs, docs.filter(~F.col("held_out")), marks


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, seen, marks = learning(spark, sf_dir)
    model = toxicity.fit(seen, marks, language_id.fit(seen))
    scored = toxicity.score(docs.select("doc_id", "held_out", "text"), model)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), F.col("is_toxic").cast("int").alias("predicted"))


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor and toxic, 1 poor, 2 good but toxic, 3 good; the tail is the probability of a good text."""
    docs, seen, marks = learning(spark, sf_dir)
    model = quality.fit(seen, marks.withColumn("grade", 2 * F.col("quality") + 1 - F.col("toxic")), grades=4)
    found = quality.grade(docs.select("doc_id", "held_out", "text"), model, tail_from=2)
    return found.select("doc_id", "held_out", "expected_grade", F.col("tail").alias("score"), F.col("selected").cast("int").alias("predicted"))


@query("op4_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kind = {k: secret_scan.count_of(F.col("spans"), k) for k in secret_scan.KINDS}
    return found.select(
        "doc_id", *[kind[k].alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.listed(F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"), kind["novel"].alias("n_novel"),
    )


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read(tokenfiles.write(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_minhash", sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach(doc_id, place) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, CASE WHEN a = place THEN b ELSE a END FROM reach JOIN link ON a = place OR b = place
), label AS (
  SELECT doc_id, min(place) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM label LEFT JOIN n USING (doc_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_top_k", sql="""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
) WHERE rank <= 5
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


@query("op8_hilbert")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_fill_middle", sql=r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), l AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT FOR i IN range(4)] AS r FROM d
), c AS (
  SELECT *, len(u) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS lo, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS hi FROM l
), p AS (
  SELECT *, array_to_string(u[1 : lo], '') AS prefix, array_to_string(u[lo + 1 : hi], '') AS middle, array_to_string(u[hi + 1 :], '') AS suffix,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
              WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.arrange(table(spark, sf_dir, "documents"))
    return fill_middle.restore(cut).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def _codes_sql(rounds: int) -> str:
    """Integer k-means in SQL: a pair of tables for each round, and a last assignment."""
    steps = ["""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT *, list_inner_product(x, x) AS xx FROM (SELECT vec_id, label, k AS part, x[k * len(x) // 4 + 1 : (k + 1) * len(x) // 4] AS x FROM v, range(4) r(k))
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER w - 1 AS entry, x AS c, xx AS cc FROM p WINDOW w AS (PARTITION BY part ORDER BY vec_id, x) QUALIFY row_number() OVER w <= 256
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, label, part, x, best // 256 AS error, best % 256 AS entry FROM (
    SELECT vec_id, label, p.part, x, min((xx + cc - 2 * list_inner_product(x, c))::HUGEINT * 256 + entry) AS best FROM p JOIN b{i} b ON p.part = b.part GROUP BY vec_id, label, p.part, x)
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT part, entry, list(floor(s / n) ORDER BY i) AS c FROM (
    SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{i}, range(1, 100000) r(i) WHERE i <= len(x) GROUP BY part, entry, i) GROUP BY part, entry
), b{i + 1} AS MATERIALIZED (
  SELECT part, entry, c, list_inner_product(c, c) AS cc FROM (SELECT part, entry, coalesce(m{i}.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} USING (part, entry))
)""")
    last = rounds
    return ", ".join(steps) + f""", coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry::BIGINT), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{last} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) FROM b{last}) AS codebooks_sha256 FROM coded
"""


@query("op12_vector_codes", sql=_codes_sql(4))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


@query("op13_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents").select("doc_id", "text"))
