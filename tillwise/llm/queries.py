"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch, table
from tillwise.llm.decontaminate import decontamination_report
from tillwise.llm.html import main_text
from tillwise.llm.lexical import ranked_search
from tillwise.llm.licenses import license_scan, license_sql
from tillwise.llm.linededup import dedup_lines
from tillwise.llm.nearcopies import near_copy_groups
from tillwise.llm.packing import pack_documents
from tillwise.llm.periodic import collapse_runs
from tillwise.llm.quality import quality_scores, rejected
from tillwise.llm.registry import ORACLES, QUERIES, register
from tillwise.llm.repeats import remove_repeats
from tillwise.llm.simhash import simhash_groups
from tillwise.llm.tokenfile import read_token_files, write_token_files
from tillwise.llm.topk import embedding_rows, top_k

VOCABULARY = "word_bpe_49k.json"

DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) m, array_to_string(w[i:i + 12], ' ') gram
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') gram
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT dw.doc_id, dw.m, dw.i, bw.item_id FROM dw JOIN bw USING (m, gram)),
c AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@register("op1_license_scan", license_sql())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("sentence_ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), ids.alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


@register("op2_decontaminate", DECONTAMINATION_SQL)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


@register("op3_repeats")
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@register("op4_hyperminhash")
def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copy_groups(table(spark, sf_dir, "documents"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id query_id, c.id vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) score
      FROM v q JOIN v c ON q.id <> c.id AND len(q.e) = len(c.e) WHERE q.id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@register("op5_exact_top_k", TOP_K_SQL)
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding_rows(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("id") % 100 == 0))


@register("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@register("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = dedup_lines(docs.select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines")))
    return out.select("doc_id", "n_lines", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


@register("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@register("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "token-files").path("files")
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, folder, public_tokenizers.path(VOCABULARY))
    return read_token_files(manifest, dict(docs.dtypes)["doc_id"])


@register("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_quality", "p_toxic", "rate_quality", "rate_toxic", (~rejected()).alias("kept"))


def with_periodic_words(documents: DataFrame) -> DataFrame:
    """The contract's input: about every tenth document goes on in a period of its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    docs = documents.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    # without words there is no place to begin, and a remainder by 0 is an error
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.pmod(g, F.col("n"))).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(g, F.lit(8))))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(period, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n"))
    return docs.select("doc_id", F.when((h % 10 == 0) & (F.col("n") > 0), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


PERIODIC_RUNS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') v,
                  xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, b:
                      list_reduce(CAST(range(8) AS BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)),
                      CAST(4294967295 AS BIGINT)), 4294967295) h FROM documents),
e AS (SELECT doc_id, v, len(v) n, h, h // 10 g, CASE WHEN len(v) > 0 THEN (h // 10) % len(v) END a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) p FROM e),
w AS (SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN v[1 + a + (i - a) % p] ELSE v[1 + i] END s FROM (SELECT *, unnest(range(n)) i FROM f)),
x AS (SELECT doc_id, i, string_agg(s, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) gram,
             count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) m FROM w),
y AS (SELECT doc_id, i, gram FROM x WHERE m = 6),
z AS (SELECT b.doc_id, b.i, b.i - c.i q FROM y b JOIN y c ON b.doc_id = c.doc_id AND b.gram = c.gram AND b.i > c.i),
s AS (SELECT doc_id, q, min(i) lo, max(i) + 6 hi FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) island FROM z) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, lo - q AS start, hi - (lo - q) AS length, min(q) period FROM s WHERE hi - lo >= greatest(12 - q, q) GROUP BY doc_id, lo - q, hi - (lo - q)),
t AS (SELECT doc_id, count(*) n_runs, first(struct_pack(a := start, b := length, c := period) ORDER BY length DESC, start, period) best,
             string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) said FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) i FROM r),
k AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) n_runs, best.a AS start, best.b AS length, best.c AS period, 1000 * best.b // best.c exponent_milli,
       sha256(coalesce(said, '')) runs_sha256, sha256(coalesce(kept, '')) collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@register("op11_periodic_runs", PERIODIC_RUNS_SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse_runs(with_periodic_words(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    said = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length = -F.col("best.shorter")
    milli = F.expr("(-1000 * best.shorter) div best.period")
    return out.select("doc_id", "n_runs", "best.start", length.alias("length"), "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@register("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


RANKED_SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t FROM documents),
stats AS (SELECT CAST(count(*) AS BIGINT) n_docs, CAST(sum(len(t)) AS BIGINT) l FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) tf FROM (SELECT r, unnest(t) term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) w FROM df, stats),
i AS (SELECT tf.r, term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.t) * n_docs) // l))) impact
      FROM tf JOIN w USING (term) JOIN d ON d.r = tf.r, stats),
s AS (SELECT item_id, r, CAST(sum(times * impact) AS BIGINT) score FROM q JOIN i USING (term) GROUP BY item_id, r),
o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) rank FROM s JOIN d USING (r) WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""


@register("op13_ranked_search", RANKED_SEARCH_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
