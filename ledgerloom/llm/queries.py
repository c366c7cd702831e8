"""The registered queries of the corpus operators and, where SQL expresses them, the same as SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, html_extract, importance_sample, jaccard_join, language_id, line_dedup, packing, periodic_runs,
               secret_scan, spot_signatures, target_resampling, token_counts, url_filter)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and the smallest document it reaches by links."""
    out = jaccard_join.similar_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of token ids and their place in sequences of 4096."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items, and which items."""
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on ten sites or more."""
    out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


ORACLE["op3_line_dedup"] = """
WITH parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM parts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
spread AS (SELECT key, min(doc_id * 1000000000 + place) AS first_at FROM keyed WHERE key <> ''
           GROUP BY key HAVING count(DISTINCT source) >= 10),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id * 1000000000 + k.place <> s.first_at AS gone
           FROM keyed k LEFT JOIN spread s ON k.key = s.key),
rebuilt AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines,
                   count(*) FILTER (WHERE gone) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, r.text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, in the text itself and in what is encoded in it."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(kind) for kind in secret_scan.KINDS), F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"), "n_skipped")


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by the longest rule that fits or by the models of ruled URLs."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op6_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    rows = spot_signatures.with_edits(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited_signs", spot_signatures.signatures(F.col("edited")))
    return rows.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        spot_signatures.fingerprint(F.col("signs")).alias("fingerprint"), spot_signatures.fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        spot_signatures.jaccard(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        spot_signatures.jaccard(F.col("signs"), F.col("next_signs")).alias("near_next"))


@query
def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many documents as the labels let expect to be good, drawn by how much they read like the good ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    share = labels.agg(F.avg(good.cast("double"))).first()[0] or 0.0
    return importance_sample.sample(docs, labels.where(good), round(share * docs.count()))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, one id in ten of which repeats its tail."""
    docs = table(spark, sf_dir, "documents")
    made = docs.select("doc_id", periodic_runs.repeated_tails(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.find_runs(made)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    start, length, period = -longest["col2"], longest["length"], -longest["col3"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: CRC-32 of the hexadecimal digits of bytes, step by step: a byte enters, then eight bits leave.
CRC32 = """xor(list_reduce(flatten(list_transform(range(1, length({0}) // 2 + 1),
    lambda i: [('0x' || substr({0}, 2 * i - 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLE["op11_periodic_runs"] = f"""
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, hex(doc_id::VARCHAR) AS id FROM documents),
sums AS (SELECT doc_id, w, len(w) AS n, {CRC32.format("id")} AS h FROM split),
tails AS (SELECT *, (h // 10) % greatest(n, 1) AS a, h // 10 AS g FROM sums),
made AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
            THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM tails),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM made),
six AS (SELECT doc_id, i, string_agg(word, ' ') OVER six AS gram, count(*) OVER six AS n FROM each
        WINDOW six AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
pairs AS (SELECT a.doc_id, a.i, a.i - b.i AS q FROM six a JOIN six b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i > b.i WHERE a.n = 6 AND b.n = 6),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
matched AS (SELECT doc_id, q, min(i) - q AS start, count(*) + 5 AS m FROM islands GROUP BY doc_id, q, island HAVING count(*) + 5 >= greatest(q, 12 - q)),
runs AS (SELECT doc_id, start, m + q AS length, min(q) AS period FROM matched GROUP BY doc_id, start, m + q),
best AS (SELECT doc_id, count(*) AS n_runs, min(struct_pack(l := -length, s := start, p := period)) AS r,
                string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS text FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT m.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, r.s::BIGINT AS start, (-r.l)::BIGINT AS length, r.p::BIGINT AS period,
       (1000 * -r.l // r.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM made m LEFT JOIN best b ON m.doc_id = b.doc_id LEFT JOIN kept k ON m.doc_id = k.doc_id
"""


@query
def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, its score with noise, and its rank if it is drawn."""
    found = target_resampling.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word"
ORACLE["op12_target_resampling"] = f"""
WITH words AS (SELECT doc_id, {_WORDS} FROM documents), aims AS (SELECT {_WORDS} FROM benchmark),
hashed AS (SELECT word, hex(word) AS x FROM (SELECT word FROM words UNION SELECT word FROM aims)),
buckets AS (SELECT word, {CRC32.format("x")} % 10000 AS bucket FROM hashed),
source AS (SELECT bucket, count(*) AS s FROM words JOIN buckets USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM aims JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM words) AS s_all, (SELECT count(*) FROM aims) AS t_all),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
          FROM source LEFT JOIN target USING (bucket), totals),
weights AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
           FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.*, CASE WHEN place <= 10 * r.n // 100 THEN place END::BIGINT AS rank FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and whether there are more than fit in a sequence."""
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return found.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)
