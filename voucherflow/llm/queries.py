"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherflow.llm import chat, collocations, decontaminate, kneser_ney, language, line_dedup, mixing, pii, sharding, simhash, topk, url_filter, vector_codes
from voucherflow.llm.common import crc_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op9_minimax_shards")
def op9(spark, folder):
    """Every document in one of 24 shards of near-equal bytes; equal texts share a shard."""
    return sharding.shard(table(spark, folder, "documents"), shards=24)


@query("op2_vantage_components")
def op2(spark, folder):
    """Every document's 64-bit fingerprint over 4-word shingles and its component at 4 or fewer differing bits."""
    found = simhash.components(table(spark, folder, "documents"), words=4, radius=4)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


@query("op6_block_top5", """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM good q, good c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM scored)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5""")
def op6(spark, folder):
    """The 5 largest integer inner products of each vector whose id is divisible by 50 with all other vectors."""
    vectors = topk.quantized(table(spark, folder, "embeddings"), "embedding")
    return topk.top_k(vectors, F.pmod(F.col("vec_id"), F.lit(50)) == 0, 5)


@query("op8_offset_masks")
def op8(spark, folder):
    """Every conversation and one that holds the control strings themselves, formatted, masked and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(rows.unionByName(extra)))


@query("op4_checked_spans")
def op4(spark, folder):
    """Personal data in every document: counts and digest of the base kinds, and all spans."""
    return pii.digest(pii.find(table(spark, folder, "documents")))


@query("op1_crf_language")
def op1(spark, folder):
    """Language of every document, learned from the labelled documents that are not held out."""
    docs = table(spark, folder, "documents")
    held_out = F.pmod(crc_of("doc_id"), F.lit(4)) == 2
    field = language.learn(docs, ~held_out)
    found = language.identify(docs, field)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words", F.size("runs").alias("n_runs"))


@query("op3_kneser_ney")
def op3(spark, folder):
    """Every document's log10 probability under a bigram model of the documents that are not held out."""
    docs = table(spark, folder, "documents")
    held_out = F.pmod(crc_of("doc_id"), F.lit(10)) == 0
    model = kneser_ney.fit(docs.where(~held_out))
    return kneser_ney.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@query("op10_latent_contamination")
def op10(spark, folder):
    """Every document that holds a benchmark item or a paraphrase of it, with the item and how far they agree."""
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_hierarchical_mix")
def op5(spark, folder):
    """The documents that a tree of domains, languages and sources gives for as many tokens as there are, in up to two epochs."""
    docs = table(spark, folder, "documents")
    mixed = mixing.select(docs, mixing.source_domain(), budget_share=1.0, max_epochs=2, temperature=0.3)
    return mixed.select("doc_id", "mix_domain", "lang", "source", "mix_tokens", "mix_epochs")


@query("op7_patience_lines")
def op7(spark, folder):
    """Every document without the line blocks that it shares with an earlier one."""
    cleaned = line_dedup.dedup(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_deleted", F.length("text").alias("kept_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@query("op13_url_rules", f"""
WITH rules(rule_host, rule_path, said) AS (VALUES {", ".join(map(str, URL_RULES))}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
placed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM cut),
fits AS (SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(said, length(rule_host || rule_path)) AS said
         FROM placed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM placed LEFT JOIN fits USING (n)""")
def op13(spark, folder):
    """The verdict of five rules on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), rules).select("page.page_id", "host", "path", "rule", "verdict")


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Six rounds written out: nearest entries by a window over all distances, then floored means."""
    steps = [f"""
kept AS (SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT n, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) r(p)),
starts AS (SELECT n, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept QUALIFY e < {entries}),
book0 AS (SELECT p, e, x AS c FROM cut JOIN starts USING (n))"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (SELECT n, p, x, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (
              SELECT n, p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM cut JOIN book{k} USING (p)) GROUP BY n, p, x)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
              FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS (SELECT p, e, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))""")
    return "WITH " + ",".join(steps) + f""",
coded AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY n),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (n), digest"""


@query("op11_bounded_codes", _codes_sql())
def op11(spark, folder):
    """The 8-part code of every vector after six rounds, its error and that of its label."""
    codes = vector_codes.compress(table(spark, folder, "embeddings"), "embedding", "label")
    return vector_codes.with_label_error(codes.rows).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))


@query("op12_collocations", r"""
WITH split AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
runs AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM split),
grams AS (SELECT lang, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS phrase
          FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM runs, range(1, 6) s(size) WHERE len(w) >= size)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w)) AS n FROM runs GROUP BY lang),
cuts AS (SELECT lang, phrase, size, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') AS tail
         FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1)),
cut_scores AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, l.f AS l, r.f AS r, CAST(t.n AS BIGINT) AS n,
                      CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
               FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.head JOIN counts r ON r.lang = c.lang AND r.phrase = c.tail JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ones AS (SELECT DISTINCT s.lang, s.phrase FROM counts s JOIN counts b ON s.lang = b.lang AND b.size > s.size AND s.size > 1 AND 100 * b.f >= 100 * s.f AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS "rank", phrase, a, l, r, n, score
FROM lowest ANTI JOIN inner_ones USING (lang, phrase) QUALIFY "rank" <= 2000""")
def op12(spark, folder):
    """The 2,000 phrases of 2 to 5 words that hold together best in each language, of those that occur 100 times or more."""
    return collocations.collocations(table(spark, folder, "documents"), threshold=100, longest=5, top=2000)
