"""The operators bound to the standard tables: one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .decontam import contaminations
from .divergence import divergences
from .minhash import near_duplicates
from .packing import packed
from .pieces import encoded
from .pii import KINDS, personal_data
from .substrings import without_repeats
from .tokens import tokenized
from .toxicity import held_out, learned, scores
from .urls import judged
from .vectors import near_duplicate_vectors
from .warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    found = scores(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("text_hash")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = lambda c: f"array_join(transform({c}, x -> concat_ws(':', {names}[x.kind], x.start, x.end)), ',')"
    counts = [F.expr(f"size(filter(base, x -> x.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))


#: (host, path, verdict)
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer=vocabulary("word_bpe_49k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"), tokenizer=vocabulary("byte_bpe_50k.json")).drop("shard")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(table(spark, sf_dir, "documents"), model=vocabulary("piece_bpe_32k.model"), with_text=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_epsilon_grid_join": op2_epsilon_grid_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_pii": op5_pii,
    "op6_url_filters": op6_url_filters,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_token_ids": op10_token_ids,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_collocations": op12_collocations,
    "op13_source_divergence": op13_source_divergence,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Distinct runs of n words of each row of a table, the whole sequence where there are fewer.
_SHINGLES = (
    "SELECT DISTINCT {id}, array_to_string(ws[k:k + least(len(ws), {n}) - 1], ' ') AS s FROM "
    "(SELECT {id}, ws, unnest(range(1, greatest(len(ws) - {n}, 0) + 2)) AS k FROM (SELECT {id}, " + _WORDS.format(_LOWER) + " AS ws FROM {table}) WHERE len(ws) > 0)"
)

ORACLE_SQL: dict[str, str] = {
    "op2_epsilon_grid_join": """
        WITH RECURSIVE raw AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        v AS (SELECT * FROM raw WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
        d AS (SELECT page_id, n, sha256(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
        SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM d""",
    "op3_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        windows AS (
            SELECT doc_id, k, md5(array_to_string(ws[k:k + 34], ' ')) AS h
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS k FROM w WHERE len(ws) >= 35)),
        repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM windows JOIN repeated USING (h)),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_minhash_near_dedup": f"""
        WITH RECURSIVE s AS ({_SHINGLES.format(id="doc_id", n=4, table="documents")}),
        sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
            JOIN sizes m ON m.doc_id = p.a JOIN sizes o ON o.doc_id = p.b WHERE 100 * p.c >= 80 * (m.n + o.n - p.c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)""",
    "op9_benchmark_decontamination": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), items AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
        d AS ({_SHINGLES.format(id="r, doc_id", n=5, table="docs")}), every AS ({_SHINGLES.format(id="q, item_id", n=5, table="items")}),
        once AS (SELECT min(q) AS q FROM (SELECT q, item_id, list_sort(list(s)) AS all_s FROM every GROUP BY q, item_id) GROUP BY item_id, all_s),
        i AS (SELECT every.* FROM every JOIN once USING (q)), sizes AS (SELECT q, item_id, count(*) AS n FROM i GROUP BY ALL),
        found AS (SELECT r, doc_id, q, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, n AS n_item_shingles, n_shared, n_shared / n AS containment FROM found JOIN sizes USING (q) WHERE n_shared >= 0.8 * n""",
    "op12_collocations": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
            FROM (SELECT lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY lang),
        runs AS (
            SELECT lang, size, array_to_string(ws[k:k + size - 1], ' ') AS phrase, count(*)::HUGEINT AS f
            FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM pieces, (SELECT unnest(range(1, 6)) AS size) WHERE len(ws) >= size)
            GROUP BY ALL HAVING count(*) >= 100),
        candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM runs WHERE size > 1),
        inside AS (
            SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a
            FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM candidates, (SELECT unnest(range(2, 5)) AS m) WHERE m < size)),
        gone AS (SELECT DISTINCT lang, phrase FROM inside i JOIN candidates c USING (lang, phrase) WHERE 100 * i.a >= 100 * c.a),
        cuts AS (
            SELECT lang, phrase, a, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail, k
            FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates ANTI JOIN gone USING (lang, phrase))),
        scores AS (
            SELECT lang, c.phrase, a, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score, k
            FROM cuts c JOIN runs x USING (lang) JOIN runs y USING (lang) JOIN totals USING (lang) WHERE x.phrase = c.head AND y.phrase = c.tail),
        lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) WHERE rank <= 2000""",
    "op13_source_divergence": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        words AS (SELECT row, lang, source, unnest(ws) AS term FROM docs),
        kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30),
        v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n) AS lang_all FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        cells AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
        sums AS (SELECT lang, source, sum(n) AS group_all FROM cells GROUP BY ALL),
        shares AS (
            SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (coalesce(group_all, 0) + 5 * v) AS p,
                1 + (1000000000 * (lang_n + 5)) // (lang_all + 5 * v) AS q
            FROM groups JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN sums USING (lang, source) LEFT JOIN cells USING (lang, source, term)),
        distances AS (SELECT lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
        pair AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN distances d ON d.lang = x.lang AND d.s1 = x.source AND d.s2 = y.source),
        ranked AS (
            SELECT *, 1000000000 AS top FROM pair
            UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT, 50 FROM shares WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, rank::INTEGER AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked) WHERE rank <= top""",
}
