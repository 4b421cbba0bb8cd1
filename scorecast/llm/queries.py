"""The registered queries of the operators, one each, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecast.llm import (
    backoff,
    bpe,
    embedding_dedup,
    kd_shards,
    line_dedup,
    minhash,
    mixing,
    phrases,
    quality,
    simhash,
    spelling,
    toxicity,
    url_filter,
)
from scorecast.llm.common import held_out

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"
SHARDS = 8
RULES = (
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@register("op2_kd_shards")
def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = kd_shards.shard(table(spark, sf_dir, "documents"), leaves=SHARDS)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register(
    "op3_embedding_dedup",
    """
    WITH RECURSIVE sound AS (
        SELECT vec_id, e, list_dot_product(e, e) AS square
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)
        WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b
        FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_dot_product(a.e, b.e) / sqrt(a.square * b.square) >= 0.9
    ), reach(vec_id, other) AS (
        SELECT vec_id, vec_id FROM embeddings
        UNION
        SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other
    ), parts AS (
        SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
    ), counts AS (
        SELECT a, count(*) AS n FROM links GROUP BY a
    )
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM parts LEFT JOIN counts ON counts.a = vec_id
    """,
)
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@register(
    "op4_line_dedup",
    """
    WITH split AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
    ), each AS (
        SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split
    ), keyed AS (
        SELECT doc_id, line, pos,
            translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM each
    ), firsts AS (
        SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
    ), marked AS (
        SELECT doc_id, line, pos, coalesce(doc_id <> first_doc, false) AS dropped FROM keyed LEFT JOIN firsts USING (key)
    )
    SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@register(
    "op6_mixing",
    r"""
    WITH sizes AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
        FROM documents
    ), totals AS (
        SELECT source, sum(size)::BIGINT AS source_size,
            [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
            row_number() OVER (ORDER BY source NULLS LAST) AS turn
        FROM sizes GROUP BY source
    ), levels AS (
        SELECT *, 3.0::DOUBLE * source_size AS full_size,
            (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0.0::DOUBLE))
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0.0::DOUBLE)) AS level
        FROM totals
        WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), targets AS (
        SELECT source, source_size, least(max(level) OVER () * w, full_size) AS target FROM levels
    ), parts AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM targets
    ), groups AS (
        SELECT source, hash, sum(size)::BIGINT AS n, (sum(sum(size)) OVER (PARTITION BY source ORDER BY hash))::BIGINT AS running
        FROM sizes GROUP BY source, hash
    ), chosen AS (
        SELECT g.source, g.hash, p.source_size, p.target,
            p.passes + CASE WHEN (p.target - p.passes * p.source_size - (g.running - g.n)) * 2 >= g.n THEN 1 ELSE 0 END AS times
        FROM groups g JOIN parts p ON g.source IS NOT DISTINCT FROM p.source
    )
    SELECT s.doc_id, s.size, c.source_size, round(c.target, 6) AS target, (s.size * c.times)::BIGINT AS taken
    FROM sizes s JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source AND s.hash = c.hash
    """,
)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("passes")).cast("long").alias("taken"))


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    tagged = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.toxicity(F.col("text"), chain).alias("tagged"))
    score = F.col("tagged.score")
    return tagged.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.size("tagged.spans").alias("n_spans"))


@register("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@register("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled URLs are those of the pages that a rule decides."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    _, decided = url_filter.longest_rule(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), RULES)
    model = url_filter.train_url_model(pages.select("url", decided.alias("verdict")))
    return url_filter.filter_urls(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict")


@register("op10_minhash")
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_and_group(table(spark, sf_dir, "documents"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# The 64 letters beyond ASCII as signs of one byte, since DuckDB's levenshtein counts bytes.
BEYOND = "".join(map(chr, range(0xC0, 0x100)))
SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.islower() and c not in "'\\")[:64]


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string's UTF-8 bytes."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT"
    bytes_ = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {byte})"
    shifts = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {bytes_}, lambda c, b: {shifts}))"


@register(
    "op11_spelling",
    f"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, {LOWER.format("run")} AS run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
        WHERE length(run) >= 6 GROUP BY ALL
    ), hashed AS (
        SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs
    ), marked AS (
        SELECT n, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
    ), words AS (
        SELECT word, sum(n)::BIGINT AS n, translate(word, '{BEYOND}', '{SIGNS}') AS plain
        FROM marked WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), keys AS (
        SELECT word, n, plain, plain AS key FROM words
        UNION
        SELECT word, n, plain, left(plain, i) || substr(plain, i + 2) FROM (SELECT *, unnest(range(length(plain)))::INT AS i FROM words)
    ), near AS (
        SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n
        FROM keys a JOIN keys b USING (key) WHERE a.word <> b.word AND levenshtein(a.plain, b.plain) = 1
    ), best AS (
        SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word, n
    ), forms AS (
        SELECT word, n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM best
    ), paths(word, last, steps) AS (
        SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
        UNION ALL
        SELECT p.word, f.form, p.steps + 1 FROM paths p JOIN forms f ON f.word = p.last WHERE f.form IS NOT NULL
    ), roots AS (
        SELECT word, arg_max(last, steps) AS root FROM paths GROUP BY word
    )
    SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
    FROM words w LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
    """,
)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@register(
    "op12_backoff",
    rf"""
    WITH split AS (
        SELECT doc_id, coalesce({crc32_sql("doc_id::VARCHAR")} % 10 = 0, true) AS held_out,
            regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') || [' '] AS l
        FROM documents
    ), tokens AS (
        SELECT doc_id, held_out, l[i] AS w, CASE WHEN i = 1 THEN '' ELSE l[i - 1] END AS h
        FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM split)
    ), ones AS (
        SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w
    ), starts AS (
        SELECT w, c FROM ones UNION ALL SELECT '', count(*) FROM split WHERE NOT held_out
    ), twos AS (
        SELECT h, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY h, w
    ), sums AS (
        SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM ones
    ), each AS (
        SELECT t.doc_id, t.held_out, n, coalesce(ones.c, 0) AS c, (coalesce(ones.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p,
            coalesce(twos.c, 0) AS two, coalesce(starts.c, 0) AS one
        FROM tokens t CROSS JOIN sums LEFT JOIN ones USING (w) LEFT JOIN twos ON twos.h = t.h AND twos.w = t.w LEFT JOIN starts ON starts.w = t.h
    )
    SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, (count(*) FILTER (WHERE c > 0))::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens,
        round(sum(log10(p)), 6) AS base_score, round(sum(log10((two + {backoff.PRIOR}::DOUBLE * p) / (one + {backoff.PRIOR}::DOUBLE))), 6) AS score
    FROM each GROUP BY doc_id, held_out
    """,
)
def op12_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score_texts(table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


@register(
    "op13_phrases",
    rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    ), split AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS l FROM pieces
    ), grams AS (
        SELECT lang, size, array_to_string(l[i:i + size - 1], ' ') AS phrase
        FROM (SELECT lang, l, size, unnest(range(1, len(l) - size + 2)) AS i FROM split CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS size))
    ), counts AS (
        SELECT lang, size, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
    ), totals AS (
        SELECT lang, sum(len(l))::BIGINT AS n FROM split GROUP BY lang
    ), candidates AS (
        SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS l FROM counts WHERE size > 1
    ), cuts AS (
        SELECT c.lang, c.phrase, c.a, k, x.f AS left_f, y.f AS right_f, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
        JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.l[1:k], ' ')
        JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.l[k + 1:], ' ')
    ), worst AS (
        SELECT lang, phrase, a, arg_min(left_f, (score, k)) AS l, arg_min(right_f, (score, k)) AS r, min(score) AS score FROM cuts GROUP BY lang, phrase, a
    ), inner_phrases AS (
        SELECT lang, a AS f, array_to_string(l[i:i + s - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM candidates))
    ), covered AS (
        SELECT DISTINCT w.lang, w.phrase FROM worst w JOIN inner_phrases i ON i.lang = w.lang AND i.phrase = w.phrase WHERE 100 * i.f::HUGEINT >= 80 * w.a::HUGEINT
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst ANTI JOIN covered USING (lang, phrase)
    )
    SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t USING (lang) WHERE r.rank <= 2000
    """,
)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
