"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocation, fingerprint, language, linededup, manifest, neardup, packing, quality, sharding, topk, toxicity, urlfilter
from .tables import fold, read

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedupe(docs, min_words=50)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=16)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), WORD_TOKENIZER, window=2048)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), fold("doc_id", 3) == 1
    model = language.fit(docs, ~held_out)
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~held_out, quality.editorial_grade())
    return quality.score(docs, model).withColumn("held_out", held_out)


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.integer_vectors(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, k=20)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


URL_RULES = [urlfilter.Rule.parse(says, text) for says, text in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]


def op11_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op12_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(read(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.verify(manifest.build(read(spark, sf_dir, "documents"), shown={"text": tampered}))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_linededup, op2_sharding, op3_packing, op4_toxicity, op5_language, op6_quality, op7_neardup, op8_bpe, op9_topk, op10_fingerprint, op11_urlfilter, op12_collocation, op13_manifest)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_linededup": """
            WITH d AS (
                SELECT doc_id, text, row_number() OVER (ORDER BY doc_id, text) AS id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls
                FROM (SELECT DISTINCT doc_id, text FROM documents)
            ), l AS (
                SELECT id, ls, unnest(range(1, len(ls) + 1)) AS s FROM d
            ), w AS (
                SELECT id, ls, s, length(ls[s]) - length(replace(ls[s], ' ', '')) + 1 AS w FROM l
            ), c AS (
                SELECT id, ls, s, sum(w) OVER (PARTITION BY id ORDER BY s) AS c1, w FROM w
            ), r AS (
                SELECT a.id, a.s, b.s AS e, array_to_string(list_slice(a.ls, a.s, b.s), chr(10)) AS run
                FROM c a JOIN c b ON a.id = b.id AND a.s <= b.s
                WHERE b.c1 - (a.c1 - a.w) >= 50 AND ((b.c1 - b.w) - (a.c1 - a.w) < 50 OR b.c1 - a.c1 < 50)
            ), n AS (
                SELECT *, row_number() OVER (PARTITION BY run ORDER BY id, s) AS k FROM r
            ), g AS (
                SELECT DISTINCT id, unnest(range(s, e + 1)) AS s FROM n WHERE k > 1
            ), k AS (
                SELECT c.id, count(g.s) AS gone,
                       coalesce(string_agg(c.ls[c.s], chr(10) ORDER BY c.s) FILTER (WHERE g.s IS NULL), '') AS kept
                FROM c LEFT JOIN g ON c.id = g.id AND c.s = g.s GROUP BY c.id
            )
            SELECT o.doc_id, CASE WHEN coalesce(gone, 0) > 0 THEN kept ELSE o.text END AS text,
                   coalesce(len(ls), 0)::INTEGER AS lines_before, coalesce(gone, 0)::INTEGER AS lines_removed
            FROM documents o JOIN d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND o.text IS NOT DISTINCT FROM d.text LEFT JOIN k ON d.id = k.id""",
        "op9_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v, row_number() OVER () AS row FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), q AS (
                SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id, c.row, max(list_inner_product(q.v, c.v))::BIGINT AS score FROM q JOIN v c ON q.vec_id <> c.vec_id GROUP BY ALL
            ), r AS (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op11_urlfilter": """
            WITH a AS (
                SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
            ), u AS (
                SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
                FROM a
            ), r AS (
                SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                               WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                               WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                               WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
                FROM u
            )
            SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
        "op12_collocation": r"""
            WITH d AS (
                SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
            ), p AS (
                SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda w: w <> '') AS ws FROM d
            ), i AS (
                SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p
            ), k AS (
                SELECT lang, ws, i, unnest(range(1, least(6, len(ws) - i + 2))) AS k FROM i
            ), f AS (
                SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM k GROUP BY ALL
            ), t AS (
                SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
            ), c AS (
                SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100
            ), o AS (
                SELECT lang, phrase, max(f) AS over FROM (
                    SELECT lang, f, k, i, j, array_to_string(ws[i : i + j - 1], ' ') AS phrase
                    FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c)))
                GROUP BY ALL
            ), x AS (
                SELECT c.*, unnest(range(1, c.k)) AS cut FROM c LEFT JOIN o ON c.lang = o.lang AND c.phrase = o.phrase WHERE o.over IS NULL OR 100 * o.over < 100 * c.f
            ), s AS (
                SELECT x.lang, x.phrase, x.f AS a, x.cut, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * x.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
                FROM x JOIN t ON t.lang = x.lang
                JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1 : x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.cut + 1 :], ' ')
            ), b AS (
                SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS z FROM s
            ), q AS (
                SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank FROM b WHERE z = 1
            )
            SELECT lang, rank, phrase, a, l, r, n, score FROM q WHERE rank <= 2000""",
        "op13_manifest": """
            WITH RECURSIVE b AS (
                SELECT doc_id, source, lang, n_chars, text, coalesce('=' || source, '') AS grp,
                       list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                           lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))) AS crc
                FROM documents
            ), t AS (
                SELECT *, CASE WHEN crc IS NOT NULL AND xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown FROM b
            ), f AS (
                SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                          || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
                FROM t
            ), leaves AS (
                SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS shown_leaf FROM f
            ), placed AS (
                SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
            ), up AS (
                SELECT 0 AS level, grp, pos, n, leaf AS h FROM placed
                UNION ALL
                SELECT level + 1, grp, pos // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, grp, pos // 3
            ), tops AS (
                SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
            ), over AS (
                SELECT 0 AS level, pos, n, h FROM tops
                UNION ALL
                SELECT level + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY level, pos // 3
            ), low AS (
                SELECT p.grp, p.pos, u.level, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < p.pos // (3 ** u.level)::BIGINT), '') AS before,
                       coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > p.pos // (3 ** u.level)::BIGINT), '') AS after
                FROM placed p JOIN up u ON u.grp = p.grp AND u.n > 1 AND u.pos // 3 = p.pos // (3 ** (u.level + 1))::BIGINT GROUP BY ALL
            ), high AS (
                SELECT p.grp, u.level, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < p.pos // (3 ** u.level)::BIGINT), '') AS before,
                       coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > p.pos // (3 ** u.level)::BIGINT), '') AS after
                FROM tops p JOIN over u ON u.n > 1 AND u.pos // 3 = p.pos // (3 ** (u.level + 1))::BIGINT GROUP BY ALL
            ), lows AS (SELECT grp, pos, list({b: before, a: after} ORDER BY level) AS path FROM low GROUP BY grp, pos
            ), highs AS (SELECT grp, list({b: before, a: after} ORDER BY level) AS path FROM high GROUP BY grp
            ), whole AS (
                SELECT p.doc_id, p.leaf, p.shown_leaf, t.h AS subroot, (SELECT h FROM over WHERE n = 1) AS root,
                       list_concat(coalesce(l.path, []), coalesce(h.path, [])) AS path
                FROM placed p JOIN tops t ON t.grp = p.grp LEFT JOIN lows l ON l.grp = p.grp AND l.pos = p.pos LEFT JOIN highs h ON h.grp = p.grp
            ), proved AS (
                SELECT *, sha256(list_reduce(list_prepend('', list_transform(path, lambda x: x.b || x.a)), lambda s, x: s || x)) AS proof_sha256,
                       list_reduce(list_prepend({b: shown_leaf, a: ''}, path), lambda s, x: {b: sha256(x.b || s.b || x.a), a: ''}).b AS folded_root
                FROM whole
            )
            SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM proved""",
    }
