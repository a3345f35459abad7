"""Queries of the corpus operators over their whole tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.llm.common import table
from lamplight.llm.divergence import source_divergence
from lamplight.llm.exact_dedup import exact_groups
from lamplight.llm.html_text import html_text
from lamplight.llm.lattice import link_embeddings
from lamplight.llm.mixing import mix
from lamplight.llm.near_dedup import near_groups
from lamplight.llm.phrases import collocations
from lamplight.llm.piece_fst import encode_pieces
from lamplight.llm.suffix_dedup import remove_repeats
from lamplight.llm.token_counts import token_counts
from lamplight.llm.toxicity import toxicity
from lamplight.llm.url_rules import judge_urls
from lamplight.llm.word_transducer import decode_bpe, digests, encode_bpe


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ids, decoded = digests(F.col("ids"), F.col("decoded"))
    return decode_bpe(encode_bpe(table(spark, sf_dir, "documents"))).select("doc_id", n.alias("n_tokens"), ids.alias("ids_sha256"), decoded.alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_toxicity, op3_suffix_dedup, op4_embedding_links, op5_source_mix, op6_html_text, op7_url_rules, op8_exact_dedup, op9_pieces, op10_near_dedup, op11_collocations, op12_bpe_codec, op13_source_divergence)
}

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        s AS (SELECT r, doc_id, i, h[i + 1:i + 50] AS k FROM (SELECT r, doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50 AND doc_id IS NOT NULL)),
        o AS (SELECT k, min(doc_id) AS own FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
        g AS (SELECT r, i FROM s JOIN o ON s.k = o.k WHERE doc_id > own),
        f AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g),
        p AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM f),
        q AS (SELECT r, span, min(i) AS a, max(i) + 50 AS b FROM p GROUP BY r, span),
        t AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS e FROM q),
        k AS (SELECT t.r, sum(b - a)::BIGINT AS removed, count(*) AS spans, string_agg(hex(h[e + 1:a]), '' ORDER BY a) AS left_, max(b) AS last FROM t JOIN d ON d.r = t.r GROUP BY t.r)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(left_, '') || hex(h[coalesce(last, 0) + 1:n]))) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r""",
    "op4_embedding_links": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
        ), p AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), r AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
        ), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id""",
    "op5_source_mix": r"""
        WITH t AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\x0b\f]+', ' ', 'g'), ' ') AS t FROM documents),
        d AS (SELECT doc_id, source, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::BIGINT AS tokens,
                     md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS o FROM t),
        s AS (SELECT source, sum(tokens)::BIGINT AS have, count(*) AS n FROM d GROUP BY source),
        g AS (SELECT sum(have)::DOUBLE AS total, min(have) FILTER (have > 0)::DOUBLE AS low, max(have)::DOUBLE AS high, sum(n) AS n FROM s),
        x AS (SELECT *, CASE WHEN high / low <= 1.5 THEN 0.0 ELSE 1 - ln(1.5) / ln(high / low) END::DOUBLE AS tau, greatest(1, ceil(n / 2000.0))::BIGINT AS blocks FROM g),
        z AS (SELECT x.*, (SELECT sum(pow(have / x.total, x.tau)) FROM s WHERE have > 0) AS z FROM x),
        b AS (SELECT *, floor(total * z * pow(high / total, 1 - tau) + 0.5) AS budget FROM z),
        q AS (SELECT source, have, blocks, CASE WHEN have > 0 THEN floor(pow(have / total, tau) / z * budget + 0.5)::BIGINT ELSE 0 END AS quota FROM s, b),
        p AS (SELECT source, blocks, CASE WHEN have > 0 THEN quota // have ELSE 1 END AS epochs, CASE WHEN have > 0 THEN quota % have ELSE 0 END AS rest FROM q),
        k AS (SELECT d.*, p.epochs, p.rest, (('0x' || substr(o, 1, 8))::BIGINT % blocks)::INT AS block FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
        bs AS (SELECT source, block, any_value(rest) AS rest, sum(tokens) AS sum FROM k GROUP BY source, block),
        br AS (SELECT *, sum(sum) OVER (PARTITION BY source ORDER BY block) AS stop FROM bs),
        e AS (SELECT source, min(block) AS edge, min_by(stop - sum, block) AS before FROM br WHERE stop > rest GROUP BY source),
        w AS (SELECT k.*, e.edge, e.before, sum(tokens) OVER (PARTITION BY k.source, block ORDER BY o, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS run
              FROM k LEFT JOIN e ON k.source IS NOT DISTINCT FROM e.source),
        f AS (SELECT *, epochs + CASE WHEN edge IS NULL OR block < edge THEN (rest > 0)::INT WHEN block = edge THEN (run + before <= rest)::INT ELSE 0 END AS times FROM w)
        SELECT doc_id, source, tokens, block, unnest(range(times))::INT AS epoch FROM f WHERE times > 0""",
    "op7_url_rules": """
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\\n)*$', '') ELSE '' END AS r FROM pages),
        h AS (SELECT page_id, CASE WHEN strpos(r, '/') > 0 THEN substr(r, 1, strpos(r, '/') - 1) ELSE coalesce(r, '') END AS h0,
                     CASE WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/')) ELSE '' END AS path FROM u),
        l AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
        k(verdict, rule, rh, rp) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
            ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
        m AS (SELECT page_id, host, path, (SELECT max_by(struct_pack(v := verdict, r := rule), len(rule)) FROM k
                     WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS b FROM l)
        SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM m""",
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op11_collocations": r"""
        WITH p AS (SELECT doc_id, r, coalesce(lang, 'und') AS lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(string_split_regex(t, '[.,;:!?\x0A-\x0D]'), 1) AS k
              FROM (SELECT doc_id, row_number() OVER () AS r, lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
        w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[ \t]+') IF x <> ''] AS w FROM p),
        t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        g AS (SELECT lang, w[i:i + k - 1] AS g, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
        f AS MATERIALIZED (SELECT lang, g, k, count(*) AS f FROM g GROUP BY lang, g, k HAVING count(*) >= 10),
        s AS (SELECT *, g[1:cut] AS lg, g[cut + 1:k] AS rg FROM f, (VALUES (1), (2)) v(cut) WHERE cut < k),
        c AS (SELECT s.lang, s.g, s.k AS size, s.f AS a, cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * s.f * s.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
              FROM s JOIN f l ON l.lang = s.lang AND l.g = s.lg JOIN f r ON r.lang = s.lang AND r.g = s.rg),
        b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
        d AS (SELECT lang, g[1:2] AS g, max(f) AS f FROM (SELECT lang, g, f FROM f WHERE k = 3 UNION ALL SELECT lang, g[2:3], f FROM f WHERE k = 3) GROUP BY ALL),
        k AS (SELECT b.* FROM b LEFT JOIN d ON d.lang = b.lang AND d.g = b.g WHERE size = 3 OR d.f IS NULL OR 100 * d.f < 50 * a),
        o AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM k),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        o AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
        k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM o GROUP BY lang, term HAVING count(*) >= 10),
        l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM k GROUP BY lang),
        s AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT o.lang, o.source, o.term, sum(o.n)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
        t AS (SELECT s.lang, s.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM s LEFT JOIN c USING (lang, source) GROUP BY ALL),
        g AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (t.total + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
              FROM t JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
                     LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM g WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x QUALIFY part = 'pair' OR rank <= 10""",
}
