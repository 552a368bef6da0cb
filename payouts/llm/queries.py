"""Named queries of the operators, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payouts.llm import blob_ledger, content_sort, decontaminate, jaccard_join, katz, language_codes, lexical_search, license_windows, phrase_prints, pieces, prefix_trie, style_tree, toxicity
from payouts.llm.common import new_folder, table


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = toxicity.held_out("doc_id", 3, 1)
    model = language_codes.train(docs, ~held)
    return language_codes.identified(docs, model).withColumn("held_out", held)


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, folder, "documents"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scanned = blob_ledger.scan(docs, new_folder(spark, "blob-ledger"))
    base = [r.kind for r in blob_ledger.BASE_RULES]
    found = F.col("findings")
    counts = [F.coalesce(F.size(found[k]), F.lit(0)).cast("long").alias(f"n_{k}") for k in base]
    return scanned.select(
        "doc_id", *counts, F.sha2(blob_ledger.listed(found, base), 256).alias("base_sha256"),
        blob_ledger.listed(found, [r.kind for r in blob_ledger.RULES]).alias("spans"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return content_sort.exact_groups(table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"), ~toxicity.held_out("label_id", 4, 2))
    scored = toxicity.scored(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_windows.scanned(table(spark, folder, "documents"))


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = style_tree.extracted(table(spark, folder, "pages"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return katz.scored(docs, toxicity.held_out("doc_id", 5, 1), least=1)


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_phrase_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_prints.fingerprints(table(spark, folder, "documents"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations")).drop("tour_enter", "tour_exit")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_sentencepiece, op3_ngram_jaccard_join, op4_secret_scan, op5_exact_dedup, op6_toxicity, op7_license_scan, op8_html_extraction, op9_decontamination, op10_katz_backoff,
                                   op11_lexical_search, op12_phrase_fingerprints, op13_prefix_trie)}

UPPER_TO_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def _secrets_sql() -> str:
    """Matches of each rule from the pieces between them, as spans; counts and digests of the base rules."""
    parts = []
    for place, rule in enumerate(blob_ledger.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, length(m[i]) AS n,
            CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m,
                regexp_extract_all(t, '{pattern}', {rule.group}) AS v, regexp_split_to_array(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}')))
            WHERE length(v[i]) >= {rule.least}""")
    base = len(blob_ledger.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in blob_ledger.BASE_RULES)
    span = "kind || ':' || s || ':' || s + n"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ({' UNION ALL '.join(parts)})
        SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY s, place) FILTER (place < {base}), '')) AS base_sha256,
            coalesce(string_agg({span}, ',' ORDER BY s, place), '') AS spans
        FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id"""


ORACLE = {
    "op4_secret_scan": _secrets_sql(),
    "op3_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_TO_LOWER}), '[^\x20\x09-\x0D]+') AS t FROM documents),
        s AS (SELECT DISTINCT doc_id, list_slice(t, i, i + 4) AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM d WHERE len(t) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.m)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
    "op9_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_TO_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, {UPPER_TO_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (SELECT item, t, least(10, len(t)) AS w, unnest(range(1, len(t) - least(10, len(t)) + 2)) AS i FROM b WHERE len(t) > 0),
        grams AS (SELECT DISTINCT item, w, list_slice(t, i, i + w - 1) AS g FROM bw),
        widths AS (SELECT DISTINCT w FROM grams),
        dw AS (SELECT doc_id, t, w, unnest(range(1, len(t) - w + 2)) AS i FROM d, widths WHERE len(t) >= w),
        hits AS (SELECT doc_id, i, dw.w, item FROM dw JOIN grams ON grams.w = dw.w AND grams.g = list_slice(dw.t, dw.i, dw.i + dw.w - 1)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
        SELECT d.doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
            sha256(coalesce(l, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
}


TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLE["op11_lexical_search"] = rf"""
    WITH k AS (SELECT row_number() OVER () AS key, doc_id, t, len(t) AS n FROM (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_TO_LOWER}), {TERMS}) AS t FROM documents) WHERE len(t) > 0),
    st AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM k),
    p AS (SELECT key, doc_id, n, term, count(*) AS tf FROM (SELECT key, doc_id, n, unnest(t) AS term FROM k) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    qt AS (SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), {UPPER_TO_LOWER}), {TERMS})) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
    s AS (SELECT qt.item_id, qt.text, p.key, p.doc_id,
            sum(CAST(floor(1000 * ln((2.0 * big_n + 2) / (2.0 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * big_n) // big_l)))) AS score
          FROM qt JOIN p USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, CAST(score AS BIGINT) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST, key) AS rank FROM s WHERE score > 0)
    WHERE rank <= 10"""

ORACLE["op13_prefix_trie"] = r"""
    WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT c, count(*) AS len, CAST(c AS VARCHAR) AS s FROM t GROUP BY c),
    crc(c, s, k, v) AS (SELECT c, s, 0, CAST(4294967295 AS BIGINT) FROM ids
        UNION ALL SELECT c, s, k + 1, CASE WHEN k % 9 = 0 THEN xor(v, ascii(substr(s, k // 9 + 1, 1)))
            ELSE xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) END FROM crc WHERE k < 9 * length(s)),
    convs AS (SELECT ids.c, ids.len, xor(crc.v, 4294967295) % 9 AS h, ids.c - ids.c % 5 AS b, base.len AS len_b
        FROM ids JOIN crc ON crc.c = ids.c AND crc.k = 9 * length(ids.s) LEFT JOIN ids base ON base.c = ids.c - ids.c % 5),
    sized AS (SELECT *, least(h, coalesce(len_b, 0)) AS hb, least(h, coalesce(len_b, 0)) + greatest(len - h, 0) AS length FROM convs),
    r AS (SELECT sized.c, t.pos, t.role, t.text FROM sized JOIN t ON t.c = sized.b AND t.pos < sized.h
        UNION ALL SELECT sized.c, t.pos - sized.h + sized.hb, t.role, t.text FROM sized JOIN t ON t.c = sized.c AND t.pos >= sized.h),
    lists AS (SELECT sized.c, sized.length, coalesce((SELECT list(struct_pack(role := r.role, text := r.text) ORDER BY r.pos) FROM r WHERE r.c = sized.c), []) AS l FROM sized),
    m AS (SELECT c, length, d, list_slice(l, 1, d) AS key, CASE WHEN d = 0 THEN 0 ELSE strlen(l[d].text) END AS bytes
        FROM (SELECT *, unnest(range(0, length + 1)) AS d FROM lists)),
    nodes AS (SELECT key, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
            sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (length = d), '')) AS ends_sha256 FROM m GROUP BY key),
    linked AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes ch WHERE ch.depth = n.depth + 1 AND list_slice(ch.key, 1, n.depth) = n.key) AS n_children
        FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = list_slice(n.key, 1, n.depth - 1))
    SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, v.parent_conv_id, v.n_convs, v.n_children,
        count(*) FILTER (u.n_children = 0) AS n_leaves, CAST(sum((u.n_convs - 1) * u.bytes) AS BIGINT) AS saved_tokens, v.ends_sha256
    FROM linked v JOIN linked u ON u.depth >= v.depth AND list_slice(u.key, 1, v.depth) = v.key
    GROUP BY v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, v.ends_sha256"""
