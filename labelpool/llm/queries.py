"""The registered queries of this folder and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpool.llm import language_id, quality_lm, toxicity
from labelpool.llm.best_fit_packing import pack
from labelpool.llm.cap_filters import cap_near_dedup
from labelpool.llm.conversation_repair import repair_conversations
from labelpool.llm.exact_dedup import exact_dedup
from labelpool.llm.exact_topk import top_k
from labelpool.llm.license_scan import AGREE, NOTICES, PHRASES, scan_licenses
from labelpool.llm.near_dedup import near_dedup
from labelpool.llm.quotation_links import link_quotations
from labelpool.llm.reversed_search import reversed_search
from labelpool.llm.sentencepiece_bpe import digest_documents


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _remainder(by: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by))


def op1_quotation_links(spark: SparkSession, sf: str) -> DataFrame:
    return link_quotations(_read(spark, sf, "conversations"))


QUOTATION_SQL = r"""
WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text
    FROM conversations
), lines AS (
    SELECT r, conv_id, turn, i, string_split(text, chr(10))[i] AS line
    FROM rows, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)
), levels AS (
    SELECT *, len(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) AS level,
           regexp_replace(line, '^(?:[ \t]*>)*[ \t]?', '') AS body
    FROM lines
), marked AS (
    SELECT *, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS norm,
           level = 0 AND coalesce(lead(level) OVER (PARTITION BY r ORDER BY i), 0) > 0
               AND regexp_matches(line, '(?i)\b(wrote|writes|schrieb|écrit|escribió)\b[^:]*:\s*$') AS credit
    FROM levels
), said AS (
    SELECT DISTINCT conv_id, turn, norm FROM marked WHERE level = 0 AND norm <> '' AND NOT credit
), quoted AS (
    SELECT r, conv_id, turn, level, norm FROM marked WHERE level > 0 AND norm <> ''
), first_said AS (
    SELECT conv_id, norm, min(turn) AS origin FROM said GROUP BY ALL
), found AS (
    SELECT q.conv_id, q.turn, q.level, f.origin, count(*) AS n
    FROM quoted q JOIN first_said f USING (conv_id, norm) WHERE f.origin < q.turn GROUP BY ALL
), replies AS (
    SELECT conv_id, turn, first(origin ORDER BY level, n DESC, origin DESC) AS reply_to, sum(n)::BIGINT AS n_linked
    FROM found GROUP BY ALL
), up AS (
    SELECT conv_id, turn, reply_to AS root FROM replies
    UNION
    SELECT up.conv_id, up.turn, r.reply_to FROM up JOIN replies r ON r.conv_id = up.conv_id AND r.turn = up.root
), roots AS (
    SELECT conv_id, turn, min(root) AS root FROM up GROUP BY ALL
), made AS (
    SELECT w.r, w.conv_id, w.turn, w.role, p.reply_to, coalesce(t.root, w.turn) AS thread,
           coalesce(p.n_linked, 0)::BIGINT AS n_linked,
           (SELECT count(*) FROM quoted q WHERE q.r = w.r) AS n_quoted,
           coalesce((SELECT max(level) FROM quoted q WHERE q.r = w.r), 0)::INTEGER AS max_level,
           coalesce((SELECT trim(string_agg(line, chr(10) ORDER BY i), chr(10)) FROM marked m
                     WHERE m.r = w.r AND level = 0 AND NOT credit), '') AS clean_text
    FROM rows w LEFT JOIN replies p USING (conv_id, turn) LEFT JOIN roots t USING (conv_id, turn)
)
SELECT conv_id, turn, role, reply_to, thread,
       row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, role) - 1 AS position,
       n_quoted, n_linked, max_level, clean_text
FROM made
"""


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").withColumn(
        "held_out", F.coalesce(_remainder(5) == 0, F.lit(False))
    )
    labels = _read(spark, sf, "labels").where(_remainder(5) != 0)
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(_read(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


EXACT_TOPK_SQL = """
WITH good AS (
    SELECT vec_id, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT vec_id, unnest(range(len(embedding))) AS i,
           floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS v
    FROM good
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, sum(q.v * c.v)::BIGINT AS score
    FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
    GROUP BY q.vec_id, c.vec_id
)
SELECT query_id,
       (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    docs = _read(spark, sf, "documents").withColumn("held_out", held)
    model = language_id.train(docs.where(~F.col("held_out")))
    out = language_id.identify(docs, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op5_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup(_read(spark, sf, "documents"), shingle=4, percent=80)


def op6_quality_lm(spark: SparkSession, sf: str) -> DataFrame:
    trusted = _read(spark, sf, "labels").where("quality = 1")
    return quality_lm.classify(_read(spark, sf, "documents"), trusted)


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_read(spark, sf, "documents"))


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(_read(spark, sf, "documents"))


def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return digest_documents(_read(spark, sf, "documents"), model, ["doc_id"])


def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(_read(spark, sf, "documents"), ["doc_id"]).drop("places")


EXACT_DEDUP_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

NEAR_DEDUP_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 4
            THEN list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))
            ELSE [array_to_string(w, ' ')] END) AS s
        FROM d WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), named AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN named USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _license_sql() -> str:
    quote = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = [(label, True, p.split(), 0, p.split()) for p, label in PHRASES.items()]
    for label, notice, key in NOTICES:
        body, k = notice.split(), key.split()
        at = next(i for i in range(len(body)) if body[i : i + len(k)] == k)
        rows.append((label, False, body, at, k))
    values = ",\n        ".join(
        f"('{label}', {base}, {quote(body)}, {at}, {quote(k)})" for label, base, body, at, k in rows
    )
    return rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), t(label, base, body, lead_in, key) AS (
    VALUES {values}
), starts AS (
    SELECT doc_id, w, t.*, p - lead_in AS s
    FROM d JOIN t ON list_contains(w, key[1]), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)
    WHERE w[p] = key[1] AND w[p:p + len(key) - 1] = key
), hits AS (
    SELECT doc_id, label, base, s - 1 AS start, len(body) AS size,
           len(list_filter(range(1, len(body) + 1),
                           lambda k: s + k - 1 >= 1 AND w[s + k - 1] = body[k])) AS agree
    FROM starts
), found AS (
    SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
           max(start) FILTER (base) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
           max(agree / size * CASE WHEN base THEN 0.5::DOUBLE ELSE 1::DOUBLE END) AS score
    FROM hits WHERE agree >= {AGREE} * size GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)
"""


def op11_cap_filters(spark: SparkSession, sf: str) -> DataFrame:
    return cap_near_dedup(_read(spark, sf, "embeddings"), threshold=0.95)


CAP_FILTERS_SQL = """
WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
    SELECT r, vec_id, e FROM rows
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
    SELECT r, r AS other FROM rows
    UNION
    SELECT reach.r, l.b FROM reach JOIN links l ON l.a = reach.other
), named AS (
    SELECT reach.r, min(vec_id) AS component_id FROM reach JOIN rows ON rows.r = reach.other GROUP BY reach.r
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = rows.r) AS n_links, component_id,
       coalesce(vec_id = component_id, false) AS kept
FROM rows JOIN named USING (r)
"""


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair_conversations(_read(spark, sf, "conversations"))


# The cheapest repair by a finite automaton: o before all turns, s, u, a after such a turn.
REPAIR_SQL = r"""
WITH RECURSIVE bytes AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
        CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
), coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce([4294967295] || list_transform(
                   string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                   lambda k: ord(k)::BIGINT),
               lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 AS code
    FROM conversations, bytes
), damaged AS (
    SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
           CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
    FROM coded WHERE code <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i
    FROM damaged
), marked AS (
    SELECT *, left(role, 1) AS x,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated'
                ELSE '' END AS fault,
           coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1)
                    NOT IN ('su', 'ua', 'au'), false) AS odd
    FROM placed
), faults AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal, max(i) AS n
    FROM marked GROUP BY conv_id
), ins(a, b, c, w) AS (
    VALUES ('o', 'o', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('o', 'u', 3, 'I'),
           ('o', 'a', 6, 'II'), ('s', 'u', 3, 'I'), ('s', 'a', 6, 'II'), ('u', 'a', 3, 'I'), ('a', 'u', 3, 'I')
), act(a, b, x, c, w) AS (
    VALUES ('o', 's', 's', 0, 'K'), ('o', 'u', 'u', 0, 'K'), ('s', 'u', 'u', 0, 'K'), ('a', 'u', 'u', 0, 'K'),
           ('u', 'a', 'a', 0, 'K'), ('o', 'u', NULL, 3, 'R'), ('s', 'u', NULL, 3, 'R'), ('a', 'u', NULL, 3, 'R'),
           ('u', 'a', NULL, 3, 'R'), ('o', 'o', NULL, 4, 'D'), ('s', 's', NULL, 4, 'D'), ('u', 'u', NULL, 4, 'D'),
           ('a', 'a', NULL, 4, 'D')
), walk AS (
    SELECT conv_id, 0::BIGINT AS i, 'o' AS s, {'c': 0::BIGINT, 'w': ''} AS v FROM faults
    UNION ALL
    SELECT walk.conv_id, m.i, act.b, min({'c': walk.v.c + ins.c + act.c + CASE
               WHEN act.w <> 'D' AND m.fault = 'truncated' THEN 3 ELSE 0 END, 'w': walk.v.w || ins.w || act.w})
    FROM walk JOIN marked m ON m.conv_id IS NOT DISTINCT FROM walk.conv_id AND m.i = walk.i + 1
    JOIN ins ON ins.a = walk.s JOIN act ON act.a = ins.b AND coalesce(act.x, m.x) = m.x
    WHERE act.w = 'D' OR m.fault NOT IN ('blank', 'duplicate')
    GROUP BY walk.conv_id, m.i, act.b
), best AS (
    SELECT f.conv_id, min({'c': v.c + ins.c, 'w': v.w || ins.w}) AS v
    FROM faults f JOIN walk ON walk.conv_id IS NOT DISTINCT FROM f.conv_id AND walk.i = f.n
    JOIN ins ON ins.a = walk.s AND ins.b IN ('o', 'a') GROUP BY f.conv_id
), edits AS (
    SELECT conv_id, p, v.w[p] AS e FROM best, LATERAL (SELECT unnest(range(1, len(v.w) + 1)) AS p)
), lined AS (
    SELECT *, sum((e <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS i,
           sum((e <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS j
    FROM edits
), said AS (
    SELECT l.conv_id, e, j, m.role, m.x, m.text FROM lined l
    LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i AND e <> 'I' WHERE e <> 'D'
), lead AS (
    SELECT conv_id, max((j = 1 AND e = 'K' AND x = 's')::INT) AS lead FROM said GROUP BY conv_id
), hashed AS (
    SELECT said.conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (j - lead) % 2 = 1 THEN 'user'
               ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha
    FROM said JOIN lead ON lead.conv_id IS NOT DISTINCT FROM said.conv_id GROUP BY said.conv_id
)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v.c, 0) AS cost, coalesce(v.w, '') AS audit,
       coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def op13_reversed_search(spark: SparkSession, sf: str) -> DataFrame:
    return reversed_search(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"), k=10)


REVERSED_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents WHERE text IS NOT NULL
), wanted AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE text IS NOT NULL)
    GROUP BY ALL
), total AS (
    SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS l FROM docs WHERE len(w) > 0
), counts AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs)
    WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
    FROM counts, total GROUP BY term
), scored AS (
    SELECT w.item_id, r, sum(times * weight * ((1000000000 * tf)
               // (1000 * tf + 8 * (100 - 75 + ((75 * len(d.w) * n_docs) // l)))))::BIGINT AS score
    FROM wanted w JOIN counts c USING (term) JOIN weights USING (term) JOIN docs d USING (r), total
    GROUP BY w.item_id, r
)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score
FROM scored JOIN docs USING (r) WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER best <= 10
"""


QUERIES = {
    "op1_quotation_links": (op1_quotation_links, QUOTATION_SQL),
    "op2_toxicity": (op2_toxicity, None),
    "op3_exact_topk": (op3_exact_topk, EXACT_TOPK_SQL),
    "op4_language_id": (op4_language_id, None),
    "op5_minhash_near_dedup": (op5_minhash_near_dedup, NEAR_DEDUP_SQL),
    "op9_sentencepiece": (op9_sentencepiece, None),
    "op10_license_scan": (op10_license_scan, _license_sql()),
    "op6_quality_lm": (op6_quality_lm, None),
    "op7_best_fit_packing": (op7_best_fit_packing, None),
    "op8_exact_dedup": (op8_exact_dedup, EXACT_DEDUP_SQL),
    "op11_cap_filters": (op11_cap_filters, CAP_FILTERS_SQL),
    "op12_conversation_repair": (op12_conversation_repair, REPAIR_SQL),
    "op13_reversed_search": (op13_reversed_search, REVERSED_SQL),
}
