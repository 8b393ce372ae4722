"""One query per text operator, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import crc_fold, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.lines import repeated_lines

    found = repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped_lines"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.sharding import balanced_shards

    return balanced_shards(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.chat import perspectives

    return perspectives(table(spark, sf_dir, "conversations"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.quality import learn, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(crc_fold(F.col("doc_id"), 5) != 0))
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    model = learn(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.sanitise import private_spans

    return private_spans(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.vafile import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from navspark.llm.fptree import ranked_documents

    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_html_extraction": op8_html_extraction,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_personal_data": op11_personal_data,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_lexical_search": op13_lexical_search,
}

# Word lists as the operators take them: A-Z lower-cased, cut at blanks 0x20 and 0x09 to 0x0D.
_WORDS = r"""
words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda w: w <> '') AS w
    FROM documents
)"""

_JACCARD = f"""
WITH RECURSIVE {_WORDS},
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words
),
sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
    SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
),
reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN sized USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS least_id FROM reach GROUP BY x) USING (doc_id)
"""

_LEAKS = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
item_words AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark
),
runs AS (
    SELECT doc_id, len(w) AS n, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos,
        unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM words WHERE len(w) > 0
),
item_runs AS (
    SELECT item_id, length, s, count(*) AS d FROM (
        SELECT item_id, len(w) AS length, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM item_words WHERE len(w) > 0
    ) GROUP BY ALL
),
hits AS (SELECT doc_id, n, item_id, length, pos, s, d FROM runs JOIN item_runs USING (s)),
likely AS (
    SELECT doc_id, item_id, n, length, min(pos) AS lo, max(pos) AS hi FROM hits GROUP BY ALL
    HAVING count(*) >= 0.75 / 1.75 * (greatest(length - 4, 1) + greatest(least(length, n) - 4, 1)) - 1e-6
),
starts AS (
    SELECT doc_id, item_id, n, length, unnest(range(greatest(1, least(lo - length, n - length + 1)), greatest(1, least(hi, n - length + 1)) + 1)) AS start
    FROM likely
),
inside AS (
    SELECT doc_id, item_id, n, length, start, s, least(count(*), any_value(d)) AS c
    FROM starts JOIN hits USING (doc_id, item_id, n, length)
    WHERE pos >= start AND pos < start + greatest(least(length, n) - 4, 1) GROUP BY ALL
),
scored AS (
    SELECT doc_id, item_id, start, sum(c) / (any_value(greatest(length - 4, 1) + greatest(least(length, n) - 4, 1)) - sum(c)) AS similarity
    FROM inside GROUP BY doc_id, item_id, start
)
SELECT doc_id, item_id, CAST(max(similarity) AS DOUBLE) AS similarity FROM scored WHERE similarity >= 0.75 GROUP BY doc_id, item_id
"""

# Lines of 20 and more characters share one of three segments of the shorter line if two edits part them.
_LINES = r"""
WITH lines AS (
    SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
),
kinds AS (
    SELECT line, length(line) AS n, min((doc_id, line_no)) AS first FROM lines WHERE trim(line, ' ') <> '' GROUP BY line
),
cuts AS (
    SELECT line, n, i, i * (n // 3) + greatest(0, i - (3 - n % 3)) AS start, n // 3 + CASE WHEN i >= 3 - n % 3 THEN 1 ELSE 0 END AS size
    FROM kinds, range(3) r(i) WHERE n >= 20
),
keys AS (SELECT line, n, start, size, substring(line, start + 1, size) AS piece FROM cuts),
sizes AS (SELECT DISTINCT n, start, size FROM keys),
asks AS (
    SELECT k.line, s.n AS other, s.start, substring(k.line, s.start + shift + 1, s.size) AS piece
    FROM kinds k JOIN sizes s ON k.n >= 20 AND k.n BETWEEN s.n AND s.n + 2, range(-2, 3) t(shift) WHERE s.start + shift >= 0
),
pairs AS (
    SELECT DISTINCT k.line AS x, a.line AS y FROM keys k JOIN asks a ON k.n = a.other AND k.start = a.start AND k.piece = a.piece AND k.line <> a.line
),
links AS (SELECT x, y FROM pairs WHERE levenshtein(x, y) <= 2),
near AS (
    SELECT DISTINCT q.line FROM (SELECT x, y FROM links UNION SELECT y, x FROM links) l
    JOIN kinds p ON p.line = l.x JOIN kinds q ON q.line = l.y WHERE p.first < q.first
),
gone AS (
    SELECT l.doc_id, count(*) AS n_dropped, string_agg(l.line_no, ',' ORDER BY l.line_no) AS dropped_lines
    FROM lines l JOIN kinds k USING (line) LEFT JOIN near ON near.line = l.line
    WHERE near.line IS NOT NULL OR k.first < (l.doc_id, l.line_no) GROUP BY l.doc_id
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS n_lines,
    coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped_lines, '') AS dropped_lines
FROM documents LEFT JOIN gone USING (doc_id)
"""

_CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content
    FROM conversations WHERE conv_id IS NOT NULL
),
seats AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
seen AS (
    SELECT conv_id, perspective, turn, speaker, content,
        CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
    FROM turns JOIN seats USING (conv_id)
),
headed AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM seen),
shown AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS rendered FROM headed),
placed AS (
    SELECT *, row_number() OVER w - 1 AS position,
        CAST(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - length(rendered) AS start_char
    FROM shown WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content)
)
SELECT conv_id, perspective, position, turn, role, name, rendered, start_char,
    CASE WHEN role = 'assistant' THEN start_char + length(head) END AS mask_start,
    CASE WHEN role = 'assistant' THEN start_char + length(rendered) - 1 END AS mask_end
FROM placed
"""


# Base matches by the patterns of the contract; terms as the operator takes them, all of a term's texts having it beside the entity.
_PRIVATE = r"""
WITH texts AS MATERIALIZED (SELECT DISTINCT text AS body FROM documents WHERE text IS NOT NULL),
patterns(number, kind, pattern) AS (VALUES
    (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
    (3, 'card', '[0-9]([\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
cut AS (
    SELECT body, number, kind, p, m, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT body, number, kind, regexp_extract_all(body, pattern) AS m, regexp_split_to_array(body, pattern) AS p FROM texts, patterns
    ) WHERE len(m) > 0
),
placed AS (
    SELECT body, number, kind, m[i] AS value, p[i] AS before, p[i + 1] AS after,
        CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM cut
),
digits AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM placed),
good AS MATERIALIZED (
    SELECT body, number, kind, value, before, after, start, start + length(value) AS finish,
        kind || ':' || CASE kind WHEN 'email' THEN translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 'ip' THEN value ELSE d END AS entity
    FROM digits WHERE CASE kind
        WHEN 'ip' THEN list_max(list_transform(string_split(value, '.'), lambda x: CAST(x AS HUGEINT))) <= 255
        WHEN 'card' THEN length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j:
            CASE WHEN j % 2 = 1 THEN CAST(d[length(d) - j + 1] AS INTEGER) ELSE (2 * CAST(d[length(d) - j + 1] AS INTEGER)) // 10 + (2 * CAST(d[length(d) - j + 1] AS INTEGER)) % 10 END)) % 10 = 0
        WHEN 'phone' THEN length(d) BETWEEN 8 AND 15 ELSE true END
),
contexts AS (
    SELECT body, entity, translate(
        CASE WHEN length(before) > 200 THEN regexp_replace(before[-200:], '^[\p{L}\p{M}]+', '') ELSE before END || ' ' ||
        CASE WHEN length(after) > 200 THEN regexp_replace(after[1:200], '[\p{L}\p{M}]+$', '') ELSE after END,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS context FROM good
),
together AS MATERIALIZED (
    SELECT entity, term, count(*) AS n FROM (SELECT DISTINCT body, entity, unnest(regexp_extract_all(context, '[\p{L}\p{M}]{4,}')) AS term FROM contexts)
    GROUP BY entity, term HAVING count(*) >= 2
),
entities AS (SELECT entity, count(DISTINCT body) AS n FROM good GROUP BY entity),
lowered AS MATERIALIZED (SELECT body, translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM texts),
held AS MATERIALIZED (SELECT DISTINCT body, unnest(regexp_extract_all(low, '[\p{L}\p{M}]{4,}')) AS term FROM lowered),
given AS (
    SELECT DISTINCT term FROM together JOIN entities USING (entity) JOIN (SELECT term, count(*) AS n FROM held GROUP BY term) w USING (term)
    WHERE together.n = w.n AND entities.n < (SELECT count(*) FROM texts)
),
words AS (
    SELECT body, p, m, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT body, regexp_extract_all(low, '[\p{L}\p{M}]{4,}') AS m, regexp_split_to_array(low, '[\p{L}\p{M}]{4,}') AS p
        FROM lowered WHERE body IN (SELECT body FROM held WHERE term IN (SELECT term FROM given))
    )
),
terms AS (
    SELECT body, start, start + length(term) AS finish FROM (
        SELECT body, m[i] AS term,
            CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
        FROM words WHERE m[i] IN (SELECT term FROM given)
    )
),
every AS (
    SELECT body, number, kind, start, finish FROM good
    UNION ALL
    SELECT body, 5, 'term', start, finish FROM terms t
    WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.body = t.body AND g.start < t.finish AND g.finish > t.start)
),
lists AS (
    SELECT body, count(*) FILTER (number = 1) AS n_email, count(*) FILTER (number = 2) AS n_ip, count(*) FILTER (number = 3) AS n_card, count(*) FILTER (number = 4) AS n_phone,
        coalesce(string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY number, start) FILTER (number < 5), '') AS base,
        string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY number, start) AS spans
    FROM every GROUP BY body
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN lists ON body = text
"""

_SEARCH = r"""
WITH doc_terms AS (
    SELECT row_number() OVER () AS row_id, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM documents
),
counts AS MATERIALIZED (SELECT row_id, doc_id, t, count(*) AS tf FROM doc_terms GROUP BY ALL),
sizes AS MATERIALIZED (SELECT row_id, sum(tf) AS n FROM counts GROUP BY row_id),
totals AS MATERIALIZED (SELECT count(*) AS docs, sum(n) AS every FROM sizes),
wanted AS MATERIALIZED (
    SELECT item_id, t, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
        FROM benchmark
    ) GROUP BY ALL
),
weights AS MATERIALIZED (
    SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM (SELECT t, count(*) AS df FROM counts WHERE t IN (SELECT t FROM wanted) GROUP BY t), totals
),
lengths AS MATERIALIZED (SELECT row_id, CAST(75 + (25 * n * docs) // every AS BIGINT) AS m FROM sizes, totals),
scores AS (
    SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM wanted JOIN weights USING (t) JOIN counts USING (t) JOIN lengths USING (row_id) GROUP BY item_id, row_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 20
"""


def _clusters(rounds: int) -> str:
    """Assignment and replacement, written out once for each round."""
    steps = [r"""
whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
vectors AS MATERIALIZED (SELECT row_number() OVER () AS row_id, * FROM whole),
centroids0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v AS c FROM vectors
    WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), v LIMIT 40
)"""]
    for i in range(rounds + 1):
        steps.append(f"""
placed{i} AS MATERIALIZED (
    SELECT row_id, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, k)) AS best FROM (
        SELECT row_id, vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM vectors, centroids{i}
    ) GROUP BY row_id
)""")
        if i < rounds:
            steps.append(f"""
sums{i} AS (
    SELECT k, pos, sum(x) AS s, count(*) AS n FROM (
        SELECT best[2] AS k, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM placed{i}
    ) GROUP BY k, pos
),
moved{i} AS (SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM sums{i} GROUP BY k),
centroids{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM centroids{i} o LEFT JOIN moved{i} m USING (k))""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance,
    CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256
FROM placed{rounds} JOIN centroids{rounds} ON k = best[2]
"""


SQL: dict[str, str] = {
    "op1_line_dedup": _LINES,
    "op3_chat_formatting": _CHAT,
    "op5_decontamination": _LEAKS,
    "op7_jaccard_join": _JACCARD,
    "op11_personal_data": _PRIVATE,
    "op12_centroid_clustering": _clusters(5),
    "op13_lexical_search": _SEARCH,
}
