"""The training-data queries over the supplied tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import (
    bpe, dialogue_repair, hnsw, lexical, licenses, line_dedup, mixing, ngram_join, packing, pii, quality, url_filter,
    weak_labels,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def _op2_sql() -> str:
    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return (
            f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}'))"
        )

    by_length = sorted(URL_RULES, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0])))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in by_length)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in by_length)

    def hits(terms: dict[str, int]) -> str:
        found = [f"{w} * CAST(regexp_matches(lowered, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t, w in terms.items()]
        return " + ".join(found)

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH parts AS (SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    found AS (SELECT *, CASE {rule} END AS rule, translate(host || path, '{upper}', '{lower}') AS lowered FROM parts),
    counted AS (SELECT *, {hits(dict.fromkeys(url_filter.STRICT_TERMS, 1))} AS strict_hits,
        {hits(dict.fromkeys(url_filter.SOFT_TERMS, 1))} AS soft_hits,
        {hits(url_filter.SOFT_TERMS)} AS soft_weight FROM found)
    SELECT page_id, host, path, rule, CASE {verdict}
        WHEN strict_hits >= 1 OR (soft_hits > 1 AND soft_weight >= {url_filter.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END AS verdict,
        strict_hits, soft_hits, soft_weight FROM counted"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(_table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def _op3_sql() -> str:
    """The same figures by list functions; one language's reference is one row of sums."""
    space = r"[\x20\x09-\x0D]+"
    classes = [
        "[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:''\"()-]", "[#*$%&|<>]",
        None, r"[^\x00-\x7F]",
    ]
    count = [f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))" if c else "0" for c in classes]
    words = "[" + ", ".join(f"'{w}'" for w in quality.WORDS) + "]"
    n = len(quality.WORDS)
    languages = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)

    def distance(column: str) -> str:
        p, q = f"(p.{column}[i] / greatest(list_sum(p.{column}), 1))", f"(r.{column}[i] / list_sum(r.{column}))"
        size = len(classes) if column == "chars" else n + 1
        half = (
            f"list_sum(list_transform(range(1, {size + 1}), lambda i: "
            f"CASE WHEN {{0}} > 0 THEN {{0}} * log2({{0}} / (({p} + {q}) / 2)) ELSE 0 END))"
        )
        gap = f"sqrt(least(greatest(({half.format(p)} + {half.format(q)}) / 2, 0), 1))"
        return f"CASE WHEN list_sum(p.{column}) > 0 THEN {gap} ELSE 1 END"

    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS text FROM documents),
    cut AS (SELECT *, list_filter(regexp_split_to_array(text, '{space}'), lambda w: w <> '') AS words FROM docs),
    placed AS (SELECT row_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM cut),
    common AS (SELECT row_id, list_position({words}, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz')) AS slot, count(*) AS n FROM placed GROUP BY ALL),
    histogram AS (SELECT row_id, list_transform(range(1, {n + 1}), lambda i: coalesce(
        map_extract(map_from_entries(list((slot, n)) FILTER (slot IS NOT NULL)), i)[1], 0)) AS known,
        sum(n) AS total FROM common GROUP BY row_id),
    windows AS (SELECT row_id, pos, string_agg(word, ' ') OVER w AS gram, count(*) OVER w AS size FROM placed
        WINDOW w AS (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
    twice AS (SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, gram) > 1 AS again FROM windows WHERE size = 8),
    repeats AS (SELECT row_id, count(*) AS n FROM (
        SELECT DISTINCT row_id, unnest(range(pos, pos + 8)) AS place FROM twice WHERE again) GROUP BY row_id),
    lines AS (SELECT row_id, sum(n - 1) AS n FROM (SELECT row_id, line, count(*) AS n FROM (
        SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM docs)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY row_id),
    counted AS (SELECT c.row_id, doc_id, lang, len(c.words) AS n_words, list_sum(list_concat([0], list_transform(c.words, lambda w:
        length(w)))) AS word_chars, {count[5]} AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words, length(text) AS n_chars, [{', '.join(count)}] AS classes,
        coalesce(h.known, list_transform(range({n}), lambda i: 0)) AS known
        FROM cut c LEFT JOIN lines l USING (row_id) LEFT JOIN repeats r USING (row_id)
        LEFT JOIN histogram h USING (row_id)),
    p AS (SELECT *, list_transform(classes, lambda x, i: CASE WHEN i = 7 THEN n_chars - list_sum(classes)
        ELSE x END) AS chars, list_append(known, n_words - list_sum(known)) AS words FROM counted),
    r AS (SELECT lang, list(v ORDER BY i) FILTER (kind = 'chars') AS chars,
        list(v ORDER BY i) FILTER (kind = 'words') AS words FROM (
        SELECT lang, kind, i, sum(v) AS v FROM (
            SELECT lang, 'chars' AS kind, unnest(range({len(classes)})) AS i, unnest(chars) AS v FROM p UNION ALL
            SELECT lang, 'words', unnest(range({n + 1})), unnest(words) FROM p)
        WHERE lang IN ({languages}) GROUP BY ALL) GROUP BY lang),
    judged AS (SELECT p.row_id, min(CASE WHEN list_sum(r.chars) > 0 THEN {distance('chars')} END) AS char_distance,
        min(CASE WHEN list_sum(r.words) > 0 THEN {distance('words')} END) AS word_distance
        FROM p CROSS JOIN r GROUP BY p.row_id)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
        CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
        CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
        AND (coalesce(lang NOT IN (SELECT lang FROM r), false)
            OR NOT (n_chars >= {quality.MIN_CHARS} AND coalesce(char_distance, 0) > {quality.MAX_CHAR_DISTANCE})
            AND NOT (n_words >= {quality.MIN_WORDS} AND coalesce(word_distance, 0) > {quality.MAX_WORD_DISTANCE})) AS kept
    FROM p LEFT JOIN judged USING (row_id)"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weak_labels.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return hnsw.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents"), report=True).withColumnRenamed("id", "doc_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.groups(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return encoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _op10_sql() -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    def normalised(column: str) -> str:
        out = f"regexp_replace(lower({column}), {lit(licenses.COPYRIGHT_LINE)}, '', 'g')"
        for a, b in licenses.SPELLINGS:
            out = f"replace({out}, {lit(a)}, {lit(b)})"
        return f"regexp_replace({out}, {lit(licenses.OTHER_THAN_WORDS)}, ' ', 'g')"

    def as_one(column: str) -> str:
        return f"trim(regexp_replace({column}, '[ \\n]+', ' ', 'g'))"

    known = ", ".join(f"({lit(i)}, {lit(body)})" for i, body in licenses.KNOWN)
    return f"""
    WITH known AS (SELECT sha256({as_one(normalised('body'))}) AS digest, min(license_id) AS license_id
        FROM (VALUES {known}) t(license_id, body) GROUP BY 1),
    docs AS (SELECT row_number() OVER () AS row_id, doc_id, {normalised("coalesce(text, '')")} AS body FROM documents),
    units AS (SELECT row_id, 0 AS unit, {as_one('body')} AS part FROM docs UNION ALL
        SELECT row_id, unnest(range(1, len(string_split(body, chr(10))) + 1)),
            trim(unnest(string_split(body, chr(10)))) FROM docs),
    found AS (SELECT row_id, min(license_id) FILTER (unit = 0) AS license_id, count(*) FILTER (unit > 0) AS n,
        string_agg(license_id, ',' ORDER BY unit) FILTER (unit > 0) AS listed
        FROM units JOIN known ON sha256(part) = digest WHERE part <> '' GROUP BY row_id)
    SELECT doc_id, license_id, coalesce(n, 0) AS n_license_lines, listed AS line_licenses
    FROM docs LEFT JOIN found USING (row_id)"""


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = mixing.shares(_table(spark, sf_dir, "documents"))
    return told.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _op11_sql() -> str:
    """The stops by the order of size to weight; the threshold by a running sum over sorted hashes."""
    weights = ", ".join(str(w) for w in mixing.WEIGHTS)
    return f"""
    WITH docs AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS hash,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
    sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s,
        [{weights}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS w
        FROM docs GROUP BY source),
    placed AS (SELECT *, row_number() OVER o AS place, sum(w) OVER () - sum(w) OVER o AS rest_w,
        sum(s) OVER () - {mixing.MOST} * sum(s) OVER o AS rest_s, sum(w) OVER () AS all_w, sum(s) OVER () AS all_s
        FROM sources WINDOW o AS (ORDER BY CAST(s AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    steps AS (SELECT place, rest_w, rest_s FROM placed UNION ALL SELECT 0, max(all_w), max(all_s) FROM placed),
    stop AS (SELECT min(p.place) - 1 AS place FROM placed p JOIN steps t ON t.place = p.place - 1
        WHERE {mixing.MOST} * p.s * t.rest_w >= t.rest_s * p.w),
    goals AS (SELECT source, s, CASE WHEN p.place <= stop.place THEN CAST({mixing.MOST} * s AS DOUBLE)
        ELSE CAST(t.rest_s AS DOUBLE) * w / CAST(t.rest_w AS DOUBLE) END AS target
        FROM placed p CROSS JOIN stop JOIN steps t ON t.place = stop.place),
    times AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), {mixing.MOST}) ELSE 0 END AS times FROM goals),
    rests AS (SELECT *, CASE WHEN times < {mixing.MOST} THEN greatest(target - times * s, 0) ELSE 0 END AS rest FROM times),
    summed AS (SELECT doc_id, size, source, sum(size) OVER (PARTITION BY source ORDER BY left(hash, 15)) AS through,
        sum(size) OVER (PARTITION BY source, left(hash, 15)) AS alike FROM docs)
    SELECT doc_id, CAST(size AS BIGINT) AS size, r.s AS source_size, target, CAST(size * (times
        + CASE WHEN 2 * (rest - (through - alike)) > alike THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM summed d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source"""


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def _op12_sql() -> str:
    def terms(column: str) -> str:
        lowered = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        pattern = r"[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"
        return f"regexp_extract_all({lowered}, '{pattern}')"

    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, {terms('text')} AS terms FROM documents),
    sizes AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs),
    counts AS (SELECT row_id, doc_id, len(terms) AS n, term, count(*) AS tf
        FROM (SELECT row_id, doc_id, terms, unnest(terms) AS term FROM docs) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM counts CROSS JOIN sizes GROUP BY term, n_docs),
    items AS (SELECT DISTINCT item_id, text, unnest(list_distinct({terms('text')})) AS term FROM benchmark),
    scored AS (SELECT item_id, text, row_id, doc_id, CAST(sum(w * ((1000000000 * tf)
        // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM items JOIN counts USING (term) JOIN weights USING (term) CROSS JOIN sizes GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS rank
        FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {lexical.K}"""


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_repair.check(_table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


QUERIES: dict[str, Query] = {
    "op1_pack": op1_pack,
    "op2_url_filter": op2_url_filter,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_neighbours": op5_neighbours,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii": op7_pii,
    "op8_ngram_join": op8_ngram_join,
    "op9_bpe": op9_bpe,
    "op10_licenses": op10_licenses,
    "op11_mix": op11_mix,
    "op12_lexical": op12_lexical,
    "op13_repair": op13_repair,
}
ORACLES: dict[str, str] = {
    "op2_url_filter": _op2_sql(),
    "op3_quality": _op3_sql(),
    "op10_licenses": _op10_sql(),
    "op11_mix": _op11_sql(),
    "op12_lexical": _op12_sql(),
}
