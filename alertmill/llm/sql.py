"""SQL forms of those operators that SQL can express, for an engine with lists and lambdas."""

WORD = r"[^\x20\x09-\x0D]+"


def quality_sql(table: str = "documents") -> str:
    from alertmill.llm.quality import MIN_DOCUMENTS, MIN_WORDS, RULES, SKETCH_BITS

    measures = ", ".join(f"{r.top} * 1000 // greatest({r.bottom}, 1) AS {r.name}" for r in RULES)
    names = ", ".join(r.name for r in RULES)
    levels = []
    for level, keys in enumerate(("lang, source, ", "lang, ", "")):
        by = f"{keys}measure"
        picks = ", ".join(f"min(CASE WHEN cum * 4 >= total * {k} THEN cell END) AS q{k}" for k in (1, 2, 3))
        levels.append(
            f"""l{level} AS (SELECT {by}, {picks}, max(total) AS total FROM (
            SELECT {by}, cell, sum(n) OVER (PARTITION BY {by}) AS total,
                sum(n) OVER (PARTITION BY {by} ORDER BY cell) AS cum
            FROM (SELECT {by}, cell, sum(n) AS n FROM cells GROUP BY {by}, cell)) GROUP BY {by})"""
        )
    spec = " UNION ALL ".join(
        f"SELECT '{r.name}' AS measure, {r.spread} AS spread, {r.reach} AS reach, {str(r.below).lower()} AS below" for r in RULES
    )
    chosen = ", ".join(
        f"CASE WHEN l0.total >= {MIN_DOCUMENTS} THEN l0.q{k} WHEN l1.total >= {MIN_DOCUMENTS} THEN l1.q{k} ELSE l2.q{k} END AS q{k}"
        for k in (1, 2, 3)
    )
    return rf"""WITH d AS (
        SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM {table}),
    w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
    t AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (
        SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t) WHERE n > 1),
    cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM hit, (VALUES (0), (1), (2)) AS o(j) GROUP BY rid),
    base AS (SELECT w.rid, doc_id, lang, source, len(ws) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
        FROM w LEFT JOIN cov USING (rid)),
    m AS (SELECT *, {measures} FROM base),
    long AS (SELECT lang, source, rid, measure, v FROM m UNPIVOT (v FOR measure IN ({names}))),
    cells AS (SELECT lang, source, measure, v - v % (1::BIGINT << greatest(length(bin(v)) - {SKETCH_BITS}, 0)) AS cell,
        count(*) AS n FROM long GROUP BY ALL),
    {", ".join(levels)},
    spec AS ({spec}),
    fence AS (SELECT lang, source, measure, q2 + greatest(q3 - q1, spread) * reach AS high,
        CASE WHEN below THEN q2 - greatest(q3 - q1, spread) * reach END AS low FROM (
        SELECT l0.lang, l0.source, l0.measure, spread, reach, below, {chosen}
        FROM l0 JOIN l1 ON l0.lang IS NOT DISTINCT FROM l1.lang AND l0.measure = l1.measure
        JOIN l2 ON l0.measure = l2.measure JOIN spec ON l0.measure = spec.measure)),
    verdict AS (SELECT rid, bool_and(v <= high AND (low IS NULL OR v >= low)) AS ok FROM long JOIN fence
        ON long.lang IS NOT DISTINCT FROM fence.lang AND long.source IS NOT DISTINCT FROM fence.source
        AND long.measure = fence.measure GROUP BY rid),
    judged AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        (NOT base_failed AND ok) AS kept FROM judged JOIN verdict USING (rid)"""


TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def contamination_sql() -> str:
    return rf"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '{TOKEN}') AS ws FROM benchmark),
    g AS (SELECT item, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i, ws FROM b WHERE len(ws) > 0),
    win AS (SELECT DISTINCT item, n, list_slice(ws, i, i + n - 1) AS gram FROM g),
    d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWERED}, '{TOKEN}') AS ws FROM documents),
    p AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win)),
    occ AS (SELECT rid, i, win.n, item FROM (SELECT rid, i, n, list_slice(ws, i, i + n - 1) AS gram FROM p) AS q
        JOIN win ON q.n = win.n AND q.gram = win.gram),
    hit AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM occ) GROUP BY rid),
    its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256,
        (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
    FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)"""


def mixing_sql() -> str:
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
        md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR))) AS token FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source IS NULL, source) AS r FROM d GROUP BY source),
    w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, r) AS k FROM w),
    c AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio,
        coalesce(sum(source_size * 2) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
        sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
        sum(source_size) OVER () AS total FROM o),
    l AS (SELECT CAST(3 * total - 2 * spent AS DOUBLE) / CAST(2 * open_weight AS DOUBLE) AS level FROM c
        WHERE ratio >= CAST(3 * total - 2 * spent AS DOUBLE) / CAST(2 * open_weight AS DOUBLE) ORDER BY k LIMIT 1),
    t AS (SELECT source, r, source_size, CASE WHEN 2 * source_size < weight * level THEN CAST(2 * source_size AS DOUBLE)
        ELSE weight * level END AS target FROM w, l),
    q AS (SELECT d.*, t.source_size, t.target, t.r,
        sum(size) OVER (PARTITION BY d.source ORDER BY token, doc_id, size, rid ROWS UNBOUNDED PRECEDING) AS cum
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    f AS (SELECT *, CAST(cum + e * source_size AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) AS v(e) WHERE size > 0),
    u AS (SELECT rid, sum(size) OVER (ORDER BY finish, r, token, doc_id, size, rid, e ROWS UNBOUNDED PRECEDING) AS run FROM f),
    n AS (SELECT rid, count(*) AS copies FROM u WHERE 2 * run <= 3 * (SELECT sum(size) FROM d) GROUP BY rid)
    SELECT doc_id, size, source_size, target, size * coalesce(copies, 0) AS taken FROM q LEFT JOIN n USING (rid)"""


def line_sql() -> str:
    from alertmill.llm.line_spread import SITES

    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT rid, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS place FROM d),
    b AS (SELECT line FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
    m AS (SELECT l.*, b.line IS NOT NULL AS bad FROM l LEFT JOIN b ON l.line = b.line)
    SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN (
        SELECT rid, count(*) FILTER (WHERE regexp_matches(line, '{WORD}')) AS n_lines, count(*) FILTER (WHERE bad) AS n_removed,
        string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT bad) AS kept FROM m GROUP BY rid) USING (rid)"""


def codes_sql() -> str:
    from alertmill.llm.ball_codes import ENTRIES, LIMIT, PARTS, ROUNDS, SCALE

    part = "p * w + 1"
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, len(embedding) // {PARTS} AS w,
        list_transform(embedding, lambda x: CAST(floor(greatest(least({SCALE} * CAST(x AS DOUBLE), {LIMIT}), -{LIMIT})) AS BIGINT)) AS q
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""v AS MATERIALIZED (SELECT rid, p, list_slice(q, {part}, p * w + w) AS x FROM k, range({PARTS}) AS t(p))""",
        f"""s AS (SELECT rid, row_number() OVER (ORDER BY vec_id, q) - 1 AS e FROM k ORDER BY vec_id, q LIMIT {ENTRIES})""",
        "c0 AS MATERIALIZED (SELECT p, e, x AS c FROM v JOIN s USING (rid))",
    ]
    for r in range(ROUNDS + 1):
        # the squared distance and the entry in one number, so that the least is the nearest and the lowest
        gap = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, p, x, min(CAST({gap} AS BIGINT) * {ENTRIES} + e) AS best FROM v JOIN c{r} USING (p) GROUP BY rid, p, x)")
        if r < ROUNDS:
            steps.append(
                f"""m{r} AS (SELECT p, e, list(y ORDER BY i) AS c FROM (SELECT p, e, i, (t - ((t % n) + n) % n) // n AS y FROM (
                SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS t, count(*) AS n FROM (
                SELECT p, best % {ENTRIES} AS e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY p, e, i)) GROUP BY p, e)"""
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m{r}.c, o.c) AS c FROM c{r} AS o LEFT JOIN m{r} ON o.p = m{r}.p AND o.e = m{r}.e)")
    last = f"a{ROUNDS}"
    return f"""WITH {", ".join(steps)},
    f AS (SELECT rid, string_agg(format('{{:02x}}', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
        FROM {last} GROUP BY rid),
    b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM k JOIN f USING (rid), b"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def search_sql() -> str:
    from alertmill.llm.ranked_search import TOP

    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWERED}, '{TERM}') AS ws FROM documents),
    size AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS total FROM d WHERE len(ws) > 0),
    t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) GROUP BY rid, term),
    b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOWERED}, '{TERM}') AS ws FROM benchmark),
    q AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(ws) AS term FROM b) GROUP BY item, term),
    df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM df, size),
    m AS (SELECT rid, doc_id, 75 + (25 * len(ws) * docs) // total AS m FROM d, size),
    s AS (SELECT item, doc_id, rid, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
        FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (rid) GROUP BY item, doc_id, rid),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, rid) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r JOIN b USING (item) WHERE rank <= {TOP}"""
