"""DuckDB SQL for the queries that SQL can express."""

LINE_DEDUP = r"""
WITH raw AS (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p,
           unnest(string_split(text, chr(10))) AS line
    FROM documents WHERE text IS NOT NULL
), filled AS (
    SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i
    FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), pairs AS (
    SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next_line FROM filled
), copies AS (
    SELECT doc_id, i FROM pairs WHERE next_line IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, i) > 1
), wordy AS (
    SELECT doc_id, i FROM filled WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50
    QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1
), dead AS (
    SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM copies UNION ALL SELECT doc_id, i + 1 FROM copies UNION ALL FROM wordy)
), runs AS (
    SELECT doc_id, min(i) AS a, max(i) AS b, count(*) AS n
    FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM dead)
    GROUP BY doc_id, g
), spans AS (
    SELECT r.doc_id, x.p AS p1, y.p AS p2
    FROM runs r JOIN filled x ON x.doc_id = r.doc_id AND x.i = r.a JOIN filled y ON y.doc_id = r.doc_id AND y.i = r.b
), kept AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text
    FROM raw WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = raw.doc_id AND raw.p BETWEEN s.p1 AND s.p2)
    GROUP BY doc_id
)
SELECT d.doc_id, coalesce(f.n, 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_deleted,
       coalesce(r.m, 0)::BIGINT AS longest_run,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.text, '')) END AS text_md5
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM filled GROUP BY doc_id) f USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(n) AS n, max(n) AS m FROM runs GROUP BY doc_id) r USING (doc_id)
LEFT JOIN kept k USING (doc_id)
"""

MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, text,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, 2 * source_size AS cap,
           [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight
    FROM sources
), levels AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY cap * 10 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
              / (sum(weight) OVER (ORDER BY cap * 10 // weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM weighed
), water AS (
    SELECT max(level) AS water FROM levels WHERE cap >= weight * level
), rates AS (
    SELECT source, source_size, least(cap::DOUBLE, weight * coalesce(water, 'inf'::DOUBLE)) AS target,
           ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
    FROM levels CROSS JOIN water
), placed AS (
    SELECT s.doc_id, s.size, r.source_size, r.target, r.shift,
           CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
           row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS LAST) AS place
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(place * rate + shift) - floor((place - 1) * rate + shift), ceil(rate)) * size)::BIGINT AS taken
FROM placed
"""

SUFFIX_DEDUP = r"""
WITH worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^ 	-
]+') AS w
    FROM documents
), windows AS (
    SELECT doc_id, unnest(range(0, len(w) - 49)) AS p,
           unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h
    FROM worded WHERE len(w) >= 50
), matched AS (
    SELECT doc_id, p, n > 1 AND r > 1 AS later
    FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM windows)
    WHERE n > 1
), ordered AS (
    SELECT *, max(p) OVER before + 50 AS far, max(CASE WHEN later THEN p END) OVER before + 50 AS far_later
    FROM matched WINDOW before AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
    SELECT *, sum(CASE WHEN far >= p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run,
           CASE WHEN later THEN least(50, coalesce(p + 50 - far_later, 50)) ELSE 0 END AS more
    FROM ordered
)
SELECT doc_id, min(p)::INTEGER AS start, (max(p) + 50)::INTEGER AS stop, sum(more)::BIGINT AS n_later
FROM marked GROUP BY doc_id, run
"""

NGRAM_JOIN = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^ 	-
]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM worded
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

TOPK = r"""
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

LINKS = r"""
WITH RECURSIVE split AS (
    SELECT page_id, html,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), ruled AS (
    SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                   WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                   WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                   WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                   WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
    FROM split
), judged AS (
    SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM ruled
), found AS (
    SELECT host AS src, unnest(regexp_extract_all(html,
        '(?i)<a[\x20\x09-\x0D](?:[^>]*?[\x20\x09-\x0D])?href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["'']?([^"''\x20\x09-\x0D>]+)', 1)) AS link
    FROM split WHERE host <> ''
), aimed AS (
    SELECT src, CASE WHEN regexp_matches(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//')
                         THEN translate(regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                     WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '' ELSE src END AS dst
    FROM found
), edges AS (
    SELECT src, dst, count(*) AS n FROM aimed WHERE dst <> '' GROUP BY src, dst
), ways AS (
    SELECT 'trust' AS kind, src AS a, dst AS b, n::DOUBLE / (sum(n) OVER (PARTITION BY src))::DOUBLE AS part FROM edges
    UNION ALL
    SELECT 'distrust', dst, src, n::DOUBLE / (sum(n) OVER (PARTITION BY dst))::DOUBLE FROM edges
), hosts AS (
    SELECT host, count(*) AS pages, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked
    FROM judged WHERE host <> '' GROUP BY host
), ranks AS (
    SELECT 0 AS round, 'trust' AS kind, host, (1073741824 * allowed // pages)::BIGINT AS seed, (1073741824 * allowed // pages)::BIGINT AS mass
    FROM hosts WHERE allowed > 0
    UNION ALL
    SELECT 0, 'distrust', host, (1073741824 * blocked // pages)::BIGINT, (1073741824 * blocked // pages)::BIGINT FROM hosts WHERE blocked > 0
), rounds AS (
    SELECT * FROM ranks
    UNION ALL
    SELECT round + 1, kind, host, sum(seed)::BIGINT, sum(mass)::BIGINT
    FROM (SELECT round, kind, host, seed, floor((1 - 0.85::DOUBLE) * seed::DOUBLE)::BIGINT AS mass FROM rounds WHERE round < 20
          UNION ALL
          SELECT r.round, w.kind, w.b, 0, floor(0.85::DOUBLE * r.mass::DOUBLE * w.part)::BIGINT
          FROM rounds r JOIN ways w ON w.kind = r.kind AND w.a = r.host WHERE r.round < 20)
    GROUP BY round, kind, host
), final AS (
    SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0)::BIGINT AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust
    FROM rounds WHERE round = 20 GROUP BY host
)
SELECT page_id, j.host, path, rule,
       coalesce(verdict, CASE WHEN distrust::DOUBLE > 0.5::DOUBLE * (trust::DOUBLE + distrust::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM judged j LEFT JOIN final USING (host)
"""


def _annulus(k: int = 40, rounds: int = 5) -> str:
    """Rounds of exact assignment and integer means; products are exact in doubles for vectors near the unit sphere."""
    near = """
near{r} AS MATERIALIZED (
    SELECT uid, c, d FROM (
        SELECT k.uid, m.c, k.s - 2 * list_inner_product(k.f, m.v::DOUBLE[])::BIGINT + list_inner_product(m.v::DOUBLE[], m.v::DOUBLE[])::BIGINT AS d
        FROM kept k CROSS JOIN means{r} m)
    QUALIFY row_number() OVER (PARTITION BY uid ORDER BY d, c) = 1
), """
    mean = """
means{n} AS MATERIALIZED (
    SELECT m.c, coalesce(g.v, m.v) AS v FROM means{r} m LEFT JOIN (
        SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS v
        FROM (SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
              FROM (SELECT a.c, unnest(k.v) AS x, unnest(range(64)) AS j FROM near{r} a JOIN kept k USING (uid)) GROUP BY c, j)
        GROUP BY c) g USING (c)
), """
    steps = "".join(near.format(r=r) + mean.format(r=r, n=r + 1) for r in range(rounds)) + near.format(r=rounds)
    return f"""
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), kept AS MATERIALIZED (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS uid, v, v::DOUBLE[] AS f, list_inner_product(v::DOUBLE[], v::DOUBLE[])::BIGINT AS s FROM whole
), means0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST) - 1 AS c, v FROM kept QUALIFY c < {k}
), {steps.strip()}
told AS (
    SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM means{rounds}
)
SELECT k.vec_id, n.c::INTEGER AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia,
       (sum(n.d) OVER ())::BIGINT AS inertia, t.centroid_sha256
FROM near{rounds} n JOIN kept k USING (uid) JOIN told t ON t.c = n.c
"""


HARD_NEGATIVES = r"""
WITH sound AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM sound a JOIN sound c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op5_ngram_join": NGRAM_JOIN,
    "op9_topk": TOPK,
    "op10_mixing": MIXING,
    "op11_links": LINKS,
    "op12_annulus": _annulus(),
    "op13_hard_negatives": HARD_NEGATIVES,
}
