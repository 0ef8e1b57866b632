"""Embedding links, the manifest, the spelling variants and the URL filters in SQL, for comparison."""

from __future__ import annotations

#: crc32 byte by byte: ``t`` of ``crc`` holds the remainders of the 256 bytes.
CRC = """bits AS (SELECT i, 0 AS k, i AS c FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
        UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc32(codes: str) -> str:
    """Of a list of bytes."""
    return f"xor(list_reduce({codes}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def encoded(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"({encoded(c)})" for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
UP = "list_transform(range(0, len(l), 8), lambda i: sha256(array_to_string(l[i + 1 : i + 8], '')))"
SIDES = "array_to_string(l[r - r % 8 + 1 : r], '') AS a, array_to_string(l[r + 2 : r - r % 8 + 8], '') AS b"

MANIFEST = f"""
    WITH RECURSIVE {CRC},
    d AS (SELECT row_number() OVER () AS id, doc_id, lang, {leaf("text")} AS leaf,
        CASE WHEN text IS NOT NULL AND {crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")} % 3 = 0 THEN {leaf(LOWERED)} ELSE {leaf("text")} END AS start
        FROM documents, crc),
    n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
    lv AS (SELECT lang, 0 AS k, list(leaf ORDER BY r) AS l FROM n GROUP BY lang UNION ALL SELECT lang, k + 1, {UP} FROM lv WHERE len(l) > 1),
    sub AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM lv WHERE len(l) = 1),
    top AS (SELECT 0 AS k, list(subroot ORDER BY r) AS l FROM sub UNION ALL SELECT k + 1, {UP} FROM top WHERE len(l) > 1),
    spots AS (SELECT id, k, l, r // CAST(power(8, k) AS BIGINT) AS r FROM n JOIN lv ON n.lang IS NOT DISTINCT FROM lv.lang WHERE len(l) > 1
        UNION ALL SELECT id, 100 + k, l, sub.r // CAST(power(8, k) AS BIGINT) FROM n JOIN sub ON n.lang IS NOT DISTINCT FROM sub.lang, top WHERE len(l) > 1),
    way AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS k, {SIDES} FROM spots),
    fold AS (SELECT id, CAST(0 AS BIGINT) AS k, start AS digest FROM n UNION ALL SELECT f.id, w.k, sha256(w.a || f.digest || w.b) FROM fold f JOIN way w ON w.id = f.id AND w.k = f.k + 1),
    proofs AS (SELECT id, sha256(string_agg(a || b, '' ORDER BY k)) AS proof FROM way GROUP BY id),
    ends AS (SELECT id, arg_max(digest, k) AS digest FROM fold GROUP BY id),
    whole AS (SELECT l[1] AS root FROM top WHERE len(l) = 1)
    SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, digest AS folded_root, digest = root AS verified
    FROM n JOIN sub ON n.lang IS NOT DISTINCT FROM sub.lang JOIN ends USING (id) LEFT JOIN proofs USING (id), whole"""

CODES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END))"

SPELLING = f"""
    WITH RECURSIVE {CRC},
    runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    sums AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
    hashed AS (SELECT run, n, {crc32(CODES.format("id || ':' || run"))} AS h FROM sums, crc),
    spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
    cuts AS (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)),
    pairs AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT word, rest FROM cuts WHERE rest IN (SELECT word FROM v) UNION SELECT rest, word FROM cuts WHERE rest IN (SELECT word FROM v)),
    best AS (SELECT p.word, count(*) AS n_near, max(o.n) AS m FROM pairs p JOIN v o ON o.word = p.other GROUP BY p.word),
    forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN m END AS form_n,
        CASE WHEN m >= 2 * v.n THEN (SELECT min(o.word) FROM pairs p JOIN v o ON o.word = p.other WHERE p.word = v.word AND o.n = m) END AS form FROM v LEFT JOIN best USING (word)),
    ways AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT w.word, f.form, k + 1 FROM ways w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
    roots AS (SELECT word, arg_max(root, k) AS root FROM ways GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""

BARE = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|\\.$', '')"


def level(name: str, source: str, keys: str) -> str:
    """A level with its posterior: ``source`` has the keys, n, k and above."""
    return f"""{name}_w AS (SELECT floor(least(greatest(CASE WHEN s > 0 THEN (1 - s) / s ELSE 1000.0 END, 1.0), 1000.0) * 4096 + 0.5) / 4096 AS w FROM
        (SELECT CASE WHEN count(*) > 0 AND sum(n) > count(*) AND sum((n - 1) * above * (1 - above)) > 0
            THEN (sum(n * (k / n - above) * (k / n - above)) - sum(above * (1 - above))) / sum((n - 1) * above * (1 - above)) END AS s FROM {source})),
    {name} AS (SELECT {keys}, n, k, k + w * above AS a, n - k + w * (1 - above) AS b, (k + w * above) / ((k + w * above) + (n - k + w * (1 - above))) AS mean FROM {source}, {name}_w)"""


URLS = f"""
    WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    rules(verdict, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    fit AS (SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(verdict, length(h || s)) AS said FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id),
    r AS (SELECT q.*, rule, said FROM q LEFT JOIN fit USING (page_id)),
    l AS (SELECT host, {BARE} AS bare, string_split({BARE}, '.') AS ls FROM (SELECT DISTINCT host FROM r)),
    x AS (SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]*$|^\\[') THEN '' WHEN length(ls[-1]) = 2 AND len(ls) > 2 AND ls[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN ls[-2] || '.' || ls[-1] ELSE ls[-1] END AS suffix FROM l),
    names AS (SELECT host, suffix, CASE WHEN suffix = '' THEN bare ELSE array_to_string(ls[greatest(len(ls) - len(string_split(suffix, '.')), 1):], '.') END AS domain FROM x),
    judged AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (said = 'allow') AS DOUBLE) AS k FROM r WHERE said IS NOT NULL GROUP BY host),
    hosts AS (SELECT * FROM judged JOIN names USING (host)),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
    whole AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS above FROM suffixes),
    s0 AS (SELECT suffix, n, k, above FROM suffixes, whole), {level("s1", "s0", "suffix")},
    d0 AS (SELECT domain, d.n, d.k, mean AS above FROM domains d JOIN s1 USING (suffix)), {level("d1", "d0", "domain")},
    h0 AS (SELECT host, h.n, h.k, mean AS above FROM hosts h JOIN d1 USING (domain)), {level("h1", "h0", "host")},
    bad AS (SELECT host FROM (SELECT host, coalesce(h1.a, d1.a, s1.a) AS a, coalesce(h1.b, d1.b, s1.b) AS b FROM names LEFT JOIN h1 USING (host) LEFT JOIN d1 USING (domain) LEFT JOIN s1 USING (suffix))
        WHERE 1 / (1 + exp(-(ln(a / b) + 1.645 * sqrt(1 / a + 1 / b)))) < 0.5)
    SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN bad ON bad.host = r.host"""

#: All pairs, and what they reach.
EMBEDDINGS = """
    WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
    r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.c),
    m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id"""
