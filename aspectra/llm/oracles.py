"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from aspectra.llm.mixing import ROUNDS, SEED
from aspectra.llm.queries import MIX_KEEP, MIX_TARGETS, TOPICS, URL_RULES
from aspectra.llm.url_rules import LOWER, MIN_CONFIDENCE, MIN_SUPPORT, UPPER

# SQL lists all combinations of a url's frequent tokens; the urls of the tables it is run on have no more of them. The operator has no such bound.
BASKET = 12

WHITE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

OP9 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, i, line, translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d)
), c AS (
  SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id < c.last_doc, false) AS gone FROM l LEFT JOIN c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE list_dot_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9
), r(vec_id, reached) AS (
  SELECT a, b FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a
), c AS (SELECT vec_id, min(reached) AS smallest FROM r GROUP BY 1), g AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT x.vec_id, coalesce(n_links, 0) AS n_links, least(x.vec_id, coalesce(c.smallest, x.vec_id)) AS component_id,
       x.vec_id = least(x.vec_id, coalesce(c.smallest, x.vec_id)) AS kept
FROM embeddings x LEFT JOIN c USING (vec_id) LEFT JOIN g USING (vec_id)
"""


# Bytes of a decimal id, one after another, through the bitwise CRC of the reflected polynomial.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""


def _written(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"({_written(x)})" for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _step(place: str) -> str:
    """The entry of a node's path at a level whose nodes are ``nodes``."""
    at = f"({place} >> lvl)"
    return f"CASE WHEN {at} % 2 = 1 THEN 'L' || nodes[{at}] WHEN {at} + 2 <= len(nodes) THEN 'R' || nodes[{at} + 2] ELSE 'N' END"


_UP = "list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))"

OP11 = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS changed, coalesce({CRC} % 7 = 0, false) AS tampered FROM documents
), d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l
), g(lang, lvl, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY place) FROM d GROUP BY lang
  UNION ALL SELECT lang, lvl + 1, {_UP} FROM g WHERE len(nodes) > 1
), s AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM g WHERE len(nodes) = 1
), t(lvl, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM s
  UNION ALL SELECT lvl + 1, {_UP} FROM t WHERE len(nodes) > 1
), below AS (
  SELECT d.doc_id, d.lang, d.place, list({_step("d.place")} ORDER BY lvl) FILTER (len(nodes) > 1) AS path
  FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang GROUP BY ALL
), above AS (
  SELECT s.lang, s.subroot, list({_step("s.place")} ORDER BY lvl) FILTER (len(nodes) > 1) AS path FROM s, t GROUP BY ALL
), p AS (
  SELECT d.doc_id, leaf, subroot, (SELECT nodes[1] FROM t WHERE len(nodes) = 1) AS root,
         list_concat(coalesce(b.path, []), coalesce(a.path, [])) AS path, CASE WHEN tampered THEN coalesce(changed, leaf) ELSE leaf END AS claimed
  FROM d JOIN below b ON d.lang IS NOT DISTINCT FROM b.lang AND d.place = b.place JOIN above a ON d.lang IS NOT DISTINCT FROM a.lang
), f AS (
  SELECT *, list_reduce(list_prepend(claimed, path), lambda x, e: sha256(CASE WHEN e[1] = 'L' THEN e[2:] || x ELSE x || e[2:] END)) AS folded_root FROM p
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda e: e[2:]), '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM f
"""


def _words(prefix: str, text: str) -> str:
    return f"list_transform(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[\\p{{L}}\\p{{N}}]+'), lambda w: '{prefix}' || w)"


def op12() -> str:
    fits = []
    for rule in sorted(URL_RULES, key=len, reverse=True):
        host, slash, path = rule.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{rule}'")
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in URL_RULES.items())
    words = ", ".join(_words(k, c) for k, c in (("s:", "scheme"), ("h:", "host"), ("p:", "path"), ("q:", "rest")))
    return f"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS row, coalesce(strpos(url, '://'), 0) AS sep, url FROM pages
), h AS (
  SELECT page_id, row, CASE WHEN sep > 0 THEN substr(url, 1, sep - 1) ELSE '' END AS scheme,
         CASE WHEN sep > 0 THEN translate(regexp_extract(substr(url, sep + 3), '^[^/?#]*', 0), '{UPPER}', '{LOWER}') ELSE '' END AS host,
         CASE WHEN sep > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*([^?#]*)([\\s\\S]*)', 1) ELSE '' END AS path,
         CASE WHEN sep > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*([^?#]*)([\\s\\S]*)', 2) ELSE '' END AS rest
  FROM u
), p AS MATERIALIZED (
  SELECT *, CASE rule {verdicts} END AS verdict FROM (
    SELECT *, CASE {" ".join(fits)} END AS rule, list_distinct(flatten([{words}])) AS tokens FROM h)
), n AS (
  SELECT count(*) AS n, count(*) FILTER (verdict = 'block') AS blocked FROM p WHERE rule IS NOT NULL
), x AS (
  SELECT row, verdict, unnest(tokens) AS token FROM p WHERE rule IS NOT NULL
), f AS (
  SELECT token, count(*) AS seen, abs(CAST(count(*) FILTER (verdict = 'block') AS HUGEINT) * (SELECT n FROM n) - CAST(count(*) AS HUGEINT) * (SELECT blocked FROM n)) AS told
  FROM x GROUP BY token HAVING count(*) >= {MIN_SUPPORT} * (SELECT n FROM n)
), b AS MATERIALIZED (
  SELECT row, verdict, list(token ORDER BY told DESC, seen DESC, token)[1:{BASKET}] AS items FROM x JOIN f USING (token) GROUP BY ALL
), c AS MATERIALIZED (
  SELECT needs, verdict, count(*) AS hits FROM (
    SELECT verdict, list_sort(list_filter(items, lambda t, i: (mask >> (i - 1)) & 1 = 1)) AS needs
    FROM (SELECT *, unnest(range(1, 1 << len(items))) AS mask FROM b))
  GROUP BY ALL
), r AS MATERIALIZED (
  SELECT needs, verdict, hits, hits / sum(hits) OVER (PARTITION BY needs) AS confidence FROM c
  QUALIFY hits >= ceil({MIN_SUPPORT} * (SELECT count(*) FROM b)) AND confidence >= {MIN_CONFIDENCE}
), m AS (
  SELECT p.row, r.verdict FROM p JOIN r ON list_has_all(p.tokens, r.needs) WHERE p.rule IS NULL
  QUALIFY row_number() OVER (PARTITION BY p.row ORDER BY confidence DESC, hits DESC, r.verdict = 'block' DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(p.verdict, m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (row)"""


def _count(markers) -> str:
    return "(" + " + ".join(f"(length(whole) - length(replace(whole, '{m}', ''))) / {len(m)}" for m in markers) + ")"


FILL_STEPS = 16  # more than the values of lang and topic, and than the given sources need


def op5() -> str:
    counts = {name: _count(markers) for name, markers in TOPICS.items()}
    most = "greatest(" + ", ".join(counts.values()) + ")"
    topic = "CASE " + " ".join(f"WHEN {n} > 0 AND {n} = {most} THEN '{name}'" for name, n in counts.items()) + " ELSE 'general' END"
    steps = [
        f"""base AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, {topic} AS topic,
         CAST(greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS DOUBLE) AS tokens,
         ('0x' || substr(md5('mix|{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '(null)')), 1, 8))::BIGINT / 4294967296.0 AS draw
  FROM (SELECT *, coalesce(text, '') AS whole FROM documents))""",
        f"""cells AS MATERIALIZED (SELECT *, tokens / ({MIX_KEEP} * sum(tokens) OVER ()) AS most, tokens / sum(tokens) OVER () AS weight
  FROM (SELECT source, lang, topic, sum(tokens) AS tokens FROM base GROUP BY ALL))""",
    ]
    for col, wanted in MIX_TARGETS.items():
        if wanted:
            share = f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in wanted.items()) + f" ELSE {sum(wanted.values()) / len(wanted)} END"
        else:
            share = "pow(sum(tokens), 0.5)"
        steps.append(f"share_{col} AS MATERIALIZED (SELECT {col}, {share} AS share, sum(most) AS most FROM cells GROUP BY {col})")
        # The scale at which the targets sum to 1 with each held at its bound; a value at its bound stays there.
        steps.append(f"{col}_0 AS MATERIALIZED (SELECT 1.0 / sum(share) AS scale FROM share_{col})")
        for k in range(FILL_STEPS):
            held = "share * scale >= most"
            steps.append(
                f"{col}_{k + 1} AS MATERIALIZED (SELECT coalesce(greatest(0.0, 1.0 - coalesce(sum(most) FILTER ({held}), 0.0)) / nullif(sum(share) FILTER (NOT ({held})), 0.0), any_value(scale)) AS scale FROM share_{col}, {col}_{k})"
            )
        steps.append(f"goal_{col} AS MATERIALIZED (SELECT {col}, least(most, share * scale) AS target FROM share_{col}, {col}_{FILL_STEPS})")
    steps.append("w0 AS MATERIALIZED (SELECT * FROM cells)")
    k = 0
    for _ in range(ROUNDS):
        for col in MIX_TARGETS:
            scaled = f"weight * (target / sum(weight) OVER (PARTITION BY w.{col}))"
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT w.* REPLACE (least(most, {scaled}) AS weight) FROM w{k} w JOIN goal_{col} g ON w.{col} = g.{col})")
            k += 1
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT b.doc_id, b.source, b.lang, b.topic, CAST(b.tokens AS BIGINT) AS n_tokens, round(c.weight, 6) AS weight,
       round(c.weight / c.most, 6) AS probability, CAST(b.draw < c.weight / c.most AS BIGINT) AS kept
FROM base b JOIN w{k} c ON b.source = c.source AND b.lang = c.lang AND b.topic = c.topic"""
    )


def oracles() -> dict[str, str]:
    return {"op2_warc": OP2, "op5_mixing": op5(), "op7_embedding_dedup": OP7, "op9_line_dedup": OP9, "op10_topk": OP10, "op11_merkle": OP11, "op12_url_rules": op12()}
