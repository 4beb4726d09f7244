"""SQL of the queries that SQL can express."""

from __future__ import annotations

from textwarden.llm.secrets import BASE_RULES, RULES

# The given patterns as they are written, where the operator's own stand for the same spans.
AS_GIVEN = {"access": ("AKIA[A-Z0-9]+", 20), "hex": ("[0-9a-f]+", 24)}


def exact_dedup() -> str:
    return """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets() -> str:
    """Matches are wrapped in marks, the text is split at them, and the lengths of the parts add up to offsets."""
    begin, group, end = "chr(64976)", "chr(64978)", "chr(64977)"
    each = []
    for kind, rule in enumerate(RULES):
        regex, least = AS_GIVEN.get(rule.kind, (rule.regex, rule.at_least))
        each.append(
            f"SELECT id, {kind} AS kind, {least} AS least, unnest(parts) AS part, generate_subscripts(parts, 1) AS i "
            f"FROM (SELECT id, string_split(regexp_replace(text, {_quoted(regex)}, {begin} || '\\0' || {group} || "
            f"'\\{rule.value}' || {end}, 'g'), {begin}) AS parts FROM docs WHERE regexp_matches(text, {_quoted(regex)}))"
        )
    marked = f"split_part(part, {end}, 1)"
    width = f"length(split_part({marked}, {group}, 1))"
    names = ", ".join(f"({i}, '{r.kind}')" for i, r in enumerate(RULES))
    base = f"kind < {len(BASE_RULES)}"
    counts = "".join(
        f"count(*) FILTER (kind = {i}) AS n_{r.kind}, " for i, r in enumerate(BASE_RULES)
    )
    zeros = "".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}, " for r in BASE_RULES)
    written = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
        names(kind, name) AS (VALUES {names}),
        parts AS ({" UNION ALL ".join(each)}),
        widths AS (SELECT id, kind, least, i, {width} AS matched, length(split_part({marked}, {group}, 2)) AS value,
            CASE WHEN i = 1 THEN length(part) ELSE length(part) - length({marked}) - 1 + {width} END AS width FROM parts),
        placed AS (SELECT *, CAST(sum(width) OVER (PARTITION BY id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING) AS BIGINT) AS start FROM widths),
        spans AS (SELECT id, kind, name, start, start + matched AS stop FROM placed JOIN names USING (kind)
            WHERE i > 1 AND value >= least),
        found AS (SELECT id, {counts}{written} FILTER ({base}) AS base, {written} AS spans FROM spans GROUP BY id)
        SELECT doc_id, {zeros}sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN found USING (id)
    """


ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": exact_dedup(), "op5_secrets": secrets()}


def centroids(clusters: int = 40, rounds: int = 5, dims: int = 64, limit: int = 1 << 19) -> str:
    """k-means on quantised vectors, its rounds written out one after the other."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v
            FROM embeddings WHERE len(embedding) = {dims}
            AND list_bool_and(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x IS NOT NULL AND abs(x) < {limit})))""",
        """comp AS MATERIALIZED (SELECT rid, generate_subscripts(v, 1) AS d, CAST(floor(unnest(v) * 256) AS BIGINT) AS q
            FROM kept)""",
        f"""seeds AS MATERIALIZED (SELECT rid, row_number() OVER (ORDER BY key, qv, vec_id) - 1 AS c FROM (
            SELECT rid, vec_id, sha256('2:' || CAST(vec_id AS VARCHAR)) AS key,
                list_transform(v, lambda x: CAST(floor(x * 256) AS BIGINT)) AS qv FROM kept WHERE vec_id IS NOT NULL)
            ORDER BY key, qv, vec_id LIMIT {clusters})""",
        "c0 AS MATERIALIZED (SELECT s.c, p.d, p.q AS x FROM seeds s JOIN comp p USING (rid))",
    ]

    def assigned(r: int, before: str) -> None:
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, c, dd FROM (SELECT p.rid, m.c, sum((p.q - m.x) * (p.q - m.x)) AS dd
                FROM comp p JOIN {before} m USING (d) GROUP BY p.rid, m.c)
                QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dd, c) = 1)"""
        )

    for r in range(1, rounds + 1):
        assigned(r, f"c{r - 1}")
        total, n = "CAST(sum(p.q) AS HUGEINT)", "count(*)"
        steps.append(
            f"""c{r} AS MATERIALIZED (SELECT a.c, p.d, CAST(({total} - ((({total}) % {n}) + {n}) % {n}) // {n} AS BIGINT) AS x
                FROM a{r} a JOIN comp p USING (rid) GROUP BY a.c, p.d
                UNION ALL SELECT c, d, x FROM c{r - 1} WHERE c NOT IN (SELECT c FROM a{r}))"""
        )
    last = rounds + 1
    assigned(last, f"c{rounds}")
    return f"""
        WITH {", ".join(steps)},
        digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256
            FROM c{rounds} GROUP BY c)
        SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.dd AS BIGINT) AS distance,
            CAST(sum(a.dd) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.dd) OVER () AS BIGINT) AS inertia,
            h.centroid_sha256
        FROM a{last} a JOIN kept k USING (rid) JOIN digest h USING (c)
    """


ORACLE_SQL["op11_centroids"] = centroids()


def collocations(min_count: int = 100, longest: int = 5, top: int = 2000) -> str:
    """All phrases counted outright, the weakest cut of each candidate, containment by one word more."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS text
            FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
        w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
        n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, ws[i:i + m - 1] AS words
            FROM w, range(1, {longest} + 1) r(m), LATERAL (SELECT unnest(range(1, len(ws) - m + 2)) AS i)),
        f AS MATERIALIZED (SELECT lang, m, phrase, any_value(words) AS words, count(*) AS f FROM g GROUP BY lang, m, phrase),
        c AS (SELECT * FROM f WHERE m >= 2 AND f >= {min_count}),
        cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, fl.f AS l, fr.f AS r, n.n,
                CAST((CAST(1000 AS HUGEINT) * c.f * n.n) // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score
            FROM c, range(1, {longest}) q(k), f fl, f fr, n
            WHERE k < c.m AND fl.lang = c.lang AND fl.phrase = array_to_string(c.words[1:k], ' ')
              AND fr.lang = c.lang AND fr.phrase = array_to_string(c.words[k + 1:], ' ') AND n.lang = c.lang),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, array_to_string(words[2:], ' ') AS phrase, f AS outer_f FROM c
            UNION ALL SELECT lang, array_to_string(words[:m - 1], ' '), f FROM c),
        kept AS (SELECT * FROM best b WHERE NOT EXISTS
            (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND i.outer_f >= b.a))
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
            CAST(r AS BIGINT) AS r, n, score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        WHERE rank <= {top}
    """


ORACLE_SQL["op13_collocations"] = collocations()
