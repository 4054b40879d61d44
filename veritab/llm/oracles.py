"""SQL of the operators that SQL can express, for engines that know the given tables."""

from __future__ import annotations

_KEPT = (
    "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE))"
    " AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),"
    " parts AS MATERIALIZED (SELECT r, vec_id, label, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS x FROM kept, range(4) t(p)),"
    " firsts AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 256),"
    " b0 AS MATERIALIZED (SELECT p, e, x, list_inner_product(x, x) AS n FROM parts JOIN firsts USING (r))")


def _assigned(k: int) -> str:
    """Nearest entry of each part in round k: least distance, then least index."""
    distance = "CAST(list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, b.x) + b.n AS BIGINT)"
    return (f"a{k} AS MATERIALIZED (SELECT a.r, a.p, min({{'d': {distance}, 'e': b.e}}) AS near FROM parts a JOIN b{k} b ON a.p = b.p GROUP BY a.r, a.p)")


def _means(k: int) -> str:
    return (
        f"s{k} AS (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (SELECT a.p, near.e AS e, unnest(range(len(x))) AS i, CAST(unnest(x) AS BIGINT) AS c FROM"
        f" a{k - 1} a JOIN parts USING (r, p)) GROUP BY 1, 2, 3), m{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) / n AS DOUBLE) ORDER BY i) AS x FROM s{k}"
        f" GROUP BY 1, 2), b{k} AS MATERIALIZED (SELECT p, e, x, list_inner_product(x, x) AS n FROM (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k - 1} b"
        f" LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e))")


def vector_codes(rounds: int = 4) -> str:
    steps = ", ".join(f"{_assigned(k)}, {_means(k + 1)}" for k in range(rounds))
    return (
        f"WITH {_KEPT}, {steps}, {_assigned(rounds)}, coded AS (SELECT r, string_agg(printf('%02x', near.e), '' ORDER BY p) AS code, sum(near.d) AS error"
        f" FROM a{rounds} GROUP BY r), books AS (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)),"
        f" 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})"
        " SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256"
        " FROM kept JOIN coded USING (r) CROSS JOIN books")


# The CRC-32 of an ASCII text, bit by bit.
_CRC = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: "
        "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")


def conversation_repair() -> str:
    """The same search with whole audits and texts as state: <cost, audit, text> per state, least struct first."""
    blank = r"'^[\x20\x09-\x0D]*$'"

    def more(state: str, cost: str, edit: str, text: str) -> str:
        return (f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', "
                f"'t': {state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {text}}} END")

    def drop(state: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 2, 'a': {state}.a || 'D', 't': {state}.t}} END"

    def least(*offers: str) -> str:
        return f"list_min(list_filter([{', '.join(offers)}], lambda o: o IS NOT NULL))"

    user, reply = "'user:'", "'assistant:'"
    inserted2 = least("s2", *[more(s, "5", "I", user) for s in ("s0", "s1", "s3")])
    inserted3 = least("s3", more("s2", "5", "I", reply))

    def kept(state, initial):
        return f"CASE WHEN NOT bad AND i = '{initial}' THEN {more(state, 'cut', 'K', 'own')} END"

    def given(state, role):
        return f"CASE WHEN NOT bad THEN {more(state, 'cut + 1', 'R', f"'{role}:' || text")} END"

    new = {
        "s0": [drop("s0")],
        "s1": [drop("s1"), kept("s0", "s")],
        "s2": [drop("s2")] + [f(s, x) for s in ("s0", "s1", "s3") for f, x in ((kept, "u"), (given, "user"))],
        "s3": [drop("s3"), kept("s2", "a"), given("s2", "assistant")]}
    return (
        "WITH RECURSIVE hit AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, k, "
        f"{_CRC} % 20 AS h FROM (SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations)),"
        " harmed AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN"
        " regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE h <> 0),"
        " placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n,"
        " row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM harmed),"
        f" faulty AS MATERIALIZED (SELECT conv_id, n, turn, text, left(role, 1) AS i, concat(role, ':', text) AS own, regexp_matches(text, {blank}) AS blank,"
        f" NOT regexp_matches(text, {blank}) AND again AS twice, NOT regexp_matches(text, {blank}) AND NOT again AND NOT"
        r" regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS short, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS pair"
        " FROM placed), turns AS MATERIALIZED (SELECT conv_id, n, text, i, own, blank OR twice AS bad, CASE WHEN short THEN 5 ELSE 0 END AS cut FROM faulty),"
        " walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS s0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s1,"
        " CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s2, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s3"
        " FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, n, "
        + ", ".join(f"{least(*offers)} AS {s}" for s, offers in new.items()) +
        " FROM (SELECT conv_id, n, text, i, own, bad, cut, s0, s1, s2, " + inserted3 + " AS s3 FROM (SELECT w.conv_id, r.n, text, i, own, bad, cut, s0, s1, "
        + inserted2 + " AS s2, s3 FROM walk w JOIN turns r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1))),"
        " ends AS (SELECT conv_id, n, s0, " + inserted2 + " AS s2, s3 FROM walk),"
        " best AS (SELECT conv_id, " + least("s0", "s3", more("s2", "5", "I", reply)) + " AS b FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),"
        " counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(twice) AS duplicate,"
        " count_if(short) AS truncated, count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)"
        " SELECT best.conv_id, " + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal")) +
        ", CAST(b.c AS BIGINT) AS cost, b.a AS audit, sha256(b.t) AS repaired_sha256 FROM best LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM best.conv_id")


ORACLES = {"op11_vector_code_compression": vector_codes(), "op12_conversation_repair": conversation_repair()}
