"""SQL building blocks for the checks: the same results, said independently in DuckDB's dialect."""

from __future__ import annotations

import math

from scenelake.functions import taxonomy as T


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(map(quote, values)) + "]"


def _part(name: str, at: str) -> str:
    values = T.CAPTION_PARTS[name]
    return f"({strings(values)})[(({at}) % {len(values)} + 1)::INT]"


CAPTIONS = "captions AS (SELECT i AS clip_id, 'the vehicle drives ' || " + " || ".join([
    _part("T", "i"), "' in '", _part("W", "3 * i + 2"), "' '", _part("R", "5 * i + 1"), "' with '", _part("D", "2 * i"), "' and '", _part("A", "4 * i + 3"),
    "' ; '", _part("H", "i // 7"), "' ; the ego '", _part("G", "i // 5"),
]) + " AS text FROM (SELECT doc_id AS i FROM documents))"


def _hit(field: str, value: str) -> str:
    patterns = dict(T.TAG_RULES[field])[value]
    return f"regexp_matches(lower(text), {quote('|'.join(f'(?:{p})' for p in patterns))})"


def _tag(field: str) -> str:
    rules = [(v, _hit(field, v)) for v, _ in T.TAG_RULES[field]]
    if field in T.MULTI:
        found = "list_filter([" + ", ".join(f"CASE WHEN {hit} THEN '{v}' END" for v, hit in rules) + "], lambda x: x IS NOT NULL)"
        return f"CASE WHEN len({found}) = 0 THEN ['none'] ELSE {found} END AS {field}"
    return "CASE " + " ".join(f"WHEN {hit} THEN '{v}'" for v, hit in rules) + f" ELSE 'unknown' END AS {field}"


TAGS = "tags AS (SELECT clip_id, " + ", ".join(map(_tag, T.FIELDS)) + " FROM captions)"


def _dimension(name: str) -> str:
    if name == "agent_density":
        n = "len(list_filter(agent_type, lambda x: x <> 'none'))"
        return f"CASE {n} WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 0.85::DOUBLE END AS agent_density"
    field, values = T.DIMENSION_MAPS[name]
    return f"CASE {field} " + " ".join(f"WHEN '{v}' THEN {x}::DOUBLE" for v, x in values.items()) + f" END AS {name}"


NUMBERS = "numbers AS (SELECT clip_id, " + ", ".join(map(_dimension, T.DIMENSIONS)) + ", 'regex' AS source FROM tags)"


def _with(*parts: str, body: str) -> str:
    return "WITH " + ", ".join(parts) + (body if body.startswith(",") else " " + body)


def with_captions(body: str) -> str:
    return _with(CAPTIONS, body=body)


def with_tags(body: str) -> str:
    return _with(CAPTIONS, TAGS, body=body)


def with_numbers(body: str) -> str:
    return _with(CAPTIONS, TAGS, NUMBERS, body=body)


FIRST_VALUES = " UNION ALL ".join(f"SELECT '{f}' AS field, {f + '[1]' if f in T.MULTI else f} AS value FROM tags" for f in T.FIELDS)
ALL_VALUES = " UNION ALL ".join(f"SELECT '{f}' AS field, {f'unnest({f})' if f in T.MULTI else f} AS value FROM tags" for f in T.FIELDS)
POSSIBLE = "SELECT * FROM " + ", ".join(f"(SELECT unnest({strings(T.FIELDS[a])}) AS {a})" for a in ("time_of_day", "weather", "road_type", "hazard_level"))

ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({quote(q)}, {quote(v)}, {quote(text)})" for q, v, text, _ in T.queries()) + ") t(qid, level, text))"


def _terms(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({strings(T.STOP_WORDS)}, w))"


def _token_cte(table: str, key: str) -> str:
    return f"tok AS (SELECT doc_id, terms, len(terms) AS dl FROM (SELECT {key} AS doc_id, {_terms('text')} AS terms FROM {table}))"


def with_tokens(table: str, key: str, body: str) -> str:
    return _with(_token_cte(table, key), body=body)


def _bm25_ctes(k: int) -> list[str]:
    return [
        CAPTIONS, ASKED, _token_cte("captions", "clip_id"),
        f"wanted AS (SELECT qid, term, count(*) AS weight FROM (SELECT qid, unnest({_terms('text')}) AS term FROM asked) GROUP BY 1, 2)",
        "counted AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(terms) AS term FROM tok) GROUP BY 1, 2, 3)",
        "df AS (SELECT term, count(*) AS df FROM counted GROUP BY 1)",
        "total AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM tok)",
        "weighed AS (SELECT qid, doc_id, round(sum(weight * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM counted JOIN df USING (term) JOIN wanted USING (term), total GROUP BY 1, 2)",
        f"bm25 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM weighed QUALIFY rank <= {k})",
    ]


def bm25(k: int) -> str:
    return _with(*_bm25_ctes(k), body="SELECT qid, doc_id, score, rank FROM bm25")


_HINT_FIELDS = list(dict.fromkeys(f for f, _, _ in T.HINT_RULES))


def _hint(field: str) -> str:
    rules = [(v, " OR ".join(f"contains(lower(text), {quote(p)})" for p in parts)) for f, v, parts in T.HINT_RULES if f == field]
    return "CASE " + " ".join(f"WHEN {hit} THEN '{v}'" for v, hit in rules) + f" END AS {field}"


_HINT_CTE = "hints AS (SELECT *, coalesce(" + ", ".join(_HINT_FIELDS) + ") IS NOT NULL AS hinted FROM (SELECT qid, " + ", ".join(map(_hint, _HINT_FIELDS)) + " FROM asked))"
HINTS = _with(ASKED, _HINT_CTE, body="SELECT * FROM hints")

_LONG = "list_filter(string_split_regex(lower(a.text), '{}'), lambda w: length(w) > 3)"
_WEAK_CTE = f"weak AS (SELECT qid, clip_id FROM (SELECT qid, clip_id, c.text, {_LONG.format('[^a-z0-9_]+')} AS words FROM captions c, asked a) WHERE len(words) > 0 AND len(list_filter(words, lambda w: NOT contains(lower(text), w))) = 0)"
_RECIPE = "recipe AS (SELECT * FROM asked UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({quote(q)}, 'R', {quote(text)})" for q, text in T.RECIPE_QUERIES) + ") t(qid, level, text))"
WEAK = f", {ASKED}, {_RECIPE}, {_WEAK_CTE.replace('asked a', 'recipe a')}"

_CAUSAL = " OR ".join(f"contains(lower(text), '{s}')" for s in T.CAUSAL_STEMS)
DRY_RUN = f""", {ASKED}, shared AS (SELECT qid, level, clip_id, ({_CAUSAL}) AS causal, len(list_filter(words, lambda w: contains(lower(text), w))) / greatest(len(words), 1)::DOUBLE AS share
    FROM (SELECT qid, level, clip_id, c.text, {_LONG.format(chr(92) + 's+')} AS words FROM captions c, asked a)),
marked AS (SELECT *, CASE WHEN share >= 0.7::DOUBLE THEN 2 WHEN share >= 0.4::DOUBLE THEN 1 ELSE 0 END AS condition_score, CASE WHEN level IN ('L2', 'L3') AND causal THEN 1 ELSE 0 END AS causal_score FROM shared),
scored AS (SELECT *, CASE WHEN level IN ('L2', 'L3') THEN condition_score + causal_score >= 3 ELSE condition_score >= 2 END AS relevant FROM marked)"""


def _places(table: str, key: str) -> str:
    return f"SELECT {key}, place, count(*)::DOUBLE AS n FROM (SELECT {key}, ('0x' || substr(md5(term), 1, 7))::BIGINT % 64 AS place FROM (SELECT {key}, unnest({_terms('text')}) AS term FROM {table})) GROUP BY 1, 2"


def scores(body: str, k: int = 10) -> str:
    """The three rankings (ranked), dry-run labels (scored), metrics at 5 (scores) and the candidate pool."""
    fits = " AND ".join(f"(h.{f} IS NULL OR " + (f"list_contains(t.{f}, h.{f})" if f in T.MULTI else f"t.{f} = h.{f}") + ")" for f in _HINT_FIELDS)
    best = f"row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, clip_id) AS rank FROM {{}} QUALIFY rank <= {k}"
    return _with(
        *_bm25_ctes(k), TAGS, _HINT_CTE, DRY_RUN.removeprefix(f", {ASKED}, "),
        f"clip_cells AS ({_places('captions', 'clip_id')})", f"query_cells AS ({_places('asked', 'qid')})",
        "near AS (SELECT qid, clip_id, round(sum(c.n * q.n) / (any_value(c.length) * any_value(q.length)), 6) AS cosine FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY clip_id)) AS length FROM clip_cells) c"
        " JOIN (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY qid)) AS length FROM query_cells) q USING (place) GROUP BY 1, 2)",
        "every AS (SELECT qid, clip_id, coalesce(cosine, 0) AS cosine FROM (SELECT DISTINCT qid FROM query_cells) CROSS JOIN (SELECT DISTINCT clip_id FROM clip_cells) LEFT JOIN near USING (qid, clip_id))",
        f"fitting AS (SELECT e.* FROM every e JOIN hints h USING (qid) JOIN tags t USING (clip_id) WHERE hinted AND {fits})",
        f"filtered AS (SELECT qid, clip_id, {best.format('fitting')})", f"plain AS (SELECT qid, clip_id, {best.format('every')})",
        "ranked AS (SELECT 'bm25' AS method, qid, doc_id AS clip_id, rank FROM bm25 UNION ALL SELECT 'embedding', qid, clip_id, rank FROM plain"
        " UNION ALL SELECT 'hybrid', qid, clip_id, rank FROM filtered UNION ALL SELECT 'hybrid', qid, clip_id, rank FROM plain ANTI JOIN filtered USING (qid))",
        "labels AS (SELECT qid, clip_id FROM scored WHERE relevant)",
        "found AS (SELECT method, qid, count(w.clip_id) AS n_hits, min(rank) FILTER (w.clip_id IS NOT NULL) AS first FROM ranked r LEFT JOIN labels w USING (qid, clip_id) WHERE rank <= 5 GROUP BY 1, 2)",
        "scores AS (SELECT method, qid, level, n_relevant, round(n_hits / least(5, n_relevant), 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr"
        " FROM found JOIN (SELECT qid, count(*) AS n_relevant FROM labels GROUP BY 1) USING (qid) JOIN (SELECT qid, level FROM asked) USING (qid))",
        "chosen AS (SELECT DISTINCT qid, clip_id FROM ranked WHERE method <> 'hybrid')",
        "pool AS (SELECT qid, clip_id, 'ranked' AS origin FROM chosen UNION ALL SELECT qid, clip_id, 'random' FROM (SELECT qid, clip_id FROM (SELECT * FROM (SELECT DISTINCT qid FROM chosen) CROSS JOIN captions) p"
        " ANTI JOIN chosen USING (qid, clip_id)) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY clip_id * 7919 % 10007, clip_id) <= 15)",
        body=body,
    )


KDE_2D = f"""SELECT a.vec_id AS id, sum(exp(-((a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE) ** 2 + (a.embedding[2]::DOUBLE - b.embedding[2]::DOUBLE) ** 2) / {2 * 0.3**2!r}::DOUBLE))
    / (count(*) * {2 * math.pi * 0.3**2!r}::DOUBLE) AS density FROM embeddings a, embeddings b GROUP BY 1"""

_SEVEN = " + ".join(f"(a.{x} - b.{x}) ** 2" for x in T.DIMENSIONS)
KDE_7D = with_numbers(
    ", known AS (SELECT * FROM numbers WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in T.DIMENSIONS) + "), width AS (SELECT count(*) AS n, pow(count(*), -1.0::DOUBLE / 11) AS h FROM known WHERE clip_id % 10 <> 0),"
    f" each_one AS (SELECT a.clip_id, ln(sum(exp(-({_SEVEN}) / (2 * h * h)))) - ln(any_value(n)) - 3.5::DOUBLE * ln(2 * pi() * any_value(h) ** 2) AS v FROM known a, known b, width WHERE a.clip_id % 10 = 0 AND b.clip_id % 10 <> 0 GROUP BY 1)"
    " SELECT count(*) AS n_test, round(avg(v), 4) AS mean_log_density FROM each_one"
)

_DIMS = [f"e{i}" for i in range(10)]


def with_projection(body: str) -> str:
    """rows (id, cluster, ten numbers), Gaussian centers of the clusters, the closest center of each row, and the 50 rarest rows."""
    columns = ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(_DIMS))
    stats = ", ".join([f"avg({c}) AS mu_{c}" for c in _DIMS] + [f"stddev_pop({c}) + 1e-6 AS sd_{c}" for c in _DIMS])
    distance = " + ".join(f"(r.{c} - c.mu_{c}) ** 2" for c in _DIMS)
    log_density = f"{-5 * math.log(2 * math.pi)!r}::DOUBLE" + "".join(f" - ln(sd_{c}) - 0.5::DOUBLE * (({c} - mu_{c}) / sd_{c}) ** 2" for c in _DIMS)
    return _with(
        f"rows AS (SELECT vec_id AS id, label AS cluster, {columns} FROM embeddings)",
        f"centers AS (SELECT cluster, count(*) AS n, {stats} FROM rows GROUP BY 1)",
        f"closest AS (SELECT r.*, c.* EXCLUDE (cluster, n), c.cluster AS nearest_cluster, {distance} AS d2 FROM rows r, centers c QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY {distance}, c.cluster) = 1)",
        f"lowest AS (SELECT id, cluster, nearest_cluster, round({log_density}, 6) AS log_density FROM closest ORDER BY log_density, id LIMIT 50)",
        "gaps AS (SELECT row_number() OVER (ORDER BY log_density, id) AS rank, id, log_density, nearest_cluster, CASE nearest_cluster WHEN 0 THEN 'night rain' WHEN 2 THEN 'tunnel exit' ELSE 'cluster_' || nearest_cluster END AS scenario_name, cluster AS original_cluster, cluster = -1 AS is_noise FROM lowest)",
        body=body,
    )


def with_gaps(body: str) -> str:
    """The 200 rarest clips of high hazard under a diagonal Gaussian over the fully observed ones."""
    stats = ", ".join([f"avg({c}) AS mu_{c}" for c in T.DIMENSIONS] + [f"stddev_pop({c}) + 1e-6 AS sd_{c}" for c in T.DIMENSIONS])
    log_density = f"{-3.5 * math.log(2 * math.pi)!r}::DOUBLE" + "".join(f" - ln(sd_{c}) - 0.5::DOUBLE * (({c} - mu_{c}) / sd_{c}) ** 2" for c in T.DIMENSIONS)
    weight = "((1.0::DOUBLE - visibility_level) * 0.4::DOUBLE + precipitation_intensity * 0.3::DOUBLE + road_type_encoded * 0.3::DOUBLE)"
    return with_numbers(
        ", known AS (SELECT * FROM numbers WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in T.DIMENSIONS) + f"), model AS (SELECT {stats} FROM known),"
        f" dense AS (SELECT *, round({log_density}, 6) AS log_density FROM known, model WHERE hazard_proximity >= 0.7::DOUBLE),"
        f" gaps AS (SELECT row_number() OVER (ORDER BY gap_score DESC, clip_id) AS rank, clip_id, gap_score, log_density, " + ", ".join(f"round({x}, 3) AS {x}" for x in T.DIMENSIONS)
        + f" FROM (SELECT *, round(-log_density * hazard_proximity * {weight}, 4) AS gap_score FROM dense) ORDER BY rank LIMIT 200) " + body
    )
