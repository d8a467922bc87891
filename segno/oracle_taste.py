"""DuckDB SQL for taste, similarity and evaluation."""

from __future__ import annotations

from segno.oracle import ALIGN, HEARD, PICKS, RANK, SESS, SQL as CORE, P, _key

_BOTH = "SELECT lower(a) AS a, lower(b) AS b, {w} AS w FROM {t} UNION ALL SELECT lower(b), lower(a), {w} FROM {t}"


def _near(name: str, table: str, weight: str, k: int) -> str:
    return f"""{name}0 AS ({_BOTH.format(w=weight, t=table)}), {name} AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY max(w) DESC, b) AS place FROM {name}0 WHERE a <> b GROUP BY a, b QUALIFY place <= {k})"""


def _pairs(window: str, source: str = "p") -> str:
    """Co-occurrence of artists of 20 plays in windows of an owner, as ``u1``."""
    return f"""ft AS (SELECT artist FROM p WHERE artist <> '' GROUP BY artist HAVING count(*) >= 20), kk AS (SELECT DISTINCT username, artist, {window} AS wk FROM {source} JOIN ft USING (artist)), nn AS (SELECT artist, count(*) AS c FROM kk GROUP BY artist),
 u1 AS (SELECT a, b, round(weeks / sqrt(na.c * nb.c), 6) AS cosine FROM (SELECT x.artist AS a, y.artist AS b, count(*) AS weeks FROM kk x JOIN kk y ON x.username = y.username AND x.wk = y.wk AND x.artist < y.artist GROUP BY ALL) JOIN nn na ON na.artist = a JOIN nn nb ON nb.artist = b)"""


_WEEKS = _pairs("date_trunc('week', ts)")
_SPACE = """sv AS (SELECT lower(name) AS item, min(artist_id) % 500 AS v FROM artists GROUP BY ALL), sl AS (SELECT item, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM sv JOIN embeddings ON vec_id = v),
 tp AS (SELECT lower(artist) AS item, ln(1 + count(*)) AS w FROM p WHERE artist <> '' GROUP BY lower(artist) ORDER BY count(*) DESC, lower(artist) LIMIT 100), tm AS (SELECT i, sum(w * CAST(x AS DOUBLE)) / sum(w) AS m FROM tp JOIN sl USING (item) GROUP BY i),
 tv AS (SELECT i, m / sqrt(sum(m * m) OVER ()) AS t FROM tm), cw AS (SELECT critic, year, lower(artist) AS item, 1 / log2(coalesce(rank, 50) + 1) AS w FROM pk0 WHERE critic IS NOT NULL)"""


def _against(by: str, where: str = "") -> str:
    """Similarity of the unit mean vectors of ``by`` to the taste vector, as ``sim``."""
    return f"""mv AS (SELECT {by}, i, sum(w * CAST(x AS DOUBLE)) / sum(w) AS m FROM cw JOIN sl USING (item) {where} GROUP BY {by}, i), sim AS (SELECT {by}, sum(m * t) / sqrt(sum(m * m)) AS s FROM mv JOIN tv USING (i) GROUP BY {by})"""


def _continued(name: str) -> str:
    return f"""nt AS (SELECT *, count(*) OVER (PARTITION BY username, session_start) AS n FROM (SELECT DISTINCT username, session_start, lower(artist) AS i FROM ss WHERE artist <> '')), kn AS (SELECT * FROM nt WHERE n >= 3 AND i IN (SELECT a FROM nr)),
 sd AS (SELECT *, count(*) OVER (PARTITION BY username, session_start) AS m FROM kn QUALIFY m >= 2), pt AS (SELECT x.i AS a, y.i AS b FROM sd x JOIN sd y ON x.username = y.username AND x.session_start = y.session_start AND x.i <> y.i), ht AS (SELECT place FROM pt LEFT JOIN nr ON nr.a = pt.a AND nr.b = pt.b)
 SELECT '{name}' AS granularity, (SELECT count(*) FROM (SELECT DISTINCT username, session_start FROM sd WHERE username IS NOT NULL)) AS sessions, count(*) AS predictions, count(*) FILTER (place <= 10) AS hits_10, count(*) FILTER (place <= 20) AS hits_20, count(*) FILTER (place <= 50) AS hits_50,
 round(count(*) FILTER (place <= 10) / count(*), 6) AS rate_10, round(count(*) FILTER (place <= 20) / count(*), 6) AS rate_20, round(count(*) FILTER (place <= 50) / count(*), 6) AS rate_50, round(sum(coalesce(1 / place, 0)) / count(*), 6) AS mrr FROM ht"""


def _granularity(name: str, window: str) -> str:
    return f"SELECT * FROM (WITH {P}, {SESS}, {_pairs(window, 'ss')}, {_near('nr', 'u1', 'cosine', 100)}, {_continued(name)})"


SQL: dict[str, str] = {
    "temporal_matrix": f"""WITH {P}, o AS (SELECT artist FROM p WHERE artist <> '' GROUP BY artist HAVING count(*) >= 20), c AS (SELECT username, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS "window", artist, count(*) AS n FROM p JOIN o USING (artist) GROUP BY ALL),
 v AS (SELECT *, ln(1 + n) * ln((SELECT count(*) FROM (SELECT DISTINCT username, "window" FROM c)) / (count(*) OVER (PARTITION BY artist) + 1)) AS v FROM c)
 SELECT username, "window", artist, round(CASE WHEN sum(v * v) OVER (PARTITION BY username, "window") > 0 THEN v / sqrt(sum(v * v) OVER (PARTITION BY username, "window")) ELSE 0 END, 6) AS value FROM v""",
    "dimension_shares": """WITH l AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), v AS (SELECT dim, var_pop(CAST(x AS DOUBLE)) AS s FROM l GROUP BY dim) SELECT dim, round(s / sum(s) OVER (), 6) AS share FROM v""",
    "taste_gaps": f"""WITH mb AS ({CORE["musical_bridges"]}), pl AS (SELECT lower(artist) AS a, count(*) AS plays FROM plays WHERE artist <> '' AND uts IS NOT NULL GROUP BY ALL HAVING count(*) >= 50)
 SELECT a, plays, jaccard, CASE WHEN jaccard < 0.15 THEN 'divergent' WHEN jaccard > 0.3 THEN 'aligned' END AS label, only_one, only_other FROM mb JOIN pl USING (a)""",
    "bridge_items": """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL), k AS (SELECT q.vec_id AS a, r.vec_id AS b FROM u q JOIN u r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0
 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, r.v), 9) DESC, r.vec_id) <= 8), c AS (SELECT x.a, list_cosine_similarity(ux.v, uy.v) AS c FROM k x JOIN k y ON x.a = y.a AND x.b < y.b JOIN u ux ON ux.vec_id = x.b JOIN u uy ON uy.vec_id = y.b)
 SELECT a AS item, round(1 - avg(c), 6) AS diversity FROM c GROUP BY a HAVING count(*) >= 6 AND avg(c) < 2""",
    "gateways": f"""WITH {P}, {_WEEKS}, {_near('nr', 'u1', 'cosine', 20)}, f AS (SELECT username, lower(artist) AS artist, min(uts) AS t, min(year) AS y FROM p WHERE artist <> '' GROUP BY ALL)
 SELECT d.username, d.artist, nr.b AS gateway, row_number() OVER (PARTITION BY d.username, d.artist ORDER BY nr.place, nr.b) AS place FROM f d JOIN nr ON nr.a = d.artist JOIN f g ON g.username = d.username AND g.artist = nr.b AND g.t < d.t WHERE d.y = 2015 QUALIFY row_number() OVER (PARTITION BY d.username, d.artist ORDER BY nr.place, nr.b) <= 2""",
    "similar_artists": f"""WITH {P}, {_WEEKS}, {_near('nr', 'u1', 'cosine', 10)}, q(ordinal, asked) AS (VALUES (0, 'The Paper Estuaries'), (1, 'Nobody At All')), l AS (SELECT a, string_agg(b, '|' ORDER BY place) AS s FROM nr GROUP BY a)
 SELECT CAST(ordinal AS BIGINT) AS ordinal, asked, CASE WHEN s IS NULL THEN 'unknown' ELSE 'ok' END AS status, coalesce(s, '') AS similar FROM q LEFT JOIN l ON a = lower(asked)""",
    "similar_critics_given": f"WITH {P}, {PICKS}, {_SPACE}, {_against('critic')} SELECT critic, round(s, 6) AS similarity FROM sim ORDER BY round(s, 6) DESC, critic LIMIT 10",
    "critic_drift": f"""WITH {P}, {PICKS}, {_SPACE}, {_against('critic, year', 'WHERE year IS NOT NULL')}, d AS (SELECT critic, count(*) AS years, round(arg_min(s, year), 6) AS f, round(arg_max(s, year), 6) AS l FROM sim GROUP BY critic)
 SELECT critic, years, f AS first, l AS last, CASE WHEN l - f > 0.05 THEN 'rising' WHEN l - f < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM d""",
    "pick_weights": f"""WITH {P}, {PICKS}, {HEARD}, {ALIGN}, m AS (SELECT {_key('artist')} AS a_key, count(*) AS n FROM p WHERE artist IS NOT NULL GROUP BY 1), c AS (SELECT a_key, t_key, max(al.alignment) AS al FROM pk ANTI JOIN hd USING (a_key, t_key) JOIN al ON al.critic = pk.critic GROUP BY ALL)
 SELECT a_key, t_key, round(CASE WHEN al > 0 THEN greatest(al * CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE 0.3 END, 0.01) ELSE 0.001 END, 6) AS weight FROM c LEFT JOIN m USING (a_key)""",
    "continuation_weekly": _granularity("weekly", "date_trunc('week', ts)"),
    "continuation_granularities": " UNION ALL ".join(_granularity(n, w) for n, w in {"weekly": "date_trunc('week', ts)", "daily": "date_trunc('day', ts)", "monthly": "date_trunc('month', ts)", "session30": "session_start"}.items()),
    "holdout": f"""WITH {P}, {PICKS}, z AS (SELECT list_id, lower(artist) AS artist, 1 / log2(coalesce(rank, 50) + 1) / log2(count(*) OVER (PARTITION BY list_id) + 1) AS w FROM pk0 WHERE artist <> '' AND year <= 2014), o AS (SELECT artist FROM z GROUP BY artist HAVING count(DISTINCT list_id) >= 2),
 b AS (SELECT list_id, artist, max(w) AS w FROM z JOIN o USING (artist) GROUP BY ALL), u2 AS (SELECT x.artist AS a, y.artist AS b, round(sum(sqrt(x.w * y.w)), 6) AS weight FROM b x JOIN b y ON x.list_id = y.list_id AND x.artist < y.artist GROUP BY ALL), {_near('nr', 'u2', 'weight', 20)},
 od AS (SELECT lower(artist) AS i, count(*) AS n FROM p WHERE artist <> '' AND year <= 2014 GROUP BY 1), nw AS (SELECT DISTINCT lower(artist) AS i FROM p WHERE artist <> '' AND year BETWEEN 2015 AND 2016 AND lower(artist) NOT IN (SELECT i FROM od)), un AS (SELECT a AS i FROM nr UNION SELECT b FROM nr), pl AS (SELECT DISTINCT b AS i FROM nr JOIN od ON od.i = a WHERE n >= 3),
 c AS (SELECT (SELECT count(*) FROM nw) AS d, (SELECT count(*) FROM od WHERE n >= 3) AS s, (SELECT count(*) FROM pl) AS p, (SELECT count(*) FROM un) AS u, (SELECT count(*) FROM nw SEMI JOIN un USING (i)) AS q, (SELECT count(*) FROM nw SEMI JOIN pl USING (i)) AS h)
 SELECT d AS discoveries, s AS seeds, p AS pool, h AS predicted, CAST(floor(p * q / greatest(u, 1)) AS BIGINT) AS baseline, round(coalesce(h / nullif(d, 0), 0), 6) AS rate, round(h / nullif(floor(p * q / greatest(u, 1)), 0), 6) AS lift FROM c""",
    "follow_unheard": f"""WITH {P}, {PICKS}, {HEARD}, {RANK}, n AS (SELECT rk.* FROM rk LEFT JOIN hd USING (a_key, t_key) WHERE first_uts IS NULL OR year(make_timestamp(first_uts * 1000000)) > rk.year)
 SELECT year, count(*) AS items, {", ".join(f"round(count(*) FILTER (relevance >= {t}) / count(*), 6) AS rate_{t}" for t in (1, 5, 10, 50))} FROM n GROUP BY year""",
    "runs_compared": f"""WITH {P}, {PICKS}, {RANK}, r AS (SELECT k, rk.*, row_number() OVER (PARTITION BY k, year ORDER BY relevance DESC, place) AS b FROM rk CROSS JOIN (VALUES (10), (20)) t(k) WHERE place <= k),
 n AS (SELECT k, year, round(coalesce(sum(relevance / log2(place + 1)) / nullif(sum(relevance / log2(b + 1)), 0), 0), 6) AS v FROM r GROUP BY k, year) SELECT 'ndcg_' || year AS metric, max(v) FILTER (k = 10) AS first_10, max(v) FILTER (k = 20) AS first_20 FROM n GROUP BY year""",
}
