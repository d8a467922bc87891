"""DuckDB SQL for ranked lists in detail."""

from __future__ import annotations

from segno.oracle import ALIGN, CONS, HEARD, PICKS, P, _key

_PAPER = "a_key = 'paper estuaries'"
#: Picks with their place in the list.
_PLACED = f"""uu AS (SELECT list_id, critic, CAST(year AS BIGINT) AS year, unnest(albums) AS e, generate_subscripts(albums, 1) AS place FROM critic_lists),
 pp AS (SELECT * FROM (SELECT list_id, critic, year, place, e.artist AS artist, e.title AS title, {_key('e.artist')} AS a_key, {_key('e.title')} AS t_key FROM uu) WHERE a_key <> '' AND t_key <> '')"""

SQL: dict[str, str] = {
    "critics_spellings": f"""WITH {_PLACED}, g AS (SELECT a_key, t_key, artist, title, count(*) AS n, min({{'l': list_id, 'p': place}}) AS f FROM pp GROUP BY ALL), c AS (SELECT a_key, t_key, count(DISTINCT critic) AS critics FROM pp GROUP BY ALL)
 SELECT a_key, t_key, artist, title, critics FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY a_key, t_key ORDER BY n DESC, f) = 1) JOIN c USING (a_key, t_key)""",
    "validated_insights": f"""WITH {P}, {PICKS}, {HEARD}, {CONS}, v AS (SELECT cs.* FROM cs SEMI JOIN hd USING (a_key, t_key) WHERE critics >= 2), y AS (SELECT DISTINCT a_key, t_key, year FROM pk SEMI JOIN v USING (a_key, t_key) WHERE year IS NOT NULL)
 SELECT count(*) AS albums, round(avg(listings), 1) AS mean_listings, (SELECT a_key FROM v GROUP BY a_key ORDER BY count(*) DESC, a_key LIMIT 1) AS top_artist, (SELECT year FROM y GROUP BY year ORDER BY count(*) DESC, year LIMIT 1) AS top_year FROM v""",
    "alignment_years": f"WITH {P}, {PICKS}, {HEARD} SELECT critic, count(*) AS picks, count(hd.plays) AS heard, round(count(hd.plays) / count(*), 3) AS alignment FROM pk LEFT JOIN hd USING (a_key, t_key) WHERE critic IS NOT NULL AND year BETWEEN 2014 AND 2017 GROUP BY critic",
    "critic_picks": f"""WITH {P}, {PICKS}, {HEARD}, r AS (SELECT critic, a_key, t_key, min({{'y': coalesce(year, 9999), 'r': coalesce(rank, 999)}}) AS o FROM pk WHERE critic IS NOT NULL GROUP BY ALL), m AS (SELECT r.*, plays, plays IS NOT NULL AS h FROM r LEFT JOIN hd USING (a_key, t_key)),
 k AS (SELECT *, row_number() OVER (PARTITION BY critic, h ORDER BY o, t_key, a_key) AS k FROM m)
 SELECT critic, coalesce(string_agg(a_key || ' - ' || t_key || ':' || plays, '|' ORDER BY k) FILTER (h AND k <= 15), '') AS heard, coalesce(string_agg(a_key || ' - ' || t_key, '|' ORDER BY k) FILTER (NOT h AND k <= 15), '') AS missed FROM k GROUP BY critic""",
    "review_summary": f"""WITH {PICKS}, s AS (SELECT list_id, count(*) AS n FROM pk GROUP BY list_id) SELECT count(*) AS lists, CAST(sum(n) AS BIGINT) AS entries, round(avg(n), 1) AS mean_size, list_sort(list(n))[count(*) // 2 + 1] AS median_size,
 (SELECT count(*) FROM (SELECT DISTINCT a_key, t_key FROM pk)) AS albums, (SELECT count(DISTINCT a_key) FROM pk) AS artists FROM s""",
    "review_albums": f"""WITH {P}, {PICKS}, {HEARD}, {CONS}, d AS (SELECT a_key, t_key FROM cs WHERE critics >= 2 AND mean_rank IS NOT NULL ORDER BY mean_rank, a_key, t_key LIMIT 15)
 SELECT cs.a_key, cs.t_key, critics, mean_rank, hd.plays IS NOT NULL AS heard, critics >= 3 AS consensus, d.a_key IS NOT NULL AS darling, hd.plays IS NOT NULL AND critics BETWEEN 1 AND 3 AS deep_cut FROM cs LEFT JOIN hd USING (a_key, t_key) LEFT JOIN d ON d.a_key = cs.a_key AND d.t_key = cs.t_key""",
    "album_listings": f"""WITH {P}, {PICKS}, l AS (SELECT a_key, t_key, count(*) AS listings, coalesce(array_to_string(list_sort(list_distinct(list(year))), ','), '') AS years, string_agg(coalesce(critic, '') || ':' || coalesce(year, 9999) || ':' || coalesce(rank, 999), '|' ORDER BY coalesce(year, 9999), coalesce(rank, 999), coalesce(critic, '')) AS critics FROM pk GROUP BY ALL),
 m AS (SELECT {_key('artist')} AS a_key, {_key('album')} AS t_key, year * 12 + month - 1 AS m, count(*) AS n, min(uts) AS u FROM p GROUP BY ALL), h AS (SELECT a_key, t_key, CAST(sum(n) AS BIGINT) AS plays, min(u) AS first_uts, first(m ORDER BY n DESC, m) AS peak_month FROM m GROUP BY ALL)
 SELECT l.*, plays, first_uts, peak_month FROM l LEFT JOIN h USING (a_key, t_key)""",
    "artist_in_lists": f"""WITH {P}, {PICKS}, {HEARD}, l AS (SELECT t_key, min(year) AS year, count(*) AS listings, coalesce(array_to_string(list_sort(list_distinct(list(critic))), '|'), '') AS critics FROM pk WHERE {_PAPER} GROUP BY t_key)
 SELECT l.*, coalesce(plays, 0) AS plays FROM l LEFT JOIN (SELECT * FROM hd WHERE {_PAPER}) USING (t_key)""",
    "unheard_weighted": f"""WITH {P}, {PICKS}, {HEARD}, t AS (SELECT DISTINCT critic, a_key, t_key FROM pk WHERE critic IS NOT NULL), ov AS (SELECT critic, coalesce(round(count(hd.plays) / nullif(least(count(*), (SELECT count(*) FROM hd)), 0), 6), 0) AS o FROM t LEFT JOIN hd USING (a_key, t_key) GROUP BY critic),
 w AS (SELECT a_key, t_key, count(*) AS critics, round(sum(o), 6) AS weight FROM t ANTI JOIN hd USING (a_key, t_key) JOIN ov USING (critic) GROUP BY ALL), y AS (SELECT a_key, t_key, coalesce(array_to_string(list_sort(list_distinct(list(year))), ','), '') AS years FROM pk WHERE critic IS NOT NULL GROUP BY ALL)
 SELECT w.*, years FROM w JOIN y USING (a_key, t_key)""",
    "champions": f"WITH {P}, {PICKS}, {HEARD}, {ALIGN}, t AS (SELECT critic, count(*) AS times FROM pk WHERE {_PAPER} AND critic IS NOT NULL GROUP BY critic) SELECT critic, alignment, times FROM t JOIN al USING (critic)",
}
