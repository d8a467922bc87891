"""DuckDB SQL for the reports, written apart from their DataFrame plans."""

from __future__ import annotations

from segno.oracle import FAM, REL, SONGS, YEARS, SQL as CORE, P, _top

_PAPER = "lower(artist) = 'the paper estuaries'"
_SHORT = "release_type IN ('ep', 'single', 'broadcast')"
_TT = """sg AS (SELECT username, artist, album, track, count(*) AS n FROM p WHERE artist <> '' AND album <> '' GROUP BY ALL),
 tt AS (SELECT username, artist, album, CAST(sum(n) AS BIGINT) AS plays, first(track ORDER BY n DESC, track) FILTER (track IS NOT NULL) AS top_track, max(n) FILTER (track IS NOT NULL) AS top_plays FROM sg GROUP BY ALL)"""


def _dense(part: str, spine: str) -> str:
    return f"""WITH {P}, s AS (SELECT DISTINCT username, unnest({spine}) AS k FROM p), c AS (SELECT username, {part} AS k, count(*) AS plays FROM p GROUP BY ALL), j AS (SELECT s.username, s.k, coalesce(plays, 0) AS plays FROM s LEFT JOIN c ON c.username IS NOT DISTINCT FROM s.username AND c.k = s.k)
 SELECT username, k AS {part}, plays, round(plays * 100.0 / sum(plays) OVER (PARTITION BY username), 1) AS pct, row_number() OVER (PARTITION BY username ORDER BY plays DESC, k) = 1 AS peak FROM j"""


def _totals(where: str = "") -> str:
    return f"""WITH {P}, y AS (SELECT username, year, count(*) AS n FROM p {where} GROUP BY ALL), a AS (SELECT username, count(DISTINCT nullif(artist, '')) AS artists FROM p {where} GROUP BY ALL)
 SELECT y.username, CAST(sum(n) AS BIGINT) AS plays, any_value(artists) AS artists, max(year) - min(year) + 1 AS years, round(sum(n) / (max(year) - min(year) + 1), 2) AS plays_a_year, first(year ORDER BY n DESC, year) AS peak_year, max(n) AS peak_plays FROM y JOIN a USING (username) GROUP BY y.username"""


SQL: dict[str, str] = {
    "recent_artists": f"""WITH {P} SELECT username, artist, count(*) AS plays, row_number() OVER (PARTITION BY username ORDER BY count(*) DESC, artist) AS rank FROM p WHERE uts >= 1464739200 - 365 * 86400 AND artist <> '' GROUP BY username, artist QUALIFY rank <= 10""",
    "first_seen_albums": f"WITH {P} SELECT username, artist, album, uts, play_id FROM p WHERE album <> '' AND username IS NOT NULL QUALIFY row_number() OVER (PARTITION BY username, artist, album ORDER BY uts, play_id) = 1",
    "known_albums": f"WITH {P}, {SONGS}, {FAM} SELECT username, artist, album FROM f WHERE round(0.4 * coverage + 0.4 * depth + 0.2 * dispersion, 4) >= 0.4",
    "known_albums_5x5": f"WITH {P}, {SONGS} SELECT username, artist, album FROM s WHERE n >= 5 GROUP BY ALL HAVING count(*) >= 5",
    "album_top_tracks": f"WITH {P}, {_TT} SELECT * FROM tt",
    "short_release_artists": f"""WITH {P}, {_TT}, {REL}, k AS (SELECT tt.*, CASE WHEN coalesce(release_type, '') = '' THEN 'unknown' WHEN release_type = 'album' THEN 'album' WHEN {_SHORT} THEN 'short' ELSE 'other' END AS kind FROM tt LEFT JOIN mt USING (artist, album)),
 g AS (SELECT username, artist, CAST(coalesce(sum(plays) FILTER (kind = 'album'), 0) AS BIGINT) AS album_plays, CAST(coalesce(sum(plays) FILTER (kind = 'short'), 0) AS BIGINT) AS short_plays, CAST(coalesce(sum(plays) FILTER (kind = 'unknown'), 0) AS BIGINT) AS unknown_plays,
 CAST(coalesce(sum(plays) FILTER (kind = 'other'), 0) AS BIGINT) AS other_plays, CAST(sum(plays) AS BIGINT) AS plays, first(album ORDER BY plays DESC, album) FILTER (kind = 'short') AS top_short, first(top_track ORDER BY plays DESC, album) FILTER (kind = 'short') AS top_short_track FROM k GROUP BY ALL)
 SELECT *, round(short_plays / (short_plays + album_plays), 3) AS short_ratio FROM g WHERE short_plays > 0 AND plays >= 5 AND round(short_plays / (short_plays + album_plays), 3) >= 0.3""",
    "one_track_years": f"""WITH {P}, g AS (SELECT username, artist, track, album, count(*) AS n FROM p WHERE artist <> '' AND track IS NOT NULL GROUP BY ALL), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY username, artist ORDER BY n DESC, track, album) = 1),
 y AS (SELECT username, artist, track, year, count(*) AS y FROM p GROUP BY ALL) SELECT username, artist, track, coalesce(string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FILTER (y >= 0.25 * n), '') AS peak_years FROM b JOIN y USING (username, artist, track) GROUP BY ALL""",
    "temporal_hours": f"""WITH {P}, c AS (SELECT username, hour, count(*) AS plays FROM p GROUP BY ALL) SELECT username, hour, plays, round(plays * 100.0 / sum(plays) OVER (PARTITION BY username), 1) AS pct, row_number() OVER (PARTITION BY username ORDER BY plays DESC, hour) = 1 AS peak FROM c""",
    "temporal_weekdays": _dense("weekday", "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"),
    "temporal_months": _dense("month", "generate_series(1, 12)"),
    "overview_totals": _totals(),
    "period_totals": _totals("WHERE year BETWEEN 2012 AND 2016"),
    "period_top_artists": _top("artist", 20).replace("FROM p WHERE", "FROM p WHERE year BETWEEN 2012 AND 2016 AND"),
    "yearly_tops": f"""WITH {P}, {YEARS}, f AS (SELECT *, min(year) OVER (PARTITION BY username, artist) = year AS new FROM y), k AS (SELECT *, row_number() OVER (PARTITION BY username, year ORDER BY n DESC, artist) AS k, row_number() OVER (PARTITION BY username, year, new ORDER BY n DESC, artist) AS d FROM f)
 SELECT username, year, coalesce(string_agg(artist, '|' ORDER BY d) FILTER (new AND d <= 5), '') AS discoveries, string_agg(artist, '|' ORDER BY k) FILTER (k <= 10) AS top_artists FROM k GROUP BY username, year""",
    "artist_sparklines": f"""WITH {P}, {YEARS}, b AS (SELECT username, artist, CAST(sum(n) AS BIGINT) AS plays, min(year) AS first_year, count(*) AS years_active, row_number() OVER (PARTITION BY username ORDER BY sum(n) DESC, artist) AS rank FROM y GROUP BY username, artist QUALIFY rank <= 25),
 s AS (SELECT username, unnest(generate_series(min(year), max(year))) AS year FROM p GROUP BY username), j AS (SELECT b.*, s.year, coalesce(n, 0) AS n, max(coalesce(n, 0)) OVER (PARTITION BY b.username, b.artist) AS m FROM b JOIN s ON s.username = b.username LEFT JOIN y ON y.username = b.username AND y.artist = b.artist AND y.year = s.year)
 SELECT username, artist, plays, rank, first_year, years_active, string_agg(CAST(n AS VARCHAR), ',' ORDER BY year) AS by_year, string_agg(CAST(CAST(floor(n / m * 8) AS BIGINT) AS VARCHAR), ',' ORDER BY year) AS steps FROM j GROUP BY ALL""",
    "consistent_artists": f"""WITH {P}, {YEARS}, s AS (SELECT username, max(year) - min(year) + 1 AS span FROM p GROUP BY username) SELECT y.username, artist, count(*) AS years_active, CAST(sum(n) AS BIGINT) AS plays FROM y JOIN s USING (username) GROUP BY y.username, artist, span HAVING count(*) >= least(10, span - 1)""",
    "peak_obsessions": f"""WITH {P}, {YEARS} SELECT username, artist, first(year ORDER BY n DESC, year) AS peak_year, max(n) AS peak_plays, CAST(sum(n) AS BIGINT) AS plays, round(max(n) * 100.0 / sum(n), 2) AS concentration FROM y GROUP BY username, artist HAVING max(n) >= 10""",
    "year_totals": f"""WITH {P}, t AS (SELECT username, year, count(*) AS plays, count(DISTINCT nullif(artist, '')) AS artists, count(DISTINCT CASE WHEN album <> '' THEN {{'a': artist, 'b': album}} END) AS albums FROM p GROUP BY ALL)
 SELECT t.*, o.plays AS plays_before, round((t.plays - o.plays) * 100.0 / o.plays, 2) AS change_pct FROM t LEFT JOIN t o ON o.username = t.username AND o.year = t.year - 1""",
    "year_albums": f"""WITH {P}, g AS (SELECT username, artist, album, count(*) FILTER (year = 2015) AS plays, min(year) AS first_year FROM p WHERE artist <> '' AND album <> '' GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY username ORDER BY plays DESC, artist, album) AS rank, first_year = 2015 AS is_new FROM g WHERE plays > 0 QUALIFY rank <= 15""",
    "artist_years": f"WITH {P} SELECT username, year, count(*) AS plays FROM p WHERE {_PAPER} GROUP BY ALL",
    "artist_albums": f"""WITH {P}, {SONGS}, {FAM}, k AS (SELECT username, album, max(round(0.4 * coverage + 0.4 * depth + 0.2 * dispersion, 4)) AS familiarity, CAST(sum(tracks) AS BIGINT) AS tracks FROM f WHERE {_PAPER} GROUP BY ALL),
 a AS (SELECT username, album, count(*) AS plays, row_number() OVER (PARTITION BY username ORDER BY count(*) DESC, album) AS rank FROM p WHERE {_PAPER} AND album <> '' GROUP BY username, album QUALIFY rank <= 10) SELECT a.*, familiarity, tracks FROM a LEFT JOIN k USING (username, album)""",
    "loyalty_groups": f"""WITH {P}, {YEARS}, g AS (SELECT *, year - lag(year) OVER (PARTITION BY username, artist ORDER BY year) AS gap, max(year) OVER (PARTITION BY username) AS fin FROM y),
 a AS (SELECT username, artist, CAST(sum(n) AS BIGINT) AS plays, count(*) AS years_active, max(year) AS last_year, first(year ORDER BY n DESC, year) AS peak_year, max(n) AS peak_plays, last(gap ORDER BY year) FILTER (gap >= 3) AS gap, max(fin) AS fin FROM g GROUP BY username, artist)
 SELECT username, 'long_term' AS "group", artist, plays, years_active, last_year, peak_year, peak_plays, gap FROM a WHERE years_active >= 5
 UNION ALL SELECT username, 'rediscovered', artist, plays, years_active, last_year, peak_year, peak_plays, gap FROM a WHERE gap IS NOT NULL AND last_year >= fin - 1
 UNION ALL SELECT username, 'abandoned', artist, plays, years_active, last_year, peak_year, peak_plays, gap FROM a WHERE gap IS NOT NULL AND last_year <= fin - 2 AND plays >= 20 AND peak_plays >= 10 OR plays >= 30 AND last_year <= fin - 3 AND peak_plays >= 15""",
    "echo_score": f"""WITH {P}, {YEARS}, r AS (SELECT *, row_number() OVER w AS k, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER (PARTITION BY username, year) AS t FROM y WINDOW w AS (PARTITION BY username, year ORDER BY n DESC, artist)),
 m AS (SELECT username, year, sum(n) FILTER (k <= 10) * 100.0 / sum(n) AS a, sum(n) FILTER (k <= 20) * 100.0 / sum(n) AS b, count(*) * 1000.0 / sum(n) AS c, count(*) FILTER (s * 2 <= t) + 1 AS h FROM r GROUP BY ALL),
 z AS (SELECT *, least(a, 100) * 0.35 + least(b, 100) * 0.35 + greatest(0.0, 100 - h * 5) * 0.2 + greatest(0.0, 100 - c * 2) * 0.1 AS sc FROM m)
 SELECT username, year, round(a, 2) AS top10_pct, round(b, 2) AS top20_pct, round(c, 2) AS artists_per_1000, h AS artists_for_half, round(sc, 2) AS score, CASE WHEN sc >= 70 THEN 'critical' WHEN sc >= 55 THEN 'high' WHEN sc >= 40 THEN 'moderate' ELSE 'low' END AS level FROM z""",
    "calendar_days": f"""WITH {P}, e AS (SELECT username, CAST(ts AS DATE) AS d, artist, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT username, d, artist, row_number() OVER (PARTITION BY username, d ORDER BY n DESC, artist) AS k FROM e WHERE artist <> ''),
 t AS (SELECT username, d, string_agg(artist, '|' ORDER BY k) FILTER (k <= 3) AS top_artists FROM k GROUP BY ALL), y AS (SELECT username, d, CAST(sum(n) AS BIGINT) AS plays FROM e GROUP BY ALL),
 q AS (SELECT username, quantile_cont(plays, [0.2, 0.4, 0.6, 0.8, 1.0]) AS c FROM y GROUP BY username)
 SELECT y.username, CAST(y.d AS VARCHAR) AS day_of, plays, coalesce(top_artists, '') AS top_artists, len(list_filter(c, lambda v: plays >= v)) AS level FROM y JOIN q USING (username) LEFT JOIN t ON t.username = y.username AND t.d = y.d""",
    "discovery_lags": f"""WITH {P}, {REL}, f AS (SELECT username, p.artist, p.album, min(p.year) - any_value(mt.year) AS l FROM p JOIN mt ON mt.artist = p.artist AND mt.album = p.album WHERE mt.year IS NOT NULL GROUP BY ALL),
 g AS (SELECT username, CASE WHEN l < 0 THEN 'Before release' WHEN l = 0 THEN 'Same year' WHEN l = 1 THEN '1 year later' WHEN l <= 3 THEN '2-3 years' WHEN l <= 5 THEN '4-5 years' WHEN l <= 10 THEN '6-10 years' ELSE '10+ years' END AS bucket, count(*) AS albums FROM f GROUP BY ALL)
 SELECT username, bucket, albums, round(albums * 100.0 / sum(albums) OVER (PARTITION BY username), 2) AS pct FROM g""",
    "release_ages": f"""WITH {P}, {REL}, j AS (SELECT username, p.year AS y, mt.year AS r, max(p.year) OVER (PARTITION BY username) AS m FROM p JOIN mt ON mt.artist = p.artist AND mt.album = p.album WHERE mt.year IS NOT NULL)
 SELECT username, y AS year, count(*) AS plays, round(count(*) FILTER (r = y) * 100.0 / count(*), 2) AS new_pct, round(count(*) FILTER (r >= m // 10 * 10 - 10) * 100.0 / count(*), 2) AS modern_pct FROM j GROUP BY username, y""",
    "artist_streaks": f"""WITH {P}, d AS (SELECT DISTINCT username, artist, CAST(ts AS DATE) AS d FROM p WHERE artist <> ''), i AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY username, artist ORDER BY d) AS INTEGER) AS g FROM d), r AS (SELECT username, artist, count(*) AS days, min(d) AS a, max(d) AS z FROM i GROUP BY username, artist, g HAVING count(*) >= 2),
 b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY username, artist ORDER BY days DESC, a) = 1), l AS (SELECT username, max(CAST(ts AS DATE)) AS fin FROM p GROUP BY username)
 SELECT b.username, artist, days, CAST(a AS VARCHAR) AS first_day, CAST(z AS VARCHAR) AS last_day, z >= fin - 1 AS active FROM b JOIN l USING (username)""",
    "discovery_days": f"""WITH {P}, f AS (SELECT username, uts AS t, track, album, play_id FROM p WHERE {_PAPER} QUALIFY row_number() OVER (PARTITION BY username ORDER BY uts, play_id) = 1),
 s AS (SELECT *, sum(CASE WHEN b <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY username ORDER BY uts, play_id) AS sid FROM (SELECT *, uts - lag(uts) OVER (PARTITION BY username ORDER BY uts, play_id) AS b FROM p)),
 n AS (SELECT f.username, count(*) AS session_plays FROM f JOIN s x USING (username, play_id) JOIN s y ON y.username = x.username AND y.sid = x.sid GROUP BY f.username),
 a AS (SELECT f.username, CASE WHEN p.uts < t THEN 'b' ELSE 'a' END AS side, artist, count(*) AS n FROM f JOIN p ON p.username = f.username AND p.uts >= t - 86400 AND p.uts <= t + 86400 AND p.uts <> t WHERE artist <> '' AND NOT {_PAPER} GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY username, side ORDER BY n DESC, artist) AS k FROM a), g AS (SELECT username, string_agg(artist || ':' || n, '|' ORDER BY k) FILTER (side = 'b' AND k <= 5) AS db, string_agg(artist || ':' || n, '|' ORDER BY k) FILTER (side = 'a' AND k <= 5) AS da FROM k GROUP BY username)
 SELECT f.username, t AS first_uts, track AS first_track, album AS first_album, session_plays, coalesce(db, '') AS day_before, coalesce(da, '') AS day_after FROM f JOIN n USING (username) LEFT JOIN g USING (username)""",
    "trend_taus": f"""WITH t AS ({CORE["taste_evolution"]}), l AS (SELECT username, year, 'plays' AS measure, CAST(plays AS DOUBLE) AS v FROM t UNION ALL SELECT username, year, 'artists', artists FROM t UNION ALL SELECT username, year, 'top10_pct', top10_pct FROM t),
 s AS (SELECT x.username, x.measure, sum(sign(y.v - x.v)) AS s, count(*) AS n, count(*) FILTER (x.v = y.v) AS e FROM l x JOIN l y ON x.username = y.username AND x.measure = y.measure AND x.year < y.year GROUP BY ALL)
 SELECT o.username, o.measure, round(coalesce(s / nullif(sqrt(n * (n - e)), 0), 0), 6) AS tau FROM (SELECT DISTINCT username, measure FROM l) o LEFT JOIN s USING (username, measure)""",
    "random_pick": f"""WITH {P}, w AS (SELECT artist, count(*) AS plays, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years_active FROM p WHERE artist <> '' GROUP BY artist)
 SELECT * FROM w ORDER BY -ln((CAST('0x' || substr(md5('7:' || artist), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) / plays, artist LIMIT 20""",
    "diversified": f"""WITH RECURSIVE {P}, {SONGS}, {FAM}, a AS (SELECT username, artist || ' - ' || album AS item, artist AS g, round(0.4 * coverage + 0.4 * depth + 0.2 * dispersion, 4) AS f FROM f),
 b AS (SELECT *, min(f) OVER (PARTITION BY username) AS lo, max(f) OVER (PARTITION BY username) AS hi FROM a), sc AS (SELECT username, item, g, f, CASE WHEN hi > lo THEN (f - lo) / (hi - lo) ELSE 1.0 END AS rel FROM b),
 r AS (SELECT DISTINCT username, 0 AS place, CAST(NULL AS VARCHAR) AS item, CAST([] AS VARCHAR[]) AS items, CAST([] AS VARCHAR[]) AS gs FROM sc UNION ALL
 SELECT username, place, item, items, gs FROM (SELECT r.username, r.place + 1 AS place, sc.item, list_append(r.items, sc.item) AS items, list_append(r.gs, sc.g) AS gs,
 row_number() OVER (PARTITION BY r.username ORDER BY 0.7 * rel + (1 - 0.7) * CASE WHEN list_contains(r.gs, sc.g) THEN 0 ELSE 1 END DESC, f DESC, sc.item) AS k FROM r JOIN sc ON sc.username = r.username WHERE r.place < 10 AND NOT list_contains(r.items, sc.item)) WHERE k = 1)
 SELECT username, item, CAST(place AS BIGINT) AS place FROM r WHERE place > 0""",
}
