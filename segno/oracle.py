"""DuckDB SQL for the core queries, written apart from their DataFrame plans."""

from __future__ import annotations

P = """p AS (SELECT play_id, username, uts, make_timestamp(uts * 1000000) AS ts, artist, coalesce(album, '') AS album, track,
 CAST(year(make_timestamp(uts * 1000000)) AS BIGINT) AS year, CAST(month(make_timestamp(uts * 1000000)) AS BIGINT) AS month,
 CAST(hour(make_timestamp(uts * 1000000)) AS BIGINT) AS hour, dayname(make_timestamp(uts * 1000000)) AS weekday
 FROM plays WHERE uts IS NOT NULL)"""
ARTISTS = "a AS (SELECT username, artist, count(*) AS n FROM p WHERE artist <> '' GROUP BY ALL)"
YEARS = "y AS (SELECT username, artist, year, count(*) AS n FROM p WHERE artist <> '' GROUP BY ALL)"
SONGS = "s AS (SELECT username, artist, album, track, count(*) AS n FROM p WHERE artist <> '' AND album <> '' AND track IS NOT NULL GROUP BY ALL)"
FAM = """f0 AS (SELECT username, artist, album, count(*) AS tracks, CAST(sum(n) AS BIGINT) AS plays, sum(-q * log2(q + 1e-10)) AS h
 FROM (SELECT *, n / sum(n) OVER (PARTITION BY username, artist, album) AS q FROM s) GROUP BY ALL),
 f AS (SELECT username, artist, album, tracks, plays, least(tracks / 10.0, 1) AS coverage, least(plays / tracks / 10.0, 1) AS depth,
 CASE WHEN tracks = 1 THEN 1.0 ELSE h / log2(tracks) END AS dispersion FROM f0)"""


def _top(what: str, limit: int) -> str:
    cond = " AND ".join(f"coalesce({c}, '') <> ''" for c in what.split(", "))
    return f"""WITH {P} SELECT username, {what}, plays, rank FROM (SELECT username, {what}, count(*) AS plays,
 row_number() OVER (PARTITION BY username ORDER BY count(*) DESC, {what}) AS rank FROM p WHERE {cond} GROUP BY username, {what}) WHERE rank <= {limit}"""


def _part(part: str) -> str:
    return f"""WITH {P}, c AS (SELECT username, {part}, count(*) AS plays FROM p GROUP BY ALL)
 SELECT *, round(plays * 100.0 / sum(plays) OVER (PARTITION BY username), 1) AS pct FROM c"""


SQL: dict[str, str] = {
    "p7_found": """WITH o AS (SELECT username, uts, CASE WHEN uts - lag(uts) OVER w <= 1800 THEN 0 ELSE 1 END AS b FROM plays WHERE uts IS NOT NULL AND username IS NOT NULL
 WINDOW w AS (PARTITION BY username ORDER BY uts, play_id)), s AS (SELECT username, uts, sum(b) OVER (PARTITION BY username ORDER BY uts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM o))
 SELECT username, min(uts) AS start_uts, max(uts) AS end_uts FROM s GROUP BY username, k""",
    "top_artists": _top("artist", 20),
    "top_albums": _top("artist, album", 20),
    "top_tracks": _top("artist, track", 20),
    "distinct_counts": f"""WITH {P} SELECT username, count(*) AS plays, count(DISTINCT nullif(artist, '')) AS artists,
 count(DISTINCT CASE WHEN album <> '' THEN {{'a': artist, 'b': album}} END) AS albums, count(DISTINCT CASE WHEN track <> '' THEN {{'a': artist, 'b': track}} END) AS tracks,
 min(uts) AS first_uts, max(uts) AS last_uts, count(DISTINCT year) AS years FROM p GROUP BY username""",
    "first_last": f"""WITH {P} SELECT username, artist, count(*) AS plays, min(uts) AS first_uts, arg_min(track, {{'u': uts, 'p': play_id}}) FILTER (track IS NOT NULL) AS first_track,
 max(uts) AS last_uts, arg_max(track, {{'u': uts, 'p': play_id}}) FILTER (track IS NOT NULL) AS last_track FROM p WHERE artist <> '' GROUP BY ALL""",
    "spans": f"WITH {P} SELECT username, artist, count(*) AS plays, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years_active FROM p WHERE artist <> '' GROUP BY ALL",
    "discovered": f"WITH {P} SELECT username, artist, plays FROM (SELECT username, artist, min(year) AS y, count(*) FILTER (year = 2015) AS plays FROM p WHERE artist <> '' GROUP BY ALL) WHERE y = 2015",
    "abandoned": f"WITH {P} SELECT username, artist, plays, plays_in_year FROM (SELECT username, artist, max(year) AS y, count(*) AS plays, count(*) FILTER (year = 2015) AS plays_in_year FROM p WHERE artist <> '' GROUP BY ALL) WHERE y = 2015",
    "new_between": f"WITH {P} SELECT * FROM (SELECT username, artist, min(uts) AS first_uts, count(*) AS plays FROM p WHERE artist <> '' GROUP BY ALL) WHERE first_uts BETWEEN 1400000000 AND 1500000000",
    "albums_5x5": f"WITH {P}, {SONGS} SELECT username, artist, album, count(*) AS tracks, CAST(sum(n) AS BIGINT) AS plays FROM s WHERE n >= 2 GROUP BY ALL HAVING count(*) >= 2",
    "familiarity": f"WITH {P}, {SONGS}, {FAM} SELECT username, artist, album, tracks, plays, round(coverage, 6) AS coverage, round(depth, 6) AS depth, round(dispersion, 6) AS dispersion, round(0.4 * coverage + 0.4 * depth + 0.2 * dispersion, 4) AS familiarity FROM f",
    "obsessions": f"""WITH {P}, {SONGS}, {FAM}, sy AS (SELECT username, artist, album, track, year, count(*) AS y FROM p WHERE artist <> '' AND album <> '' AND track IS NOT NULL GROUP BY ALL),
 t AS (SELECT username, artist, album, track, CAST(sum(y) AS BIGINT) AS plays, array_to_string(list_sort(list(year) FILTER (y >= 0.25 * tot)), ',') AS peak_years
 FROM (SELECT *, sum(y) OVER (PARTITION BY username, artist, album, track) AS tot FROM sy) GROUP BY ALL)
 SELECT username, artist, album, track, t.plays, coalesce(peak_years, '') AS peak_years, f.tracks AS album_tracks, f.plays AS album_plays, round(0.4 * coverage + 0.4 * depth + 0.2 * dispersion, 4) AS familiarity, round(t.plays * 100.0 / f.plays, 1) AS share_pct
 FROM t JOIN f USING (username, artist, album) WHERE t.plays >= 8 AND (round(0.4 * coverage + 0.4 * depth + 0.2 * dispersion, 4) < 0.4 OR (f.tracks <= 3 AND round(t.plays * 100.0 / f.plays, 1) >= 50))""",
    "one_track_artists": f"""WITH {P}, g AS (SELECT username, artist, track, album, count(*) AS n FROM p WHERE artist <> '' AND track IS NOT NULL GROUP BY ALL),
 w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY username, artist) AS BIGINT) AS plays, count(*) OVER (PARTITION BY username, artist) - 1 AS others, row_number() OVER (PARTITION BY username, artist ORDER BY n DESC, track, album) AS k FROM g)
 SELECT username, artist, track, album, n AS top_plays, plays, others, round(n / plays, 3) AS concentration FROM w WHERE k = 1 AND round(n / plays, 3) >= 0.7 AND others <= 3 AND n >= 3""",
    "temporal_hour": _part("hour"),
    "temporal_weekday": _part("weekday"),
    "temporal_month": _part("month"),
    "taste_evolution": f"""WITH {P}, {YEARS}, m AS (SELECT *, min(year) OVER (PARTITION BY username, artist) AS fst, max(year) OVER (PARTITION BY username, artist) AS lst, row_number() OVER (PARTITION BY username, year ORDER BY n DESC, artist) AS k FROM y)
 SELECT username, year, CAST(sum(n) AS BIGINT) AS plays, count(*) AS artists, count(*) FILTER (fst = year) AS discovered, count(*) FILTER (lst = year) AS abandoned,
 round(coalesce(sum(n) FILTER (k <= 3), 0) * 100.0 / sum(n), 2) AS top3_pct, round(coalesce(sum(n) FILTER (k <= 10), 0) * 100.0 / sum(n), 2) AS top10_pct, max(artist) FILTER (k = 1) AS top_artist FROM m GROUP BY username, year""",
    "loyalty": f"""WITH {P}, {YEARS}, g AS (SELECT *, year - lag(year) OVER (PARTITION BY username, artist ORDER BY year) AS gap, max(year) OVER (PARTITION BY username) AS now FROM y),
 r AS (SELECT username, artist, count(*) AS years_active, CAST(sum(n) AS BIGINT) AS plays, min(year) AS first_year, max(year) AS last_year, max(gap) AS lg, max(now) AS now FROM g GROUP BY ALL)
 SELECT username, artist, years_active, plays, first_year, last_year, coalesce(lg, 0) AS longest_gap, coalesce(lg >= 3, false) AND last_year >= now - 1 AS rediscovered, years_active >= 5 AS loyal FROM r""",
    "funnel": f"""WITH {P}, {YEARS}, c AS (SELECT username, year, count(*) AS at_1, count(*) FILTER (n >= 5) AS at_5, count(*) FILTER (n >= 50) AS at_50, count(*) FILTER (n >= 200) AS at_200 FROM y GROUP BY ALL)
 SELECT *, round(at_5 * 100.0 / nullif(at_1, 0), 2) AS to_5, round(at_50 * 100.0 / nullif(at_5, 0), 2) AS to_50, round(at_200 * 100.0 / nullif(at_50, 0), 2) AS to_200 FROM c""",
    "echo_chamber": f"""WITH {P}, {ARTISTS}, r AS (SELECT *, row_number() OVER w AS k, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS cs, sum(n) OVER (PARTITION BY username) AS total FROM a WINDOW w AS (PARTITION BY username ORDER BY n DESC, artist))
 SELECT username, round(coalesce(sum(n) FILTER (k <= 10), 0) * 100.0 / sum(n), 2) AS top10_pct, round(coalesce(sum(n) FILTER (k <= 20), 0) * 100.0 / sum(n), 2) AS top20_pct, round(count(*) * 1000.0 / sum(n), 2) AS artists_per_1000, count(*) FILTER (cs * 2 <= total) + 1 AS artists_for_half FROM r GROUP BY username""",
    "streaks": f"""WITH {P}, d AS (SELECT DISTINCT username, CAST(ts AS DATE) AS d FROM p), i AS (SELECT username, d, d - CAST(row_number() OVER (PARTITION BY username ORDER BY d) AS INTEGER) AS island FROM d)
 SELECT username, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day, count(*) AS days FROM i GROUP BY username, island HAVING count(*) >= 2""",
    "rank_margins": f"""WITH {P}, {ARTISTS}, r AS (SELECT username, artist, n AS plays, row_number() OVER w AS rank, lead(n) OVER w AS nxt FROM a WINDOW w AS (PARTITION BY username ORDER BY n DESC, artist)),
 m AS (SELECT username, artist, plays, rank, round((plays - nxt) * 100.0 / plays, 2) AS margin_pct FROM r WHERE rank <= 20) SELECT *, CASE WHEN margin_pct < 5 THEN '~' WHEN margin_pct < 15 THEN '+' ELSE '' END AS band FROM m""",
    "calendar": f"""WITH {P}, d AS (SELECT username, CAST(CAST(ts AS DATE) AS VARCHAR) AS day_of, count(*) AS plays FROM p GROUP BY ALL), q AS (SELECT username, quantile_cont(plays, [0.2, 0.4, 0.6, 0.8]) AS c FROM d GROUP BY username)
 SELECT username, day_of, plays, CAST(plays > c[1] AS BIGINT) + CAST(plays > c[2] AS BIGINT) + CAST(plays > c[3] AS BIGINT) + CAST(plays > c[4] AS BIGINT) AS level FROM d JOIN q USING (username)""",
    "peaks": f"""WITH {P}, {YEARS}, g AS (SELECT username, artist, CAST(sum(n) AS BIGINT) AS plays, count(*) AS years_active, max(n) AS peak_plays, arg_max(year, {{'n': n, 'y': -year}}) AS peak_year, min(year) AS first_year FROM y GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY plays DESC, artist) AS rank FROM g) WHERE rank <= 50""",
    "core_years": f"""WITH {P}, {YEARS}, r AS (SELECT *, sum(n) OVER (PARTITION BY username, artist ORDER BY n DESC, year ROWS UNBOUNDED PRECEDING) AS cs, sum(n) OVER (PARTITION BY username, artist) AS total FROM y)
 SELECT username, artist, count(*) AS core_years, min(year) AS from_year, max(year) AS to_year FROM r WHERE cs - n < 0.7 * total GROUP BY ALL""",
}

WS = r"\t-\r \x{85}\p{Z}"
SESS = """o AS (SELECT *, CASE WHEN uts - lag(uts) OVER (PARTITION BY username ORDER BY uts, play_id) <= 1800 THEN NULL ELSE uts END AS nb FROM p),
 ss AS (SELECT *, max(nb) OVER (PARTITION BY username ORDER BY uts, play_id ROWS UNBOUNDED PRECEDING) AS session_start FROM o)"""
CNT = "c AS (SELECT username, lower(artist) AS key, year * 12 + month - 1 AS period, count(*) AS n FROM p WHERE trim(artist) <> '' GROUP BY ALL)"
LINE = """k AS (SELECT DISTINCT username, lower(artist) AS key FROM (SELECT username, artist, row_number() OVER (PARTITION BY username ORDER BY count(*) DESC, artist) AS r FROM p WHERE artist <> '' GROUP BY username, artist) WHERE r <= 5),
 line AS (SELECT k.username, k.key, printf('%04d-%02d', t.period // 12, t.period % 12 + 1) AS month, CAST(t.period AS BIGINT) AS period, coalesce(c.n, 0) AS plays, coalesce(c.n, 0) >= 1 AS active
 FROM k CROSS JOIN (SELECT unnest(range(24120, 24192)) AS period) t LEFT JOIN c ON c.username = k.username AND c.key = k.key AND c.period = t.period)"""


def _key(c: str) -> str:
    s = f"regexp_replace(lower({c}), '^[{WS}]+|[{WS}]+$', '', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '^the ', ''), '[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g')"
    return f"regexp_replace(regexp_replace({s}, '[{WS}]+', ' ', 'g'), '^ +| +$', '', 'g')"


PICKS = f"""u AS (SELECT list_id, critic, publication, CAST(year AS BIGINT) AS year, unnest(albums) AS e FROM critic_lists),
 pk0 AS (SELECT list_id, critic, publication, year, e.artist AS artist, e.title AS title, CAST(e.rank AS BIGINT) AS rank FROM u),
 pk AS (SELECT * FROM (SELECT *, {_key('artist')} AS a_key, {_key('title')} AS t_key FROM pk0) WHERE a_key <> '' AND t_key <> '')"""
HEARD = f"hd AS (SELECT a_key, t_key, count(*) AS plays, min(uts) AS first_uts FROM (SELECT {_key('artist')} AS a_key, {_key('album')} AS t_key, uts FROM p) WHERE a_key <> '' AND t_key <> '' GROUP BY ALL)"
CONS = "cs AS (SELECT a_key, t_key, count(DISTINCT critic) AS critics, count(*) AS listings, round(avg(rank), 4) AS mean_rank, min(year) AS first_year, max(year) AS last_year FROM pk GROUP BY ALL)"
ALIGN = "al AS (SELECT critic, count(*) AS picks, count(hd.plays) AS heard, round(count(hd.plays) / count(*), 3) AS alignment FROM pk LEFT JOIN hd USING (a_key, t_key) WHERE critic IS NOT NULL GROUP BY critic)"
REL = f"""al0 AS (SELECT artist, album, count(*) AS plays, regexp_replace(lower(artist), '^[{WS}]+|[{WS}]+$', '', 'g') AS an, regexp_replace(lower(album), '^[{WS}]+|[{WS}]+$', '', 'g') AS tn FROM p WHERE artist <> '' AND album <> '' GROUP BY ALL),
 ex AS (SELECT al0.*, (SELECT min(id) FROM releases r WHERE r.artist_norm = an AND r.title_norm = tn) AS rid FROM al0 WHERE an <> '' AND tn <> ''),
 lo AS (SELECT artist, album, any_value(plays) AS plays, min(id) AS rid FROM ex JOIN releases r ON r.title_norm = tn AND contains(r.artist_norm, an) WHERE rid IS NULL GROUP BY artist, album),
 lk AS (SELECT artist, album, plays, rid FROM ex WHERE rid IS NOT NULL UNION ALL SELECT artist, album, plays, rid FROM lo),
 mt AS (SELECT lk.artist, lk.album, lk.plays, rid AS release_id, CAST(r.year AS BIGINT) AS year, release_type, r.country FROM lk JOIN releases r ON r.id = rid)"""
EDGES = """nd0 AS (SELECT username, session_start, lower(artist) AS node FROM ss WHERE trim(artist) <> ''), of AS (SELECT node FROM nd0 GROUP BY node HAVING count(*) >= 5),
 nd AS (SELECT DISTINCT nd0.* FROM nd0 JOIN of USING (node)), nn AS (SELECT node, count(*) AS s FROM nd GROUP BY node),
 ed0 AS (SELECT x.node AS source, y.node AS target, count(*) AS shared_sessions FROM nd x JOIN nd y ON x.username = y.username AND x.session_start = y.session_start AND x.node < y.node GROUP BY ALL HAVING count(*) >= 3),
 ed AS (SELECT source, target, shared_sessions, round(shared_sessions / (sa.s + sb.s - shared_sessions), 12) AS jaccard FROM ed0 JOIN nn sa ON sa.node = source JOIN nn sb ON sb.node = target),
 bw AS (SELECT source AS node, target AS other, shared_sessions AS weight FROM ed UNION ALL SELECT target, source, shared_sessions FROM ed)"""
T0 = 1433116800  # 2015-06-01
_CASE = f"CASE WHEN uts >= {T0} - 120 * 86400 AND uts < {T0} - 30 * 86400 OR uts >= {T0} + 37 * 86400 AND uts < {T0} + 127 * 86400 THEN 'baseline' WHEN uts >= {T0} - 30 * 86400 AND uts < {T0} THEN 'pre' WHEN uts >= {T0} AND uts < {T0} + 7 * 86400 THEN 'event' WHEN uts >= {T0} + 7 * 86400 AND uts < {T0} + 37 * 86400 THEN 'post' END"
WIN = f"w AS (SELECT * FROM (SELECT *, {_CASE} AS period FROM p) WHERE period IS NOT NULL)"
_BEFORE = f"uts >= {T0} - 120 * 86400 AND uts < {T0} - 30 * 86400"
_AFTER = f"uts >= {T0} + 37 * 86400 AND uts < {T0} + 127 * 86400"
_DAYS = "(CASE period WHEN 'baseline' THEN 180.0 WHEN 'baseline_before' THEN 90.0 WHEN 'baseline_after' THEN 90.0 WHEN 'event' THEN 7.0 ELSE 30.0 END)"
WIN6 = f"""{WIN}, w6 AS (SELECT * FROM w UNION ALL SELECT *, 'baseline_before' FROM p WHERE {_BEFORE} UNION ALL SELECT *, 'baseline_after' FROM p WHERE {_AFTER})"""


def _strip(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g'), '')"


def _cohorts(grain: str, cohort: str, low: str, high: str, least: int, offsets: tuple[int, ...]) -> str:
    end = "least(hi, fin)" if grain == "month" else f"least({high} * 12 + 11, fin)"
    name = "printf('%04d-%02d', s.cohort // 12, s.cohort % 12 + 1)" if grain == "month" else "printf('%04d', s.cohort)"
    ks = ", ".join(f"({k})" for k in offsets)
    return f"""WITH {P}, {CNT}, f0 AS (SELECT username, lower(artist) AS key, min(year * 12 + month - 1) AS d, min({cohort}) AS cohort FROM p WHERE trim(artist) <> '' GROUP BY ALL),
 f AS (SELECT f0.* FROM f0 JOIN c ON c.username = f0.username AND c.key = f0.key AND c.period = d WHERE c.n >= {least}),
 b AS (SELECT username, min({cohort}) AS lo, max({cohort}) AS hi, max(year * 12 + month - 1) FILTER (trim(artist) <> '') AS fin FROM p GROUP BY ALL),
 s AS (SELECT username, unnest(generate_series({low}, {high})) AS cohort FROM b), o(k) AS (VALUES {ks}),
 g AS (SELECT f.username, f.cohort, k, count(*) AS eligible, count(*) FILTER (coalesce(c.n, 0) >= 1) AS retained FROM f JOIN b USING (username) CROSS JOIN o LEFT JOIN c ON c.username = f.username AND c.key = f.key AND c.period = d + k WHERE d + k <= {end} GROUP BY ALL)
 SELECT s.username, {name} AS cohort, CAST(o.k AS BIGINT) AS "offset", coalesce(eligible, 0) AS eligible, coalesce(retained, 0) AS retained, round(retained / eligible, 6) AS rate
 FROM s CROSS JOIN o LEFT JOIN g ON g.username = s.username AND g.cohort = s.cohort AND g.k = o.k"""


def _compared(entity: str, top_n: int) -> str:
    names, raw = ("a", f"{_strip('artist')} AS a") if entity == "artist" else ("a, b", f"{_strip('artist')} AS a, {_strip(entity)} AS b")
    out = "a AS artist" if entity == "artist" else f"a AS artist, b AS {entity}"
    full = "a IS NOT NULL" if entity == "artist" else "a IS NOT NULL AND b IS NOT NULL"
    e = {"pre": "(30 / 180)", "event": "(7 / 180)", "post": "(30 / 180)"}
    ps = ("baseline", "pre", "event", "post")
    of = ", ".join(f"coalesce(max(n) FILTER (period = '{q}'), 0) AS {q}_plays, coalesce(max(share) FILTER (period = '{q}'), 0) AS {q}_share0" for q in ps)
    expected = ", ".join(f"round(baseline_plays * {x}, 6) AS {q}_expected, CASE WHEN baseline_plays > 0 THEN round(({q}_plays - baseline_plays * {x}) / sqrt(baseline_plays * {x}), 6) END AS {q}_residual" for q, x in e.items())
    return f"""WITH {P}, {WIN}, al AS (SELECT username, period, count(*) AS o FROM w GROUP BY ALL), n AS (SELECT username, period, {raw} FROM w), c AS (SELECT username, period, {names}, count(*) AS n FROM n WHERE {full} GROUP BY ALL),
 r AS (SELECT *, round(n / o, 10) AS share, row_number() OVER (PARTITION BY username, period ORDER BY n DESC, {names}) AS k FROM c JOIN al USING (username, period)),
 g AS (SELECT username, {names}, {of} FROM r GROUP BY ALL HAVING min(k) <= {top_n}), h AS (SELECT username, {names}, min(uts) AS u FROM (SELECT username, uts, {raw} FROM p) WHERE {full} GROUP BY ALL)
 SELECT username, {out}, row_number() OVER (PARTITION BY username ORDER BY abs(round(post_share0 - pre_share0, 10)) DESC, post_plays DESC, {names}) AS place, {", ".join(f"{q}_plays" for q in ps)}, {", ".join(f"round({q}_share0, 6) AS {q}_share" for q in ps)}, {expected},
 post_plays - pre_plays AS change, round(round(post_share0 - pre_share0, 10), 6) AS share_change, {", ".join(f"{q}_plays > 0 AS in_{q}" for q in ps)}, u >= {T0} AND u < {T0} + 7 * 86400 AS first_in_event FROM g JOIN h USING (username, {names})"""


BINS = """b0 AS (SELECT username, CAST(date_trunc('month', ts) AS DATE) AS bin, coalesce(artist, '') AS artist, count(*) AS n FROM p GROUP BY ALL),
 vk AS (SELECT username, artist FROM (SELECT username, artist, row_number() OVER (PARTITION BY username ORDER BY sum(n) DESC, artist) AS k FROM b0 GROUP BY username, artist) WHERE k <= 5),
 sp AS (SELECT username, CAST(unnest(generate_series(min(bin), max(bin), INTERVAL 1 MONTH)) AS DATE) AS bin FROM b0 GROUP BY username),
 wd AS (SELECT username, artist FROM vk UNION ALL SELECT DISTINCT username, '__OTHER__' FROM vk),
 nm AS (SELECT b0.username, bin, coalesce(vk.artist, '__OTHER__') AS artist, sum(n) AS n FROM b0 LEFT JOIN vk ON vk.username = b0.username AND vk.artist = b0.artist GROUP BY ALL),
 bc AS (SELECT sp.username, CAST(sp.bin AS VARCHAR) AS bin, wd.artist, CAST(coalesce(nm.n, 0) AS BIGINT) AS n FROM sp JOIN wd ON wd.username = sp.username LEFT JOIN nm ON nm.username = sp.username AND nm.bin = sp.bin AND nm.artist = wd.artist)"""
RANK = """rk0 AS (SELECT year, a_key, t_key, count(DISTINCT critic) AS popularity FROM pk WHERE year IS NOT NULL GROUP BY ALL),
 lt AS (SELECT rk0.year AS y, rk0.a_key, rk0.t_key, count(*) AS relevance FROM rk0 JOIN (SELECT """ + _key("artist") + " AS a_key, " + _key("album") + """ AS t_key, year FROM p) q ON q.a_key = rk0.a_key AND q.t_key = rk0.t_key AND q.year > rk0.year GROUP BY ALL),
 rk AS (SELECT rk0.year, rk0.a_key, rk0.t_key, popularity, coalesce(relevance, 0) AS relevance, row_number() OVER (PARTITION BY rk0.year ORDER BY popularity DESC, rk0.a_key, rk0.t_key) AS place FROM rk0 LEFT JOIN lt ON lt.y = rk0.year AND lt.a_key = rk0.a_key AND lt.t_key = rk0.t_key)"""

IDENT = f"""pm AS (SELECT *, CASE WHEN {_strip('lower(m)')} IS NOT NULL THEN 'mbid:' || {_strip('lower(m)')} WHEN {_key('artist')} <> '' THEN 'name:' || {_key('artist')} END AS node
 FROM (SELECT p.*, artist_mbid AS m FROM p JOIN (SELECT play_id, artist_mbid FROM plays) USING (play_id) WHERE year BETWEEN 2012 AND 2018)),
 io AS (SELECT *, CASE WHEN uts - lag(uts) OVER (PARTITION BY username ORDER BY uts, play_id) <= 1800 THEN NULL ELSE uts END AS nb FROM pm),
 se AS (SELECT *, max(nb) OVER (PARTITION BY username ORDER BY uts, play_id ROWS UNBOUNDED PRECEDING) AS sid FROM io),
 spl AS (SELECT node, artist, count(*) AS n FROM pm WHERE node IS NOT NULL GROUP BY ALL),
 an AS (SELECT node, first(artist ORDER BY n DESC, artist) AS name, string_agg(artist, '|' ORDER BY artist) AS aliases, CAST(sum(n) AS BIGINT) AS plays FROM spl GROUP BY node),
 ms AS (SELECT DISTINCT se.username, sid, node FROM se JOIN an USING (node) WHERE plays >= 3),
 ns AS (SELECT node, count(*) AS sessions FROM ms GROUP BY node), nds AS (SELECT an.*, sessions FROM an JOIN ns USING (node)),
 pr AS (SELECT x.node AS source, y.node AS target, count(*) AS n FROM ms x JOIN ms y ON x.username = y.username AND x.sid = y.sid AND x.node < y.node GROUP BY ALL),
 egs AS (SELECT source, target, n AS shared_sessions, round(1 / n, 12) AS distance, round(n / (a.sessions + b.sessions - n), 12) AS jaccard FROM pr JOIN ns a ON a.node = source JOIN ns b ON b.node = target WHERE n >= 2),
 lk2 AS (SELECT source AS node, target AS other, shared_sessions AS w FROM egs UNION ALL SELECT target, source, shared_sessions FROM egs)"""
SQL |= {
    "identity_nodes": f"WITH {P}, {IDENT} SELECT * FROM nds",
    "identity_edges": f"WITH {P}, {IDENT} SELECT * FROM egs",
    "identity_diagnostics": f"""WITH {P}, {IDENT} SELECT (SELECT count(*) FROM pm) AS source_plays, (SELECT count(*) FROM (SELECT DISTINCT username, sid FROM se WHERE username IS NOT NULL)) AS sessions, (SELECT count(*) FROM pm WHERE node IS NULL) AS empty_artist,
 (SELECT count(*) FROM an) AS artists, (SELECT count(*) FROM an WHERE plays < 3) AS artists_below, (SELECT count(*) FROM pr WHERE n < 2) AS edges_below""",
    "identity_degrees": f"""WITH {P}, {IDENT}, g AS (SELECT node, count(*) AS degree, sum(w) AS strength FROM lk2 GROUP BY node)
 SELECT nds.node, coalesce(degree, 0) AS degree, CAST(coalesce(strength, 0) AS BIGINT) AS strength, round(coalesce(degree, 0) / ((SELECT count(*) FROM nds) - 1), 12) AS degree_centrality FROM nds LEFT JOIN g USING (node)""",
    "identity_participation": f"""WITH {P}, {IDENT}, i AS (SELECT lk2.node, unicode(name) AS g, sum(w) AS w FROM lk2 JOIN nds ON nds.node = other GROUP BY ALL), h AS (SELECT node, 1 - sum(w * w) / (sum(w) * sum(w)) AS v FROM i GROUP BY node)
 SELECT nds.node, round(coalesce(v, 0), 6) AS participation FROM nds LEFT JOIN h USING (node)""",
    "identity_focus": f"""WITH {P}, {IDENT}, f AS (SELECT node FROM nds ORDER BY plays DESC, node LIMIT 1), r AS (SELECT node FROM f UNION SELECT other FROM lk2 SEMI JOIN f USING (node))
 SELECT egs.* FROM egs WHERE source IN (SELECT node FROM r) AND target IN (SELECT node FROM r)""",
    "session_ids": f"WITH {P}, {SESS} SELECT play_id, username, uts, session_start FROM ss",
    "session_stats": f"""WITH {P}, {SESS}, e AS (SELECT username, session_start, count(*) AS n, count(DISTINCT artist) AS a, (max(uts) - min(uts)) / 60.0 AS m FROM ss GROUP BY ALL)
 SELECT username, count(*) AS sessions, round(avg(n), 4) AS mean_plays, round(median(n), 4) AS median_plays, round(avg(a), 4) AS mean_artists, round(median(a), 4) AS median_artists, round(avg(m), 4) AS mean_minutes, round(median(CAST(m AS DOUBLE)), 4) AS median_minutes,
 count(*) FILTER (n = 1) AS single_play, count(*) FILTER (a > 1) AS multi_artist FROM e GROUP BY username""",
    "transitions": f"""WITH {P}, l AS (SELECT username, artist AS from_artist, lead(artist) OVER w AS to_artist, lead(uts) OVER w - uts AS wait FROM p WINDOW w AS (PARTITION BY username ORDER BY uts, play_id))
 SELECT username, from_artist, to_artist, count(*) AS n FROM l WHERE wait <= 1800 AND lower(from_artist) <> lower(to_artist) GROUP BY ALL HAVING count(*) >= 2""",
    "discovery_context": f"""WITH {P}, {SESS}, st AS (SELECT username, artist, uts AS first_uts, session_start FROM (SELECT *, row_number() OVER (PARTITION BY username, artist ORDER BY uts, play_id) AS k FROM ss WHERE artist <> '') WHERE k = 1),
 co AS (SELECT username, session_start, list_sort(list(DISTINCT artist)) AS l FROM ss WHERE artist <> '' GROUP BY ALL)
 SELECT username, artist, first_uts, coalesce(array_to_string(list_filter(l, lambda x: x <> artist), '|'), '') AS others FROM st JOIN co USING (username, session_start)""",
    "trajectory_timeline": f"WITH {P}, {CNT}, {LINE} SELECT * FROM line",
    "trajectory_summary": f"""WITH {P}, {CNT}, {LINE}, g AS (SELECT username, key, sum(plays) AS plays, count(*) FILTER (active) AS active_periods, count(*) AS periods,
 min(period) FILTER (active) AS f, max(period) FILTER (active) AS l FROM line GROUP BY ALL), t AS (SELECT username, lower(artist) AS key, min(uts) AS first_uts, max(uts) AS last_uts FROM p WHERE year BETWEEN 2010 AND 2015 GROUP BY ALL)
 SELECT g.username, g.key, CAST(plays AS BIGINT) AS plays, periods, active_periods, round(active_periods / periods, 6) AS active_share, coalesce(l - f + 1, 0) AS span,
 CASE WHEN l IS NOT NULL THEN round(active_periods / (l - f + 1), 6) END AS span_share, first_uts, last_uts FROM g LEFT JOIN t USING (username, key)""",
    "trajectory_batch": f"""WITH {P}, {CNT}, q(ordinal, asked) AS (VALUES (0, 'the paper estuaries'), (1, 'Nobody At All'), (2, 'THE SOFT BEACONS')),
 sp AS (SELECT username, lower(artist) AS key, artist, count(*) AS n FROM p GROUP BY ALL), sh AS (SELECT username, key, first(artist ORDER BY n DESC, artist) AS shown FROM sp GROUP BY ALL),
 w AS (SELECT username, key, CAST(sum(n) AS BIGINT) AS plays, count(*) FILTER (n >= 2) AS active_periods FROM c WHERE period BETWEEN 24120 AND 24191 GROUP BY ALL)
 SELECT u.username, CAST(ordinal AS BIGINT) AS ordinal, asked, CASE WHEN shown IS NULL THEN 'not_found' ELSE 'ok' END AS status, shown, coalesce(plays, 0) AS plays, coalesce(active_periods, 0) AS active_periods
 FROM (SELECT DISTINCT username FROM p) u CROSS JOIN q LEFT JOIN sh ON sh.username IS NOT DISTINCT FROM u.username AND sh.key = lower(asked) LEFT JOIN w ON w.username = u.username AND w.key = lower(asked)""",
    "trajectory_observation": f"""WITH {P}, {CNT}, {LINE}, g AS (SELECT username, key, min(period) FILTER (active) AS f, max(period) FILTER (active) AS l FROM line GROUP BY ALL),
 so AS (SELECT username, min(year * 12 + month - 1) AS a, max(year * 12 + month - 1) AS z FROM p GROUP BY ALL)
 SELECT g.username, key, a AS source_start, z AS source_end, a < 24120 AS left_truncated, z > 24191 AS right_truncated, z <= 24191 AS right_censored,
 coalesce(f - 24120, 72) AS leading_inactive, coalesce(24191 - l, 72) AS trailing_inactive FROM g JOIN so USING (username)""",
    "trajectory_segments": f"""WITH {P}, {CNT}, {LINE}, a AS (SELECT *, CASE WHEN period - lag(period) OVER (PARTITION BY username, key ORDER BY period) - 1 < 3 THEN 0 ELSE 1 END AS b FROM line WHERE active),
 i AS (SELECT *, CAST(sum(b) OVER (PARTITION BY username, key ORDER BY period) AS BIGINT) AS segment FROM a)
 SELECT username, key, segment, min(period) AS start_period, max(period) AS end_period, count(*) AS active_periods, CAST(sum(plays) AS BIGINT) AS plays FROM i GROUP BY ALL""",
    "peak_ramp": f"""WITH {P}, {CNT}, {LINE}, a AS (SELECT *, max(plays) OVER (PARTITION BY username, key) AS tp, min(period) FILTER (active) OVER (PARTITION BY username, key) AS fst FROM line),
 b AS (SELECT *, min(period) FILTER (plays = tp) OVER (PARTITION BY username, key) AS pk FROM a WHERE tp > 0),
 g AS (SELECT username, key, max(tp) AS peak_plays, max(pk) AS peak_period, string_agg(month, ',' ORDER BY month) FILTER (plays = tp) AS peak_periods, max(fst) AS first_period, max(plays) FILTER (period = fst) AS first_plays,
 max(pk - fst) AS distance, regr_slope(plays, period) FILTER (period BETWEEN fst AND pk) AS s FROM b GROUP BY ALL)
 SELECT username, key, peak_plays, peak_period, peak_periods, first_period, first_plays, distance, peak_plays - first_plays AS change,
 CASE WHEN distance > 0 THEN round((peak_plays - first_plays) / distance, 6) END AS mean_change, CASE WHEN distance > 0 THEN round(s, 6) END AS slope FROM g""",
    "dormancy": f"""WITH {P}, {CNT}, {LINE}, a AS (SELECT *, CAST(sum(plays) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS BIGINT) AS next3, CAST(sum(plays) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS BIGINT) AS next6 FROM line WINDOW w AS (PARTITION BY username, key ORDER BY period)),
 g AS (SELECT *, period - lag(period) OVER (PARTITION BY username, key ORDER BY period) - 1 AS gap FROM a WHERE active)
 SELECT username, key, gap, period - gap AS start_period, period - 1 AS end_period, period AS return_period, plays AS return_plays, next3, period + 2 <= 24191 AS complete3, next6, period + 5 <= 24191 AS complete6 FROM g WHERE gap >= 3""",
    "cohort_retention": _cohorts("month", "year * 12 + month - 1", "lo", "hi", 2, (1, 3, 6, 12)),
    "cohort_years": _cohorts("year", "year", "2011", "2014", 1, (1, 12)),
    "cohort_summary": f"""WITH {P}, {CNT}, f AS (SELECT username, key, min(period) AS cohort, arg_min(n, period) AS fn FROM c GROUP BY ALL HAVING arg_min(n, period) >= 2), b AS (SELECT username, min(year * 12 + month - 1) AS lo, max(year * 12 + month - 1) AS hi FROM p GROUP BY ALL),
 l AS (SELECT f.username, f.key, cohort, fn, coalesce(bool_or(c.period > cohort), false) AS later FROM f JOIN c USING (username, key) GROUP BY ALL),
 g AS (SELECT username, cohort, count(*) AS size, round(avg(fn), 6) AS mean_first, round(median(fn), 6) AS median_first, count(*) FILTER (later) AS later FROM l GROUP BY ALL), sp AS (SELECT username, unnest(generate_series(lo, hi)) AS cohort FROM b)
 SELECT username, printf('%04d-%02d', cohort // 12, cohort % 12 + 1) AS cohort, coalesce(size, 0) AS size, mean_first, median_first, coalesce(later, 0) AS later, round(later / size, 6) AS later_rate FROM sp LEFT JOIN g USING (username, cohort)""",
    "event_periods": f"""WITH {P}, {WIN6}, n AS (SELECT username, period, {_strip('artist')} AS a, {_strip('album')} AS b, {_strip('track')} AS t FROM w6)
 SELECT username, period, count(*) AS plays, count(DISTINCT a) AS artists, count(DISTINCT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {{'a': a, 'b': b}} END) AS albums, count(DISTINCT CASE WHEN a IS NOT NULL AND t IS NOT NULL THEN {{'a': a, 'b': t}} END) AS tracks,
 CAST({_DAYS} AS BIGINT) AS days, round(count(*) / {_DAYS}, 6) AS per_day FROM n GROUP BY username, period""",
    "event_tops": f"""WITH {P}, {WIN6}, n AS (SELECT username, period, {_strip('artist')} AS a, {_strip('album')} AS b FROM w6), c AS (SELECT username, period, a, b, count(*) AS n, row_number() OVER (PARTITION BY username, period ORDER BY count(*) DESC, a, b) AS k FROM n WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY username, period, a, b)
 SELECT username, period, count(*) AS entities, least(count(*), 5) AS returned, string_agg(a || ' - ' || b || ':' || n, '|' ORDER BY k) FILTER (k <= 5) AS tops FROM c GROUP BY ALL""",
    "event_compare": _compared("artist", 10),
    "event_compare_tracks": _compared("track", 5),
    "month_bins_vocab": f"WITH {P}, {BINS} SELECT username, bin, artist, n FROM bc",
    "share_vectors": f"WITH {P}, {BINS} SELECT username, bin, artist, CASE WHEN sum(n) OVER (PARTITION BY username, bin) > 0 THEN round(sqrt(n / sum(n) OVER (PARTITION BY username, bin)), 6) ELSE 0 END AS value FROM bc",
    "session_graph_edges": f"WITH {P}, {SESS}, {EDGES} SELECT * FROM ed",
    "graph_strength": f"WITH {P}, {SESS}, {EDGES} SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM bw GROUP BY node",
    "participation": f"WITH {P}, {SESS}, {EDGES}, i AS (SELECT node, length(other) % 3 AS g, sum(weight) AS w FROM bw GROUP BY ALL) SELECT node, round(1 - sum(w * w) / (sum(w) * sum(w)), 6) AS participation FROM i GROUP BY node",
    "hop_neighbourhood": f"""WITH {P}, {SESS}, {EDGES}, h AS (SELECT node, 0 AS distance FROM bw WHERE node = 'the paper estuaries' UNION SELECT other, 1 FROM bw WHERE node = 'the paper estuaries' UNION SELECT b.other, 2 FROM bw x JOIN bw b ON b.node = x.other WHERE x.node = 'the paper estuaries')
 SELECT node, CAST(min(distance) AS BIGINT) AS distance FROM h GROUP BY node""",
    "normalize_key": f"WITH {P} SELECT artist, album, {_key('artist')} AS a_key, {_key('album')} AS t_key FROM (SELECT DISTINCT artist, album FROM p WHERE artist IS NOT NULL)",
    "critics_consolidated": f"WITH {PICKS}, {CONS} SELECT * FROM cs",
    "blind_spots": f"""WITH {P}, {PICKS}, {HEARD}, y AS (SELECT a_key, t_key, year, count(DISTINCT critic) AS n FROM pk GROUP BY ALL)
 SELECT a_key, t_key, CAST(sum(n) AS BIGINT) AS critics, count(year) AS years FROM y ANTI JOIN hd USING (a_key, t_key) GROUP BY ALL HAVING sum(n) >= 2""",
    "validated": f"WITH {P}, {PICKS}, {HEARD}, {CONS} SELECT cs.*, hd.plays, hd.first_uts, year(make_timestamp(first_uts * 1000000)) < first_year AS before_critics FROM cs JOIN hd USING (a_key, t_key) WHERE critics >= 2",
    "critic_alignment": f"WITH {P}, {PICKS}, {HEARD}, {ALIGN} SELECT * FROM al",
    "critic_recommended": f"""WITH {P}, {PICKS}, {HEARD}, {ALIGN} SELECT a_key, t_key, round(sum(al.alignment), 6) AS score, count(DISTINCT pk.critic) AS critics FROM pk ANTI JOIN hd USING (a_key, t_key) JOIN al ON al.critic = pk.critic GROUP BY ALL ORDER BY score DESC, critics DESC, a_key, t_key LIMIT 20""",
    "critic_overlap": f"""WITH {P}, {PICKS}, {HEARD}, t AS (SELECT DISTINCT critic, a_key, t_key FROM pk WHERE critic IS NOT NULL)
 SELECT critic, count(hd.plays) AS shared, count(*) AS albums, coalesce(round(count(hd.plays) / nullif(least(count(*), (SELECT count(*) FROM hd)), 0), 6), 0) AS overlap FROM t LEFT JOIN hd USING (a_key, t_key) GROUP BY critic""",
    "critic_accuracy": f"""WITH {P}, {PICKS}, l AS (SELECT a_key, t_key, count(*) AS n FROM (SELECT {_key('artist')} AS a_key, {_key('album')} AS t_key FROM p WHERE year > 2015) WHERE a_key <> '' AND t_key <> '' GROUP BY ALL), t AS (SELECT DISTINCT critic, a_key, t_key FROM pk WHERE year = 2015 AND critic IS NOT NULL)
 SELECT critic, count(*) AS picks, count(n) AS played, count(*) FILTER (n >= 10) AS played_10 FROM t LEFT JOIN l USING (a_key, t_key) GROUP BY critic""",
    "critic_tracker": f"""WITH {P}, {PICKS}, {HEARD}, s AS (SELECT critic, count(*) AS shared FROM (SELECT DISTINCT critic, a_key, t_key FROM pk SEMI JOIN hd USING (a_key, t_key) WHERE year = 2015) GROUP BY critic HAVING count(*) >= 1)
 SELECT a_key, t_key, CAST(sum(shared) AS BIGINT) AS score, count(*) AS critics FROM (SELECT DISTINCT critic, a_key, t_key FROM pk ANTI JOIN hd USING (a_key, t_key) WHERE year = 2016) JOIN s USING (critic) GROUP BY ALL""",
    "critics_review": f"WITH {PICKS} SELECT a_key, count(*) AS listings, count(DISTINCT t_key) AS albums, count(DISTINCT critic) AS critics, round(avg(rank), 4) AS mean_rank FROM pk GROUP BY a_key",
    "lists_summary": f"WITH {PICKS} SELECT critic, publication, year, count(DISTINCT list_id) AS lists, count(*) AS albums FROM pk0 GROUP BY ALL",
    "release_lookup": f"WITH {P}, {REL} SELECT artist, album, rid AS release_id FROM lk",
    "genres": f"""WITH {P}, {REL}, g AS (SELECT release_id, genre FROM (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY count DESC, genre) AS k FROM release_genres) WHERE k <= 5) SELECT genre, CAST(sum(plays) AS BIGINT) AS plays, count(*) AS albums, round(sum(plays) * 100.0 / (SELECT sum(plays) FROM mt), 2) AS pct FROM mt JOIN g USING (release_id) GROUP BY genre""",
    "labels": f"""WITH {P}, {REL}, l AS (SELECT DISTINCT release_id, label_name FROM release_labels WHERE label_name <> ''), k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY label_name) <= 3)
 SELECT label_name, CAST(sum(plays) AS BIGINT) AS plays, count(*) AS albums, round(sum(plays) * 100.0 / (SELECT sum(plays) FROM mt), 2) AS pct FROM mt JOIN k USING (release_id) GROUP BY label_name""",
    "countries": f"WITH {P}, {REL} SELECT country, CAST(sum(plays) AS BIGINT) AS plays, count(*) AS albums, round(sum(plays) * 100.0 / (SELECT sum(plays) FROM mt), 2) AS pct FROM mt WHERE country <> '' GROUP BY country",
    "release_types": f"WITH {P}, {REL} SELECT release_type, CAST(sum(plays) AS BIGINT) AS plays, count(*) AS albums, round(sum(plays) * 100.0 / (SELECT sum(plays) FROM mt), 2) AS pct FROM mt WHERE release_type <> '' GROUP BY release_type",
    "catalog": f"WITH {P}, {REL} SELECT year // 10 * 10 AS decade, CAST(sum(plays) AS BIGINT) AS plays, count(*) AS albums, count(DISTINCT artist) AS artists FROM mt WHERE year IS NOT NULL GROUP BY 1",
    "release_mix": f"""WITH {P}, {REL}, z AS (SELECT artist, plays, CASE WHEN release_type = 'album' THEN 'a' WHEN release_type IN ('ep', 'single', 'broadcast') THEN 's' WHEN coalesce(release_type, '') = '' THEN 'u' ELSE 'o' END AS k FROM mt),
 t AS (SELECT artist, CAST(coalesce(sum(plays) FILTER (k = 'a'), 0) AS BIGINT) AS album_plays, CAST(coalesce(sum(plays) FILTER (k = 's'), 0) AS BIGINT) AS short_plays, CAST(coalesce(sum(plays) FILTER (k = 'u'), 0) AS BIGINT) AS unknown_plays, CAST(coalesce(sum(plays) FILTER (k = 'o'), 0) AS BIGINT) AS other_plays FROM z GROUP BY artist)
 SELECT *, round(short_plays / nullif(short_plays + album_plays, 0), 3) AS short_ratio FROM t""",
    "knn": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS sim FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
 SELECT query_id, vec_id, round(sim, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS place FROM s) WHERE place <= 10""",
    "dim_poles": """WITH l AS (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS dim, unnest(embedding) AS value FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY value DESC, vec_id) AS h, row_number() OVER (PARTITION BY dim ORDER BY value, vec_id) AS lo FROM l)
 SELECT dim, 'high' AS pole, h AS place, vec_id, round(CAST(value AS DOUBLE), 6) AS value FROM r WHERE h <= 3 UNION ALL SELECT dim, 'low', lo, vec_id, round(CAST(value AS DOUBLE), 6) FROM r WHERE lo <= 3""",
    "cooccurrence_cosine": f"""WITH {P}, o AS (SELECT artist FROM p WHERE artist <> '' GROUP BY artist HAVING count(*) >= 20), k AS (SELECT DISTINCT username, artist, date_trunc('week', ts) AS wk FROM p JOIN o USING (artist)), n AS (SELECT artist, count(*) AS c FROM k GROUP BY artist),
 pr AS (SELECT x.artist AS a, y.artist AS b, count(*) AS weeks FROM k x JOIN k y ON x.username = y.username AND x.wk = y.wk AND x.artist < y.artist GROUP BY ALL)
 SELECT a, b, weeks, round(weeks / sqrt(na.c * nb.c), 6) AS cosine FROM pr JOIN n na ON na.artist = a JOIN n nb ON nb.artist = b""",
    "colisting": f"""WITH {PICKS}, z AS (SELECT list_id, lower(artist) AS artist, 1 / log2(coalesce(rank, 50) + 1) / log2(count(*) OVER (PARTITION BY list_id) + 1) AS w FROM pk0 WHERE artist <> ''), o AS (SELECT artist FROM z GROUP BY artist HAVING count(DISTINCT list_id) >= 2),
 b AS (SELECT list_id, artist, max(w) AS w FROM z JOIN o USING (artist) GROUP BY ALL) SELECT x.artist AS a, y.artist AS b, round(sum(sqrt(x.w * y.w)), 6) AS weight FROM b x JOIN b y ON x.list_id = y.list_id AND x.artist < y.artist GROUP BY ALL""",
    "ndcg": f"""WITH {P}, {PICKS}, {RANK}, f AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY relevance DESC, place) AS b FROM rk WHERE place <= 20)
 SELECT year, round(coalesce(sum(relevance / log2(place + 1)) / nullif(sum(relevance / log2(b + 1)), 0), 0), 6) AS ndcg FROM f GROUP BY year""",
    "hits": f"WITH {P}, {PICKS}, {RANK} SELECT year, count(*) FILTER (relevance >= 1) AS hits_1, count(*) FILTER (relevance >= 5) AS hits_5, count(*) FILTER (relevance >= 10) AS hits_10 FROM rk WHERE place <= 20 GROUP BY year",
    "novelty": f"WITH {P}, {PICKS}, {RANK} SELECT year, round(avg(popularity) FILTER (place <= 20), 6) AS top_popularity, round(avg(popularity), 6) AS popularity, round(avg(popularity) FILTER (place <= 20) / avg(popularity), 6) AS ratio FROM rk GROUP BY year",
    "follow_through": f"WITH {P}, {PICKS}, {RANK} SELECT year, count(*) AS items, round(count(*) FILTER (relevance >= 1) / count(*), 6) AS rate_1, round(count(*) FILTER (relevance >= 5) / count(*), 6) AS rate_5, round(count(*) FILTER (relevance >= 10) / count(*), 6) AS rate_10 FROM rk GROUP BY year",
    "gini_coverage": f"""WITH {P}, {PICKS}, n AS (SELECT year, a_key, count(*) AS n FROM pk WHERE year IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n, a_key) AS i, row_number() OVER (PARTITION BY year ORDER BY n DESC, a_key) AS k, count(*) OVER (PARTITION BY year) AS m FROM n)
 SELECT year, count(*) AS items, round(sum(n) FILTER (k <= 10) / sum(n), 6) AS top10_share, round(greatest(0, least(1, (max(m) + 1 - 2 * sum((m + 1 - i) * n) / sum(n)) / max(m))), 6) AS gini FROM r GROUP BY year""",
}
SQL |= {
    "musical_bridges": f"""WITH {P}, {PICKS}, u1 AS ({SQL["cooccurrence_cosine"].replace(f"WITH {P}, ", "WITH ")}), u2 AS ({SQL["colisting"].replace(f"WITH {PICKS}, ", "WITH ")}),
 b1 AS (SELECT lower(a) AS a, lower(b) AS b, cosine AS w FROM u1 UNION ALL SELECT lower(b), lower(a), cosine FROM u1), b2 AS (SELECT lower(a) AS a, lower(b) AS b, weight AS w FROM u2 UNION ALL SELECT lower(b), lower(a), weight FROM u2),
 n1 AS (SELECT a, list_sort(list(b)) AS x FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY max(w) DESC, b) AS k FROM b1 WHERE a <> b GROUP BY a, b) WHERE k <= 15 GROUP BY a),
 n2 AS (SELECT a, list_sort(list(b)) AS y FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY max(w) DESC, b) AS k FROM b2 WHERE a <> b GROUP BY a, b) WHERE k <= 15 GROUP BY a)
 SELECT a, array_to_string(list_filter(x, lambda v: list_contains(y, v)), '|') AS shared, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), '|') AS only_one, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), '|') AS only_other,
 round(len(list_filter(x, lambda v: list_contains(y, v))) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM n1 JOIN n2 USING (a)""",
    "release_era_plays": f"WITH {P}, {REL} SELECT artist, album, CAST(sum(plays) AS BIGINT) AS plays, min(year) AS year FROM mt WHERE year BETWEEN 1990 AND 1999 GROUP BY artist, album",
    "album_acclaim": f"WITH {P}, {PICKS}, {HEARD}, {CONS} SELECT a_key, t_key, critics, mean_rank, coalesce(hd.plays, 0) AS plays FROM cs LEFT JOIN hd USING (a_key, t_key) WHERE critics >= 2",
}
SQL |= {
    "who_listed": f"WITH {PICKS} SELECT year, t_key, count(DISTINCT critic) AS critics, min(rank) AS best_rank FROM pk WHERE a_key = 'paper estuaries' GROUP BY ALL",
    "regrets": f"""WITH {P}, {PICKS}, {HEARD}, {CONS}, kn AS (SELECT {_key('artist')} AS a_key, count(*) AS artist_plays FROM p GROUP BY 1)
 SELECT cs.*, artist_plays, 2025 - last_year AS years_ago FROM cs ANTI JOIN hd USING (a_key, t_key) JOIN kn USING (a_key) WHERE 2025 - last_year >= 3 AND a_key <> ''""",
    "frequent_listings": f"""WITH {P}, {PICKS}, {HEARD} SELECT a_key, t_key, count(*) AS listings, coalesce(array_to_string(list_sort(list(DISTINCT critic))[1:3], '|'), '') AS critics FROM pk ANTI JOIN hd USING (a_key, t_key) GROUP BY ALL HAVING count(*) >= 2""",
    "critic_profiles": f"""WITH {P}, {PICKS}, {HEARD}, r AS (SELECT pk.*, hd.plays AS h FROM pk LEFT JOIN hd USING (a_key, t_key) WHERE critic IS NOT NULL), b AS (SELECT critic, count(*) AS picks, count(h) AS heard, min(year) AS first_year, max(year) AS last_year FROM r GROUP BY critic),
 sg AS (SELECT critic, array_to_string(list_sort(list(a_key) FILTER (n >= 2)), '|') AS signature FROM (SELECT critic, a_key, count(*) AS n FROM r GROUP BY ALL) GROUP BY critic)
 SELECT critic, picks, heard, first_year, last_year, row_number() OVER (ORDER BY round(heard / picks, 6) DESC, critic) AS rank, coalesce(signature, '') AS signature FROM b JOIN sg USING (critic)""",
    "catalog_stats": """SELECT (SELECT count(*) FROM releases) AS releases, (SELECT CAST(min(year) AS BIGINT) FROM releases) AS first_year, (SELECT CAST(max(year) AS BIGINT) FROM releases) AS last_year, (SELECT count(DISTINCT artist_norm) FROM releases) AS artists,
 (SELECT count(DISTINCT genre) FROM release_genres) AS genres, (SELECT CAST(sum(count) AS BIGINT) FROM release_genres) AS tags, (SELECT count(DISTINCT label_name) FROM release_labels) AS labels""",
    "top_genres": "SELECT genre, CAST(sum(count) AS BIGINT) AS n FROM release_genres WHERE genre <> '' GROUP BY genre ORDER BY n DESC, genre LIMIT 20",
    "top_labels": "SELECT label_name, count(*) AS n FROM release_labels WHERE label_name <> '' GROUP BY label_name ORDER BY n DESC, label_name LIMIT 20",
    "artist_profile": f"""WITH {P}, m AS (SELECT * FROM p WHERE lower(artist) = 'the paper estuaries'), y AS (SELECT username, arg_max(year, {{'n': n, 'y': -year}}) AS peak_year, max(n) AS peak_plays FROM (SELECT username, year, count(*) AS n FROM m GROUP BY ALL) GROUP BY username)
 SELECT username, count(*) AS plays, min(uts) AS first_uts, max(uts) AS last_uts, max(year) - min(year) + 1 AS years_active, count(DISTINCT nullif(album, '')) AS albums, count(DISTINCT track) AS tracks, any_value(peak_year) AS peak_year, any_value(peak_plays) AS peak_plays FROM m JOIN y USING (username) GROUP BY username""",
    "year_review": f"""WITH {P}, {YEARS}, w AS (SELECT username, artist, max(n) FILTER (year = 2015) AS plays, coalesce(max(n) FILTER (year = 2014), 0) AS plays_before, min(year) AS first_year, max(n) AS most FROM y GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY username ORDER BY plays DESC, artist) AS rank FROM w WHERE plays IS NOT NULL) SELECT username, artist, rank, plays, plays_before, first_year, first_year = 2015 AS is_new, plays = most AS is_peak FROM r WHERE rank <= 15""",
    "period_summary": f"""WITH {P}, {YEARS}, m AS (SELECT *, min(year) OVER (PARTITION BY username, artist) AS f FROM y) SELECT username, year, CAST(sum(n) AS BIGINT) AS plays, count(*) AS artists, count(*) FILTER (f = year) AS discovered FROM m WHERE year BETWEEN 2012 AND 2016 GROUP BY username, year""",
    "artists_containing": f"WITH {P} SELECT username, artist, count(*) AS plays FROM p WHERE artist <> '' AND (contains(lower(artist), 'paper') OR contains('paper', lower(artist))) GROUP BY ALL",
    "plays_rollup": f"WITH {P} SELECT username, year, month, count(*) AS plays FROM p GROUP BY ROLLUP (username, year, month)",
}
