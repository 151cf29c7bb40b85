"""SQL twins of the core problem queries, over whole tables."""

_BARE = "translate(lower({0}), '{{}}- ', '')"


def _bare(column: str) -> str:
    return _BARE.format(column)


_REGISTRIES = {
    "match_id": ("open_matches", "match_id"),
    "team_id": ("product_teams", "team_id"),
    "player_id": ("product_players", "player_id"),
    "source_resource_id": ("provider_payload", "resource_id"),
}

_P1 = (
    "WITH refs AS ("
    + " UNION ALL ".join(f"SELECT stage_id, staged_at, '{f}' AS field, {_bare(f)} AS k FROM football_event_stage" for f in _REGISTRIES)
    + "), reg AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {_bare(key)} AS k, registered_at AS a, coalesce(removed_at, TIMESTAMPTZ '9999-01-01 00:00:00+00') AS b FROM {t}" for f, (t, key) in _REGISTRIES.items())
    + """), held AS (SELECT field, k, min(a) AS first FROM reg GROUP BY field, k),
    live AS (SELECT DISTINCT r.stage_id, r.field FROM refs r JOIN reg g ON r.field = g.field AND r.k = g.k AND g.a <= r.staged_at AND r.staged_at < g.b),
    found AS (
      SELECT r.stage_id, r.field, r.staged_at, CASE WHEN h.k IS NULL THEN 'missing' WHEN h.first > r.staged_at THEN 'late' ELSE 'deleted' END AS kind
      FROM refs r LEFT JOIN held h ON r.field = h.field AND r.k = h.k LEFT JOIN live l ON r.stage_id = l.stage_id AND r.field = l.field
      WHERE r.k <> '' AND l.stage_id IS NULL)"""
)

_P3 = """
WITH f AS (SELECT DISTINCT forecast_id, translate(lower(match_id), '{}- ', '') AS k, least(kickoff_at, coalesce(training_cutoff, kickoff_at)) AS moment FROM frozen_forecast),
r AS (SELECT DISTINCT revision_id, translate(lower(fixture_id), '{}- ', '') AS k, updated_at AS u, coalesce(known_at, updated_at) AS n FROM product_fixtures),
ranked AS (SELECT f.forecast_id, r.revision_id, row_number() OVER (PARTITION BY f.forecast_id ORDER BY r.u DESC, r.n DESC, r.revision_id DESC) AS i
           FROM f JOIN r ON f.k = r.k AND r.u <= f.moment AND r.n <= f.moment)
SELECT forecast_id, revision_id FROM ranked WHERE i = 1
"""

_CLOCK = """CASE WHEN regexp_full_match({0}, '[0-9]+:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?') THEN split_part({0}, ':', 1)::INT * 3600 + split_part({0}, ':', 2)::INT * 60 + floor(split_part({0}, ':', 3)::DOUBLE)::INT
 WHEN regexp_full_match({0}, '[0-9]+[+][0-9]+:[0-9]{{2}}([.][0-9]+)?') THEN (split_part({0}, '+', 1)::INT + split_part(split_part({0}, '+', 2), ':', 1)::INT) * 60 + floor(split_part({0}, ':', 2)::DOUBLE)::INT
 WHEN regexp_full_match({0}, '[0-9]+:[0-9]{{2}}([.][0-9]+)?') THEN split_part({0}, ':', 1)::INT * 60 + floor(split_part({0}, ':', 2)::DOUBLE)::INT END"""

_P5 = f"""
WITH ends AS (SELECT DISTINCT match_id, period_end_seconds AS e FROM open_matches),
p AS (SELECT match_id, i AS n, [0, 2700, 5400, 6300][i] AS a, e[i] AS b,
        coalesce(list_sum([e[j] - [0, 2700, 5400, 6300][j] for j in range(1, i)]), 0) AS before
      FROM (SELECT match_id, e, unnest(range(1, len(e) + 1)) AS i FROM ends)),
tot AS (SELECT match_id, max(before + b - a) AS total FROM p GROUP BY match_id),
s AS (SELECT lineup_id, match_id, player_id, {_CLOCK.format("from_clock")} AS f, {_CLOCK.format("to_clock")} AS t, from_period, to_period FROM lineups),
s2 AS (SELECT s.*, coalesce(from_period, (SELECT CASE WHEN count(*) = 1 THEN min(n) END FROM p WHERE p.match_id = s.match_id AND p.a <= s.f AND s.f < p.b)) AS fp FROM s),
x AS (SELECT s2.match_id, s2.player_id, pf.before + least(greatest(f, pf.a), pf.b) - pf.a AS st,
        CASE WHEN t IS NULL AND to_period IS NULL THEN total WHEN t IS NULL THEN pt.before + pt.b - pt.a ELSE pt.before + least(greatest(t, pt.a), pt.b) - pt.a END AS en
      FROM s2 JOIN tot USING (match_id) JOIN p pf ON pf.match_id = s2.match_id AND pf.n = s2.fp LEFT JOIN p pt ON pt.match_id = s2.match_id AND pt.n = s2.to_period),
y AS (SELECT *, max(en) OVER (PARTITION BY match_id, player_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT DISTINCT match_id, player_id, st, en FROM x) WHERE en > st),
z AS (SELECT *, sum(CASE WHEN seen IS NULL OR st > seen THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, player_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS g FROM y),
m AS (SELECT match_id, player_id, g, min(st) AS st, max(en) AS en FROM z GROUP BY ALL),
gaps AS (SELECT match_id, player_id, lag(en) OVER (PARTITION BY match_id, player_id ORDER BY g) AS st, st AS en FROM m)
SELECT match_id, player_id, 'period' AS kind, st::INT AS start_second, en::INT AS end_second FROM m
UNION ALL SELECT match_id, player_id, 'gap', st::INT, en::INT FROM gaps WHERE st IS NOT NULL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + " SELECT DISTINCT stage_id, field, kind FROM found",
        "p1_counts": _P1 + " SELECT field, kind, strftime(staged_at AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS orphans FROM found GROUP BY ALL",
        "p3_found": _P3,
        "p5_found": _P5,
    }
