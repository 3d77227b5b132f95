"""DuckDB SQL giving the results of the registered queries.

Written from the definitions, not from the Spark plans: range joins, OR joins,
plain ``row_number`` and ``string_agg`` where the library does otherwise.
"""

from __future__ import annotations

# The queries' parameters and the configuration, written down anew: a change in
# the library does not change what is expected of it.
SEASON, PLAYOFF, DAY = "season-97-98", "playoff-97-98", "1998-01-15"
WANTED = ("NATION_1", "NATION_2", "NATION_2", "NATION_0")
PLAYER = "Supplier#000000001"
INTERVAL = ("1998-04-20", "1998-06-20")
RESTART = "1998-07-01"
SERIES_LABELS = (
    "1. First round", "2. First round", "3. First round", "4. First round", "5. First round",
    "6. First round", "7. First round", "8. First round", "1. Conference semifinal",
    "2. Conference semifinal", "3. Conference semifinal", "4. Conference semifinal",
    "1. Conference final", "2. Conference final", "Final. ",
)
MARKERS = (
    ("season-95-96", "1995-10-28"), ("playoff-95-96", "1996-04-19"), ("summer-95-96", "1996-06-20"),
    ("season-96-97", "1996-10-28"), ("playoff-96-97", "1997-04-19"), ("summer-96-97", "1997-06-20"),
    ("season-97-98", "1997-10-28"), ("playoff-97-98", "1998-04-19"), ("summer-97-98", "1998-06-20"),
    ("season-98-99", "1998-10-28"), ("playoff-98-99", "1999-04-19"), ("summer-98-99", "1999-06-20"),
    ("season-99-00", "1999-10-28"), ("playoff-99-00", "2000-04-19"), ("summer-99-00", "2000-06-20"),
    ("season-00-01", "2000-10-28"), ("playoff-00-01", "2001-04-19"), ("summer-00-01", "2001-06-20"),
    ("season-01-02", "2001-10-28"),
)


def _values(rows) -> str:
    def literal(value):
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


_MARKERS = _values([(n, label, day) for n, (label, day) in enumerate(MARKERS)])
_LABELS = _values([(n, label) for n, label in enumerate(SERIES_LABELS, start=1)])
_WANTED = _values([(team,) for team in WANTED])

# CTEs, each with the names of those it needs.
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "calendar": ((), f"""
        SELECT ord, period, start_ts, end_ts FROM (
            SELECT ord, label AS period, closing AS start_ts,
                   lead(closing) OVER (ORDER BY ord) AS end_ts
            FROM (
                SELECT CAST(ord AS INTEGER) AS ord, label,
                       ((CAST(day AS TIMESTAMP) + INTERVAL 86399 SECOND)
                        AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS closing
                FROM (VALUES {_MARKERS}) AS m(ord, label, day)
            ) AS closings
        ) AS spans WHERE end_ts IS NOT NULL"""),
    "teams": ((), """
        SELECT n_name AS team,
               CASE WHEN n_regionkey IN (0, 1) THEN 'west' ELSE 'east' END AS conference
        FROM nation"""),
    "arenas": ((), """
        SELECT n_name AS team, 'Arena of ' || n_name AS arena FROM nation
        WHERE n_name <> 'NATION_0'"""),
    "scores": ((), """
        SELECT l_orderkey AS game_id,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS INTEGER) AS home_score,
               CAST(sum(CAST(floor(l_extendedprice) AS BIGINT) % 50 + 1) AS INTEGER) AS away_score,
               min(l_suppkey) AS suppkey
        FROM lineitem GROUP BY l_orderkey"""),
    "games": (("calendar", "scores"), """
        SELECT s.game_id, h.n_name AS home_team, a.n_name AS away_team, s.home_score,
               s.away_score, o.o_orderdate AS game_time,
               coalesce(c.period, 'unknown') AS period
        FROM scores s
        JOIN orders o ON o.o_orderkey = s.game_id
        JOIN customer k ON k.c_custkey = o.o_custkey
        JOIN supplier p ON p.s_suppkey = s.suppkey
        JOIN nation h ON h.n_nationkey = k.c_nationkey
        JOIN nation a ON a.n_nationkey = p.s_nationkey
        LEFT JOIN calendar c ON c.start_ts < o.o_orderdate AND o.o_orderdate < c.end_ts
        WHERE k.c_nationkey <> p.s_nationkey"""),
    "numbered": (("games",), """
        SELECT *, row_number() OVER (PARTITION BY home_team ORDER BY game_time, game_id)
                  AS seq_number
        FROM games"""),
    "journaled": (("games",), """
        SELECT *, row_number() OVER (PARTITION BY home_team ORDER BY game_id) AS seq_number
        FROM games"""),
    "stored_games": (("journaled",), """
        SELECT period, home_team, away_team, home_score, away_score, game_time,
               seq_number AS game_id
        FROM (
            SELECT *, row_number() OVER (PARTITION BY period, home_team, game_time
                                         ORDER BY game_id DESC) AS place
            FROM journaled
        ) AS versions WHERE place = 1"""),
    "flat_lines": (("calendar",), """
        SELECT coalesce(c.period, 'unknown') AS period, s.s_name AS name, n.n_name AS team,
               h.n_name AS opponent, o.o_orderdate AS time,
               CAST(l_quantity AS INTEGER) AS pts, l_linenumber AS offreb,
               CAST(round(l_tax * 100) AS INTEGER) AS defreb,
               l_linenumber + CAST(round(l_tax * 100) AS INTEGER) AS totalreb
        FROM lineitem l
        JOIN orders o ON o.o_orderkey = l.l_orderkey
        JOIN customer k ON k.c_custkey = o.o_custkey
        JOIN nation h ON h.n_nationkey = k.c_nationkey
        JOIN supplier s ON s.s_suppkey = l.l_suppkey
        JOIN nation n ON n.n_nationkey = s.s_nationkey
        LEFT JOIN calendar c ON c.start_ts < o.o_orderdate AND o.o_orderdate < c.end_ts"""),
    "box": (("numbered",), """
        SELECT g.*, x.place, 'Supplier#' || lpad(CAST(x.player AS VARCHAR), 9, '0') AS name,
               x.pts, x.offreb, x.defreb, x.offreb + x.defreb AS totalreb,
               CASE WHEN x.place % 2 = 1 THEN home_team ELSE away_team END AS team,
               CASE WHEN x.place % 2 = 1 THEN away_team ELSE home_team END AS opponent
        FROM (
            SELECT l_orderkey AS game_id, l_suppkey AS player,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS place,
                   CAST(sum(CAST(l_quantity AS BIGINT)) AS INTEGER) AS pts,
                   CAST(sum(l_linenumber) AS INTEGER) AS offreb,
                   CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS INTEGER) AS defreb
            FROM lineitem GROUP BY l_orderkey, l_suppkey
        ) x JOIN numbered g ON g.game_id = x.game_id"""),
    "instants": ((), """
        SELECT o_orderkey AS game_id,
               o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS event_ts
        FROM orders"""),
    "journal_sizes": (("games",), """
        SELECT home_team AS persistence_id, 2 * count(*) AS n FROM games GROUP BY home_team
        UNION ALL SELECT event_type, count(*) FROM events GROUP BY event_type"""),
    "games_in_interval": (("games",), f"""
        SELECT * FROM games WHERE game_time >= TIMESTAMP '{INTERVAL[0]}'
                              AND game_time < TIMESTAMP '{INTERVAL[1]}'"""),
}


def _with(needs: tuple[str, ...], body: str) -> str:
    """``body`` behind the CTEs it needs, in definition order."""
    wanted: set[str] = set()

    def visit(name: str) -> None:
        wanted.add(name)
        for other in _PARTS[name][0]:
            visit(other)

    for name in needs:
        visit(name)
    ctes = [f"{name} AS ({sql})" for name, (_, sql) in _PARTS.items() if name in wanted]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()


def _cut(total: str, count: str = "games") -> str:
    return f"CAST(CAST({total} * 100 // {count} AS BIGINT) / 100.0 AS DOUBLE)"


def _local(ts: str) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


def _standings(source: str, by: str = "") -> str:
    comma = f"{by}, " if by else ""
    return f"""
        SELECT {comma}conference, x.team, hw, hl, aw, al, w, l FROM (
            SELECT {comma}team,
                   count(*) FILTER (home AND won) AS hw, count(*) FILTER (home AND NOT won) AS hl,
                   count(*) FILTER (NOT home AND won) AS aw,
                   count(*) FILTER (NOT home AND NOT won) AS al,
                   count(*) FILTER (won) AS w, count(*) FILTER (NOT won) AS l
            FROM (
                SELECT {comma}home_team AS team, true AS home, home_score > away_score AS won
                FROM {source}
                UNION ALL
                SELECT {comma}away_team, false, home_score <= away_score FROM {source}
            ) AS sides GROUP BY {comma}team
        ) x JOIN teams t ON t.team = x.team"""


def _series(source: str, by: str = "") -> str:
    """Series per period, in the order they end; the first fifteen carry a label."""
    return f"""
        SELECT {by + ',' if by else ''} CAST(z.n AS INTEGER) AS n, stage,
               coalesce(stage || ' ', '') || opener || '  ' || games_text AS text
        FROM (
            SELECT *, row_number() OVER (
                PARTITION BY period ORDER BY last_time, first_team, second_team) AS n
            FROM (
                SELECT period, first_team, second_team, max(game_time) AS last_time,
                       arg_min(home_team || '-' || away_team, game_time) AS opener,
                       string_agg('[' || home_score || ':' || away_score || ' ' ||
                           CASE WHEN home_score > away_score THEN home_team ELSE away_team END
                           || ' won]', ', ' ORDER BY game_time) AS games_text
                FROM (
                    SELECT *, least(home_team, away_team) AS first_team,
                           greatest(home_team, away_team) AS second_team,
                           row_number() OVER (
                               PARTITION BY period, least(home_team, away_team),
                                            greatest(home_team, away_team), game_time
                               ORDER BY game_id DESC, home_team DESC) AS place
                    FROM {source}
                ) AS paired WHERE place = 1
                GROUP BY period, first_team, second_team
            ) AS series
        ) z LEFT JOIN (VALUES {_LABELS}) AS s(n, stage) ON s.n = z.n"""


_BOARDS = {
    "points": ("sum(pts) AS s_pts", "s_pts", [("pts", "s_pts")]),
    "rebounds": (
        "sum(offreb) AS s_off, sum(defreb) AS s_def, sum(totalreb) AS s_total", "s_total",
        [("offensive", "s_off"), ("defensive", "s_def"), ("total", "s_total")],
    ),
}


def _leaders(board: str, source: str, by: str = "", depth: int = 10) -> str:
    sums, ranked_by, shown = _BOARDS[board]
    comma = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    columns = ", ".join(f"{_cut(total)} AS {name}" for name, total in shown)
    return f"""
        SELECT {comma}CAST(rank AS INTEGER) AS rank, team, name AS player, {columns}, games
        FROM (
            SELECT *, row_number() OVER ({over} ORDER BY
                CAST({ranked_by} AS DOUBLE) / games DESC, name, team) AS rank
            FROM (
                SELECT {comma}name, team, {sums}, count(*) AS games
                FROM {source} GROUP BY {comma}name, team
            ) AS totals
        ) AS ranked WHERE rank <= {depth}"""


def _team_results(source: str, wanted: str, shown_time: str, by: str = "") -> str:
    return f"""
        SELECT {by + ',' if by else ''} g.away_team || ' @ ' || g.home_team AS lineup,
               g.away_score || ' : ' || g.home_score AS score,
               {shown_time} AS time, arena
        FROM {source} g
        JOIN {wanted} ON g.home_team = w.team OR g.away_team = w.team
        JOIN arenas a ON a.team = g.home_team"""


_REPORT_DAY = "strftime(game_time - INTERVAL 5 HOUR, '%Y-%m-%d')"
_REPORT_TIME = "strftime({ts} - INTERVAL 5 HOUR, '%d %b %Y %I:%M %p') || ' EST'"


def _daily(days: str, source: str = "games") -> str:
    """Games of local calendar days whose period is that of the day's midnight."""
    return f"""
        SELECT '  ' || away_team || ' @ ' || home_team || ' ' AS lineup,
               away_score || ':' || away_score || ' - ' || home_score || ':' || home_score AS score,
               strftime(d.day, '%Y-%m-%d') AS time,
               coalesce(a.arena, g.home_team || ' ') AS arena
        FROM {source} g
        JOIN ({days}) d ON CAST({_local('g.game_time')} AS DATE) = d.day
        JOIN calendar c ON c.period = g.period
            AND c.start_ts < (CAST(d.day AS TIMESTAMP) AT TIME ZONE 'America/New_York')
                             AT TIME ZONE 'UTC'
            AND (CAST(d.day AS TIMESTAMP) AT TIME ZONE 'America/New_York')
                AT TIME ZONE 'UTC' < c.end_ts
        LEFT JOIN arenas a ON a.team = g.home_team"""


_RESULT = """
    period, home_team AS team, CAST(home_score AS VARCHAR) AS score_line, home_score AS score,
    away_team AS opponent, CAST(away_score AS VARCHAR) AS opponent_score_line,
    away_score AS opponent_score, game_time AS date, CAST({seq} AS BIGINT) AS seq_number"""
_DAILY = f"""
    period, home_team || ' - ' || away_team AS opponents,
    CAST(year({_local('game_time')}) AS INTEGER) AS year,
    CAST(month({_local('game_time')}) AS INTEGER) AS month,
    CAST(day({_local('game_time')}) AS INTEGER) AS day,
    home_score AS score, away_score AS guest_score,
    CAST(home_score AS VARCHAR) AS score_line, CAST(away_score AS VARCHAR) AS guest_score_line"""
_LINE = """
    period, name, 'G' AS pos, '' AS min, '' AS fgma, '' AS threepma, '' AS ftma,
    '' AS minusslashplus, offreb, defreb, totalreb, 0 AS ast, 0 AS pf, 0 AS steel, 0 AS to0,
    0 AS blockshoot, 0 AS ba, pts, team, opponent, game_time AS time"""
# Newest line of a key: by sequence, opponent and place in the box, home lines
# counted 0, 1, ... and away lines -1, -2, ...
def _latest_line(order: str) -> str:
    return f"""
    SELECT {_LINE} FROM (
        SELECT *, row_number() OVER (
            PARTITION BY period, game_time, name, team
            ORDER BY {order} DESC, opponent DESC, line_nr DESC) AS place_in_key
        FROM (
            SELECT *, CASE WHEN place % 2 = 1 THEN nth - 1 ELSE -nth END AS line_nr
            FROM (
                SELECT *, row_number() OVER (PARTITION BY game_id, place % 2 ORDER BY place) AS nth
                FROM box
            ) AS counted
        ) AS lines
    ) AS versions WHERE place_in_key = 1"""


def _latest_result(source: str) -> str:
    return f"""
    SELECT {_RESULT.format(seq='seq_number')} FROM (
        SELECT *, row_number() OVER (PARTITION BY period, home_team, game_time
                                     ORDER BY seq_number DESC) AS place
        FROM {source}
    ) AS versions WHERE place = 1"""


def _latest_daily(order: str, columns: str = "") -> str:
    return f"""
    SELECT {columns or _DAILY} FROM (
        SELECT *, row_number() OVER (
            PARTITION BY period, CAST({_local('game_time')} AS DATE), home_team, away_team
            ORDER BY {order} DESC) AS place
        FROM numbered
    ) AS versions WHERE place = 1"""


_LATEST_RESULT = _latest_result("numbered")
_LATEST_LINE = _latest_line("seq_number")
_GAME_LOG = """
    name, period, team, opponent AS "VS", time AS "DT", pts || ':00' AS "MIN",
    defreb AS "REB_DEF", offreb AS "REB_OFF", totalreb AS "REB_TOTAL",
    (pts // 2) || '-' || pts AS "FGM_A", '0-0' AS "PM3_A", '0-0' AS "FTM_A",
    offreb AS "ASSISTS", 1 AS "BL", defreb AS "STEEL", '+' || defreb AS "PLUS_MINUS",
    pts AS "PTS" """

_IN_SEASON = f"(SELECT * FROM games WHERE period = '{SEASON}')"
_IN_PLAYOFF = f"(SELECT * FROM games WHERE period = '{PLAYOFF}')"
_LINES_IN_SEASON = f"(SELECT * FROM flat_lines WHERE period = '{SEASON}') AS season"
_WANTED_LIST = f"(VALUES {_WANTED}) AS w(team)"
_DAY_LIST = f"SELECT DATE '{DAY}' AS day"
_ALL_DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders"
_JOURNAL_ADDRESSES = """
    SELECT home_team AS persistence_id, game_id FROM games
    UNION ALL SELECT home_team, game_id FROM games
    UNION ALL SELECT event_type, event_id FROM events"""

ORACLES: dict[str, str] = {
    "calendar": _with(("games",), """
        SELECT ord, c.period, start_ts, end_ts, count(game_id) AS games
        FROM calendar c LEFT JOIN games g ON g.period = c.period
        GROUP BY ord, c.period, start_ts, end_ts"""),
    "assign_period": _with(("instants", "calendar"), """
        SELECT game_id, event_ts, coalesce(period, 'unknown') AS period
        FROM instants LEFT JOIN calendar ON start_ts < event_ts AND event_ts < end_ts"""),
    "assign_period_overlapping": _with(("instants", "calendar"), """
        SELECT i.game_id, i.event_ts, coalesce((
            SELECT arg_min(period, ord) FROM (
                SELECT ord, period, start_ts, end_ts FROM calendar WHERE ord % 2 = 0
                UNION ALL
                SELECT DISTINCT CAST(100 + 12 * (year(o_orderdate) - 1990) + month(o_orderdate) - 1 AS INTEGER),
                       'month ' || strftime(o_orderdate, '%Y-%m'), CAST(date_trunc('month', o_orderdate) AS TIMESTAMP),
                       CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL 2 MONTH
                FROM orders WHERE month(o_orderdate) % 2 = 0
            ) AS every_interval WHERE start_ts < i.event_ts AND i.event_ts < end_ts), 'unknown') AS period
        FROM instants i"""),
    "assign_period_inline": _with(("instants", "calendar"), """
        SELECT game_id, event_ts, coalesce(period, 'unknown') AS period
        FROM instants LEFT JOIN calendar ON start_ts < event_ts AND event_ts < end_ts"""),
    "event_time_local": _with(("instants",), f"""
        SELECT game_id, local_ts, CAST(year(local_ts) AS INTEGER) AS year,
               CAST(month(local_ts) AS INTEGER) AS month, CAST(day(local_ts) AS INTEGER) AS day
        FROM (SELECT game_id, {_local('event_ts')} AS local_ts FROM instants) AS shifted"""),
    "format_event_time": _with(("instants",), f"""
        SELECT game_id, strftime(event_ts - INTERVAL 5 HOUR, '%Y-%m-%d') AS day,
               {_REPORT_TIME.format(ts='event_ts')} AS shown
        FROM instants"""),
    "truncate_decimals": """
        SELECT l_orderkey, l_linenumber,
               CAST(trunc(l_extendedprice / l_quantity * 100.0::DOUBLE) AS BIGINT)
                   / 100.0::DOUBLE AS per_unit
        FROM lineitem""",
    "journal_partition": """
        SELECT event_id, event_id // 5000000 AS partition_nr, event_id // 1000 AS small_partition_nr
        FROM events""",
    "decode_names": "SELECT p_partkey, p_name || ' & ' || p_brand AS name FROM part",
    "dim_teams": _with(("teams", "games"), """
        SELECT t.team, conference, count(game_id) AS hosted
        FROM teams t LEFT JOIN games g ON g.home_team = t.team GROUP BY t.team, conference"""),
    "dim_from_config": """
        SELECT c_name AS team, c_mktsegment AS conference FROM customer
        UNION ALL SELECT c_name || '/2', c_mktsegment FROM customer""",
    "unknown_teams": """
        SELECT c_custkey AS request, unnest([c_mktsegment, c_name]) AS team FROM customer""",
    "unknown_periods": _with(("calendar",), """
        SELECT * FROM (
            SELECT o_orderkey,
                   CASE WHEN month(o_orderdate) < 7 THEN 'season-' ELSE 'playoff-' END
                   || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || '-'
                   || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS period
            FROM orders
        ) AS labels WHERE period NOT IN (SELECT period FROM calendar)"""),
    "insert_if_absent": """
        SELECT n_name AS processor_id, min(c_mktsegment) AS description
        FROM customer JOIN nation ON n_nationkey = c_nationkey
        WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)
        GROUP BY n_name""",
    "filter_in_set": """
        SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
        WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""",
    "filter_interval": f"""
        SELECT o_orderkey AS game_id, o_orderdate AS game_time FROM orders
        WHERE o_orderdate >= TIMESTAMP '{INTERVAL[0]}' AND o_orderdate < TIMESTAMP '{INTERVAL[1]}'""",
    "journal_scan": _with(("games", "teams"), f"""
        SELECT persistence_id, game_id // 5000000 AS partition_nr, game_id, true AS has_event
        FROM ({_JOURNAL_ADDRESSES}) AS j
        WHERE persistence_id IN (SELECT team FROM teams)"""),
    "journal_scan_full": _with(("games",), f"""
        SELECT persistence_id, count(*) AS events FROM ({_JOURNAL_ADDRESSES}) AS j
        GROUP BY persistence_id"""),
    "journal_decode": _with(("games", "box"), """
        SELECT g.home_team AS persistence_id, g.game_id, g.game_time AS event_ts,
               g.home_team AS team_name, g.home_team, g.home_score, g.away_team, g.away_score,
               lines, pts
        FROM games g JOIN (
            SELECT game_id, CAST(count(*) AS INTEGER) AS lines, CAST(sum(pts) AS INTEGER) AS pts
            FROM box GROUP BY game_id
        ) b ON b.game_id = g.game_id
        UNION ALL
        SELECT home_team, game_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM games
        UNION ALL
        SELECT event_type, event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events"""),
    "drop_bad_events": _with(("games",), """
        SELECT home_team AS persistence_id, count(*) AS events FROM games GROUP BY home_team"""),
    "journal_after_position": _with(("numbered",), f"""
        SELECT home_team AS persistence_id, game_id, seq_number - 1 AS sequence_nr
        FROM numbered WHERE game_time >= TIMESTAMP '{RESTART}'"""),
    "journal_pruned_restart": _with(("journal_sizes",), """
        SELECT persistence_id, n * 2 // 3 AS first_nr, n - n * 2 // 3 AS events FROM journal_sizes"""),
    "journal_source_batch": _with(("journal_sizes",), """
        SELECT persistence_id, CAST(first AS BIGINT) AS first_nr, n - 1 AS last_nr, n - first AS events
        FROM (SELECT *, CASE WHEN persistence_id IN (SELECT n_name FROM nation) THEN 10 ELSE 0 END AS first
              FROM journal_sizes) AS sizes WHERE n > first"""),
    "resume_positions": _with(("numbered", "teams", "calendar"), f"""
        SELECT t.team, CAST(coalesce(max(newest), 0) AS BIGINT) AS position
        FROM teams t LEFT JOIN (
            SELECT team, period, arg_max(seq_number, date) AS newest
            FROM ({_LATEST_RESULT}) AS stored
            WHERE period IN (SELECT period FROM calendar)
            GROUP BY team, period
        ) r ON r.team = t.team GROUP BY t.team"""),
    "running_sequence": _with(
        ("numbered",), "SELECT home_team, game_id, seq_number FROM numbered"
    ),
    "event_to_result": _with(("games",), f"SELECT {_RESULT.format(seq='game_id')} FROM games"),
    "event_to_daily": _with(("games",), f"SELECT {_DAILY} FROM games"),
    "box_lines": _with(("box",), f"SELECT {_LINE} FROM box"),
    "player_lines": _with(("box",), f"SELECT {_LINE} FROM box"),
    "journal_season_standings": _with(
        ("games_in_interval", "teams"), _standings("games_in_interval")
    ),
    "journal_playoff_series": _with(
        ("games_in_interval",),
        _series("(SELECT * REPLACE ('interval' AS period) FROM games_in_interval)"),
    ),
    "points_leaders_journal": _with(("box",), _leaders("points", f"""(
        SELECT * FROM box WHERE game_time >= TIMESTAMP '{INTERVAL[0]}'
                            AND game_time < TIMESTAMP '{INTERVAL[1]}') AS played""")),
    "journal_team_results": _with(
        ("games_in_interval", "arenas"),
        _team_results("games_in_interval", _WANTED_LIST, _REPORT_TIME.format(ts="game_time")),
    ),
    "scan_games": _with(("games",), """
        SELECT period, home_team, home_score, away_team, away_score, game_time, game_id FROM games
        WHERE home_team IN (SELECT n_name FROM nation WHERE n_regionkey IN (0, 1))"""),
    "scan_games_by_day": _with(("games",), """
        SELECT period, home_team, home_score, away_team, away_score, game_id,
               CAST(game_time - INTERVAL 5 HOUR AS DATE) AS game_day FROM games"""),
    "season_standings": _with(("games", "teams"), _standings(_IN_SEASON)),
    "season_standings_every_period": _with(("games", "teams"), _standings("games", "period")),
    "playoff_series": _with(("games",), _series(_IN_PLAYOFF)),
    "playoff_series_every_period": _with(("games",), _series("games", "period")),
    "points_leaders": _with(("flat_lines",), _leaders("points", _LINES_IN_SEASON)),
    "points_leaders_every_period": _with(
        ("flat_lines",), _leaders("points", "flat_lines", "period")
    ),
    "rebound_leaders": _with(("flat_lines",), _leaders("rebounds", _LINES_IN_SEASON)),
    "rebound_leaders_every_period": _with(
        ("flat_lines",), _leaders("rebounds", "flat_lines", "period")
    ),
    "player_game_log": _with(("flat_lines",), f"SELECT {_GAME_LOG} FROM flat_lines"),
    "team_results": _with(
        ("games", "arenas"), _team_results(_IN_SEASON, _WANTED_LIST, _REPORT_DAY)
    ),
    "team_results_every_team": _with(
        ("games", "arenas", "teams"), _team_results("games", "teams w", _REPORT_DAY, "period")
    ),
    "daily_results": _with(("games", "arenas", "calendar"), _daily(_DAY_LIST)),
    "daily_results_every_day": _with(("games", "arenas", "calendar"), _daily(_ALL_DAYS)),
    "view_json_standing": _with(("games", "teams"), f"""
        SELECT CAST(json_object('team', team, 'hw', hw, 'hl', hl, 'aw', aw, 'al', al,
                                'w', w, 'l', l) AS VARCHAR) AS json
        FROM ({_standings('games', 'period')}) AS view"""),
    "view_json": _with(("games", "arenas", "teams"), f"""
        SELECT CAST(json_object('lineup', lineup, 'score', score, 'time', time, 'arena', arena)
                    AS VARCHAR) AS json
        FROM ({_team_results('games', 'teams w', _REPORT_DAY)}) AS view"""),
    "view_json_rebounds": _with(("flat_lines",), f"""
        SELECT CAST(json_object('team', team, 'player', player, 'offensive', offensive,
                                'defensive', defensive, 'total', total, 'games', games)
                    AS VARCHAR) AS json
        FROM ({_leaders('rebounds', 'flat_lines', 'period')}) AS view"""),
    "view_json_playoff": _with(("games",), f"""
        SELECT CAST(to_json(text) AS VARCHAR) AS json
        FROM ({_series('games', 'period')}) AS view"""),
    "view_json_player": _with(("flat_lines",), f"""
        SELECT CAST(json_object('VS', "VS", 'DT', {_REPORT_TIME.format(ts='"DT"')}, 'MIN', "MIN",
            'REB_DEF', "REB_DEF", 'REB_OFF', "REB_OFF", 'REB_TOTAL', "REB_TOTAL",
            'FGM_A', "FGM_A", 'PM3_A', "PM3_A", 'FTM_A', "FTM_A", 'ASSISTS', "ASSISTS",
            'BL', "BL", 'STEEL', "STEEL", 'PLUS_MINUS', "PLUS_MINUS", 'PTS', "PTS")
            AS VARCHAR) AS json
        FROM (SELECT {_GAME_LOG} FROM flat_lines) AS view"""),
    "sink_results_latest": _with(("numbered",), _LATEST_RESULT),
    "sink_leaders_latest": _with(("box",), _LATEST_LINE),
    "sink_players_latest": _with(("box",), _LATEST_LINE),
    "sink_daily_latest": _with(("numbered",), _latest_daily("seq_number")),
    "stream_running_sequence": _with(("journaled",), """
        SELECT home_team AS team, 2 * (seq_number - 1) AS journal_nr, seq_number FROM journaled"""),
    "stream_timed": _with(("journaled",), _latest_result("journaled")),
    "stream_supervised": _with(("journaled",), _latest_result("journaled")),
    "stream_late_rows": _with(("games",), """
        SELECT period, home_team AS team, game_time AS date, away_team AS opponent,
               home_score AS score, away_score AS opponent_score, row_number() OVER (
                   PARTITION BY home_team
                   ORDER BY game_id <= (SELECT CAST(floor(avg(o_orderkey)) AS BIGINT) FROM orders), game_id) AS seq_number
        FROM games"""),
    "merged_on_read": _with(("games",), _latest_result("(SELECT *, game_id AS seq_number FROM games)")),
    "view_size": _with(("flat_lines",), f"""
        SELECT 'points' AS view, count(*) AS size FROM ({_leaders('points', 'flat_lines', 'period')}) AS view"""),
    "teams_committed": """
        SELECT n_name AS processor_id, CASE WHEN n_regionkey >= 2 THEN 'second' ELSE 'first' END AS description
        FROM nation""",
    "stream_results": _with(("journaled",), _latest_result("journaled")),
    "stream_leaders": _with(("box",), _latest_line("game_id")),
    "stream_players": _with(("box",), _latest_line("game_id")),
    "stream_daily": _with(("numbered",), _latest_daily("game_id")),
    "stream_restart": _with(("games",), """
        SELECT period, home_team AS team, game_time AS date, away_team AS opponent,
               home_score AS score, away_score AS opponent_score,
               row_number() OVER (PARTITION BY home_team ORDER BY game_id % 2, game_id) AS seq_number
        FROM games"""),
    "compacted_results": _with(("journaled",), _latest_result("journaled")),
    "stored_standing": _with(("stored_games", "teams"), _standings(
        f"(SELECT * FROM stored_games WHERE period = '{SEASON}')")),
    "stored_series": _with(("stored_games",), _series(
        f"(SELECT * FROM stored_games WHERE period = '{PLAYOFF}')")),
    "stored_points": _with(("box",), _leaders("points", f"""(
        SELECT * FROM ({_latest_line('game_id')}) AS latest WHERE period = '{SEASON}') AS season""")),
    "stored_rebounds": _with(("box",), _leaders("rebounds", f"""(
        SELECT * FROM ({_latest_line('game_id')}) AS latest WHERE period = '{SEASON}') AS season""")),
    "stored_player": _with(("box",), f"""
        SELECT opponent AS "VS", time AS "DT", min AS "MIN", defreb AS "REB_DEF",
               offreb AS "REB_OFF", totalreb AS "REB_TOTAL", fgma AS "FGM_A", threepma AS "PM3_A",
               ftma AS "FTM_A", ast AS "ASSISTS", blockshoot AS "BL", steel AS "STEEL",
               minusslashplus AS "PLUS_MINUS", pts AS "PTS"
        FROM ({_latest_line('game_id')}) AS latest
        WHERE period = '{SEASON}' AND name = '{PLAYER}' AND team = '{WANTED[0]}'"""),
    "stored_results": _with(("stored_games", "arenas"), _team_results(
        f"(SELECT * FROM stored_games WHERE period = '{SEASON}')", _WANTED_LIST, _REPORT_DAY)),
    "stored_daily": _with(("numbered", "arenas", "calendar"), _daily(
        _DAY_LIST, f"({_latest_daily('game_id', '*')})")),
    "view_json_points": _with(("flat_lines",), f"""
        SELECT CAST(json_object('team', team, 'player', player, 'pts', pts, 'games', games)
                    AS VARCHAR) AS json
        FROM ({_leaders('points', 'flat_lines', 'period')}) AS view"""),
    "view_json_daily": _with(("games", "arenas", "calendar"), f"""
        SELECT CAST(json_object('lineup', lineup, 'score', score, 'time', time, 'arena', arena)
                    AS VARCHAR) AS json
        FROM ({_daily(_DAY_LIST)}) AS view"""),
    "dim_in_memory": _with(("teams", "games"), """
        SELECT t.team, conference, count(game_id) AS hosted
        FROM teams t LEFT JOIN games g ON g.home_team = t.team GROUP BY t.team, conference"""),
    "campaign_upsert": """
        SELECT n_name AS campaign_id, coalesce(min(c_mktsegment), 'first') AS description
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 7 = 0
        GROUP BY n_name""",
}
