"""Night events: aggregates per date, a declarative catalog of predicates over them, coverage reports."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.sources.kept import keep

STATS = ("secs", "points", "assists", "rebounds", "steals", "blocks", "turnovers")
TENS = "(case when points >= 10 then 1 else 0 end + case when rebounds >= 10 then 1 else 0 end + case when assists >= 10 then 1 else 0 end + case when steals >= 10 then 1 else 0 end + case when blocks >= 10 then 1 else 0 end)"
TOTAL, MARGIN = "(home_score + away_score)", "(home_score - away_score)"

#: Measures by grain; aggregate expressions that every SQL reads alike. Scored games are the final ones.
GAME = {
    "n_games": "count(*)", "n_scored": "count(case when final then 1 end)", "home_wins": f"count(case when final and {MARGIN} > 0 then 1 end)", "road_wins": f"count(case when final and {MARGIN} < 0 then 1 end)",
    **{f"margin_le_{n}": f"count(case when final and abs({MARGIN}) <= {n} then 1 end)" for n in (3, 5)}, **{f"margin_ge_{n}": f"count(case when final and abs({MARGIN}) >= {n} then 1 end)" for n in (20, 25)},
    **{f"total_ge_{n}": f"count(case when final and {TOTAL} >= {n} then 1 end)" for n in (240, 250, 260, 270)}, "total_lt_190": f"count(case when final and {TOTAL} < 190 then 1 end)",
    "sum_total": f"sum(case when final then {TOTAL} else 0 end)", "min_margin": f"min(case when final then abs({MARGIN}) end)", "max_margin": f"max(case when final then abs({MARGIN}) end)",
    "both_110": "count(case when final and home_score >= 110 and away_score >= 110 then 1 end)", "covered": f"count(case when final and {MARGIN} > spread_home then 1 end)", "overs": f"count(case when final and {TOTAL} > total_over then 1 end)",
}
#: Tests of a team's score, of a player's line: a date counts the teams and the players with such a game.
SCORE_TESTS = {**{f"score_ge_{n}": f"score >= {n}" for n in (120, 130, 140)}, "score_lt_100": "score < 100"}
PLAYER_TESTS = {
    **{f"points_ge_{n}": f"points >= {n}" for n in (25, 30, 40, 50)}, "triple_doubles": f"{TENS} >= 3", "double_doubles": f"{TENS} >= 2",
    "assists_ge_15": "assists >= 15", "rebounds_ge_20": "rebounds >= 20", "turnovers_ge_8": "turnovers >= 8", "turnovers_ge_10": "turnovers >= 10", "steals_ge_5": "steals >= 5", "blocks_ge_5": "blocks >= 5",
    "line_25_10": "points >= 25 and (rebounds >= 10 or assists >= 10)", "minutes_ge_45": "secs >= 2700", "threes_ge_10": "coalesce(fg3m, 0) >= 10", "perfect_ft": "ftm >= 10 and ftm = fta",
}
TENFOLD = {"p20": "points >= 20", "p10": "points >= 10"}
_counts = lambda tests, who: {n: f"count(distinct case when {t} then {who} end)" for n, t in tests.items()}
SCORE, PLAYER = _counts(SCORE_TESTS, "team_id"), {"n_stats": "count(*)"} | _counts(PLAYER_TESTS, "player_id")
TEAM = {
    "team_tov_22": "count(case when turnovers >= 22 then 1 end)", **{f"team_reb_{n}": f"count(case when rebounds >= {n} then 1 end)" for n in (58, 60, 62)}, "team_ast_30": "count(case when assists >= 30 then 1 end)", "team_ast_35": "count(case when assists >= 35 then 1 end)",
    "team_blk_10": "count(case when blocks >= 10 then 1 end)", "team_blk_12": "count(case when blocks >= 12 then 1 end)", "team_stl_15": "count(case when steals >= 15 then 1 end)",
    "teams_3x20": "count(case when p20 >= 3 then 1 end)", "teams_6x10": "count(case when p10 >= 6 then 1 end)", "team_ft_60": "count(case when fta >= 10 and ftm * 1.0 / fta < 0.6 then 1 end)", "team_fg3_45": "count(case when fg3a >= 10 and fg3m * 1.0 / fg3a >= 0.45 then 1 end)",
}
TEAM_NIGHT = {
    **{s: f"sum(coalesce({s}, 0))" for s in STATS}, **_counts(TENFOLD, "player_id"), "ftm": "sum(case when ftm is not null and fta is not null then ftm end)", "fta": "sum(case when ftm is not null and fta is not null then fta end)",
    "fg3m": "sum(case when fg3m is not null and fg3a is not null then fg3m end)", "fg3a": "sum(case when fg3m is not null and fg3a is not null then fg3a end)",
}

#: Event keys with their predicates over the measures of a date.
CATALOG = {
    "SLATE_GAMES_GE_7": "n_games >= 7", "SLATE_GAMES_BETWEEN_5_6": "n_games in (5, 6)", "SLATE_GAMES_LE_4": "n_games between 1 and 4", "HOME_TEAMS_WIN_GE_5": "home_wins >= 5", "ROAD_TEAMS_WIN_GE_5": "road_wins >= 5",
    "GAMES_DECIDED_BY_5_GE_3": "margin_le_5 >= 3", "GAMES_DECIDED_BY_3_GE_2": "margin_le_3 >= 2", "ANY_TEAM_130_PLUS": "score_ge_130 > 0", "TWO_TEAMS_130_PLUS": "score_ge_130 >= 2", "TEAM_POINTS_GE_140": "score_ge_140 > 0",
    "AT_LEAST_4_TEAMS_120_PLUS": "score_ge_120 >= 4", "AT_LEAST_4_TEAMS_UNDER_100": "score_lt_100 >= 4", "NO_TEAM_120_PLUS": "n_scored > 0 and score_ge_120 = 0", "ANY_GAME_TOTAL_250_PLUS": "total_ge_250 > 0", "ANY_GAME_TOTAL_260_PLUS": "total_ge_260 > 0",
    "ANY_GAME_TOTAL_270_PLUS": "total_ge_270 > 0", "THREE_GAMES_TOTAL_240_PLUS": "total_ge_240 >= 3", "BLOWOUT_25_PLUS": "margin_ge_25 > 0", "BLOWOUTS_20_PLUS_GE_3": "margin_ge_20 >= 3", "BLOWOUTS_25_PLUS_GE_2": "margin_ge_25 >= 2",
    "TWO_30PT_SCORERS": "points_ge_30 >= 2", "PLAYER_40_PLUS_POINTS": "points_ge_40 > 0", "TWO_PLAYERS_40_PLUS": "points_ge_40 >= 2", "THREE_TEAMS_HAVE_3x20PT_SCORERS": "teams_3x20 >= 3", "TRIPLE_DOUBLE_EXISTS": "triple_doubles > 0",
    "ANY_PLAYER_15_PLUS_ASSISTS": "assists_ge_15 > 0", "ANY_PLAYER_20_PLUS_REBOUNDS": "rebounds_ge_20 > 0", "ANY_PLAYER_10_PLUS_TURNOVERS": "turnovers_ge_10 > 0", "TWO_PLAYERS_8_PLUS_TURNOVERS": "turnovers_ge_8 >= 2", "ANY_TEAM_TURNOVERS_GE_22": "team_tov_22 > 0",
    "TEAM_WITH_58_REBOUNDS": "team_reb_58 > 0", "TEAM_WITH_60_REBOUNDS": "team_reb_60 > 0", "TEAM_WITH_62_REBOUNDS": "team_reb_62 > 0", "TEAM_ASSISTS_GE_35": "team_ast_35 > 0", "TEAM_BLOCKS_GE_12": "team_blk_12 > 0", "TEAM_STEALS_GE_15": "team_stl_15 > 0",
    "TWO_TEAMS_BLOCKS_GE_10": "team_blk_10 >= 2", "SLATE_AVG_TOTAL_GE_225": "n_scored > 0 and sum_total >= 225 * n_scored", "SLATE_AVG_TOTAL_LE_205": "n_scored > 0 and sum_total <= 205 * n_scored", "DOUBLE_DOUBLE_GE_5": "double_doubles >= 5",
    "ANY_PLAYER_25_10_GAME": "line_25_10 > 0", "PLAYER_50_PLUS_POINTS": "points_ge_50 > 0", "NO_30PT_SCORER": "n_stats > 0 and points_ge_30 = 0", "FIVE_25PT_SCORERS": "points_ge_25 >= 5", "BOTH_TEAMS_110_PLUS_IN_GAME": "both_110 > 0",
    "ANY_GAME_TOTAL_UNDER_190": "total_lt_190 > 0", "ALL_GAMES_DECIDED_BY_10_PLUS": "n_scored > 0 and min_margin >= 10", "NO_BLOWOUT_15": "n_scored > 0 and max_margin <= 15", "TEAM_6_PLAYERS_DOUBLE_FIGURES": "teams_6x10 > 0",
    "MULTIPLE_TRIPLE_DOUBLES": "triple_doubles >= 2", "ANY_PLAYER_5_PLUS_STEALS": "steals_ge_5 > 0", "ANY_PLAYER_5_PLUS_BLOCKS": "blocks_ge_5 > 0", "TWO_TEAMS_ASSISTS_GE_30": "team_ast_30 >= 2", "ANY_PLAYER_45_PLUS_MINUTES": "minutes_ge_45 > 0",
    "ANY_PLAYER_10_PLUS_THREES": "threes_ge_10 > 0", "ANY_PLAYER_PERFECT_FT_10_PLUS": "perfect_ft > 0", "TEAM_FT_PCT_UNDER_60": "team_ft_60 > 0", "TEAM_3PT_PCT_GE_45": "team_fg3_45 > 0", "GAME_SPREAD_COVERED": "covered > 0", "GAME_WENT_OVER": "overs > 0",
}
INFRA = {"NIGHT_PROCESSED": "true", "SCORES_PRESENT": "true", "STATS_PRESENT": "n_stats > 0", "AGGREGATES_PRESENT": "n_stats > 0", "AGGREGATES_MISSING": "n_stats = 0"}


def _agg(df: DataFrame, by: list[str], measures: dict[str, str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.expr(e).alias(n) for n, e in measures.items()])


def counted(df: DataFrame, by: list[str], who: str, tests: dict[str, str], sums: dict[str, str]) -> DataFrame:
    """Per group of ``by`` how many ``who`` pass each test with any of their rows, and ``sums`` (sum or count) over all rows.

    A row per group and ``who`` comes first, with the largest outcome of each test: two plain aggregations in place
    of one distinct count for each test, which would copy every row as often."""
    each = df.groupBy(*by, who).agg(*[F.expr(e).alias(n) for n, e in sums.items()], *[F.max(F.expr(f"case when {t} then 1 else 0 end")).alias(n) for n, t in tests.items()])
    return each.groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums], *[F.coalesce(F.sum(F.when(F.col(who).isNotNull(), F.col(n))), F.lit(0)).alias(n) for n in tests])


def team_night(stat: DataFrame) -> DataFrame:
    """Sums of the stats of each team on each date, nulls as 0, and its players in double figures."""
    return counted(stat, ["date", "season", "team_id"], "player_id", TENFOLD, {n: e for n, e in TEAM_NIGHT.items() if n not in TENFOLD})


def night_measures(fx: SimpleNamespace) -> DataFrame:
    """One row per date with every measure the catalog needs: four aggregations that meet on date."""
    games = fx.game.join(fx.line, "game_id", "left").withColumn("final", F.expr("status = 'Final'"))
    sides = fx.game.where("status = 'Final'").select("date", F.expr("stack(2, home_team_id, home_score, away_team_id, away_score) as (team_id, score)"))
    out = _agg(games, ["date", "season"], GAME)
    for df in (counted(sides, ["date"], "team_id", SCORE_TESTS, {}), counted(fx.stat, ["date"], "player_id", PLAYER_TESTS, {"n_stats": "count(*)"}), _agg(team_night(fx.stat), ["date"], TEAM)):
        out = out.join(df, "date", "left")
    counts = [c for m in (SCORE, PLAYER, TEAM) for c in m]
    return out.fillna(0, counts)


def night_events(fx: SimpleNamespace, infra: bool = False) -> DataFrame:
    """(date, season, event_key) where a predicate of the catalog holds; infra events on demand."""
    return events_of(night_measures(fx), infra)


def events_of(measures: DataFrame, infra: bool = False) -> DataFrame:
    keys = CATALOG | INFRA if infra else CATALOG
    hits = F.array_compact(F.array(*[F.when(F.expr(e), F.lit(k)) for k, e in keys.items()]))
    return measures.select("date", "season", F.explode(hits).alias("event_key"))


def summary(measures: DataFrame, events: DataFrame) -> DataFrame:
    """Per date its games, scored games and lines, and how many events of the catalog hold."""
    return measures.select("date", "season", "n_games", "n_scored", "n_stats").join(events.groupBy("date").agg(F.count("*").alias("n_events")), "date", "left").fillna(0, ["n_events"])


#: The logic of catalog and measures; it rises when either changes, and nights of an older one are taken up anew.
LOGIC_VERSION = 1


def nights(fx: SimpleNamespace) -> dict[str, DataFrame]:
    """What is stored of the dates of ``fx`` (game, stat, line), each table by date: team nights, night events and summaries with the version of the logic."""
    measures = keep(night_measures(fx), "night_measures")
    events = keep(events_of(measures), "night_events")
    return {"team_nights": keep(team_night(fx.stat), "team_nights"), "night_events": events, "night_summary": summary(measures, events).withColumn("logic_version", F.lit(LOGIC_VERSION))}


def outdated(stored: DataFrame, game: DataFrame, version: int = LOGIC_VERSION) -> DataFrame:
    """Dates of ``game`` without a summary in ``stored`` (date, logic_version), or with one of an older version: those a rebuild takes up."""
    current = stored.where(F.col("logic_version") >= version).select("date")
    return game.select("date").distinct().join(current, "date", "left_anti")


#: What the reports that come with an event name: the teams, players or games that made it hold. An event of another kind names nobody.
WITNESS_TEAMS = {"ANY_TEAM_130_PLUS": ("side", "score >= 130"), "TWO_TEAMS_130_PLUS": ("side", "score >= 130"), "TEAM_POINTS_GE_140": ("side", "score >= 140"), "AT_LEAST_4_TEAMS_120_PLUS": ("side", "score >= 120"), "AT_LEAST_4_TEAMS_UNDER_100": ("side", "score < 100"),
    "ANY_TEAM_TURNOVERS_GE_22": ("team", "turnovers >= 22"), **{f"TEAM_WITH_{n}_REBOUNDS": ("team", f"rebounds >= {n}") for n in (58, 60, 62)}, "TEAM_ASSISTS_GE_35": ("team", "assists >= 35"), "TEAM_BLOCKS_GE_12": ("team", "blocks >= 12"), "TEAM_STEALS_GE_15": ("team", "steals >= 15"),
    "TWO_TEAMS_BLOCKS_GE_10": ("team", "blocks >= 10"), "TWO_TEAMS_ASSISTS_GE_30": ("team", "assists >= 30"), "THREE_TEAMS_HAVE_3x20PT_SCORERS": ("team", "p20 >= 3"), "TEAM_6_PLAYERS_DOUBLE_FIGURES": ("team", "p10 >= 6"),
    "TEAM_FT_PCT_UNDER_60": ("team", "fta >= 10 and ftm * 1.0 / fta < 0.6"), "TEAM_3PT_PCT_GE_45": ("team", "fg3a >= 10 and fg3m * 1.0 / fg3a >= 0.45")}
WITNESS_PLAYERS = {"TWO_30PT_SCORERS": "points >= 30", "PLAYER_40_PLUS_POINTS": "points >= 40", "TWO_PLAYERS_40_PLUS": "points >= 40", "PLAYER_50_PLUS_POINTS": "points >= 50", "FIVE_25PT_SCORERS": "points >= 25", "TRIPLE_DOUBLE_EXISTS": f"{TENS} >= 3", "MULTIPLE_TRIPLE_DOUBLES": f"{TENS} >= 3", "DOUBLE_DOUBLE_GE_5": f"{TENS} >= 2",
    "ANY_PLAYER_15_PLUS_ASSISTS": "assists >= 15", "ANY_PLAYER_20_PLUS_REBOUNDS": "rebounds >= 20", "ANY_PLAYER_10_PLUS_TURNOVERS": "turnovers >= 10", "TWO_PLAYERS_8_PLUS_TURNOVERS": "turnovers >= 8", "ANY_PLAYER_5_PLUS_STEALS": "steals >= 5", "ANY_PLAYER_5_PLUS_BLOCKS": "blocks >= 5",
    "ANY_PLAYER_25_10_GAME": PLAYER_TESTS["line_25_10"], "ANY_PLAYER_45_PLUS_MINUTES": "secs >= 2700", "ANY_PLAYER_10_PLUS_THREES": "coalesce(fg3m, 0) >= 10", "ANY_PLAYER_PERFECT_FT_10_PLUS": "ftm >= 10 and ftm = fta"}
WITNESS_GAMES = {"GAMES_DECIDED_BY_5_GE_3": f"abs({MARGIN}) <= 5", "GAMES_DECIDED_BY_3_GE_2": f"abs({MARGIN}) <= 3", **{f"ANY_GAME_TOTAL_{n}_PLUS": f"{TOTAL} >= {n}" for n in (250, 260, 270)}, "THREE_GAMES_TOTAL_240_PLUS": f"{TOTAL} >= 240", "ANY_GAME_TOTAL_UNDER_190": f"{TOTAL} < 190",
    "BLOWOUT_25_PLUS": f"abs({MARGIN}) >= 25", "BLOWOUTS_25_PLUS_GE_2": f"abs({MARGIN}) >= 25", "BLOWOUTS_20_PLUS_GE_3": f"abs({MARGIN}) >= 20", "BOTH_TEAMS_110_PLUS_IN_GAME": "home_score >= 110 and away_score >= 110", "GAME_SPREAD_COVERED": f"{MARGIN} > spread_home", "GAME_WENT_OVER": f"{TOTAL} > total_over"}


def event_meta(fx: SimpleNamespace, events: DataFrame) -> DataFrame:
    """(date, season, event_key, game_count, team_ids, player_ids, game_ids) of ``events``: the date's games, and who made the event hold, as
    sorted lists without repeats. Rows of each kind name the events that they pass; they meet the events once."""
    named = lambda df, tests, **ids: df.select("date", *[F.col(i).alias(n) if i else F.lit(None).cast("long").alias(n) for n, i in {"team_id": None, "player_id": None, "game_id": None, **ids}.items()], F.explode(F.array_compact(F.array(*[F.when(F.expr(t), F.lit(k)) for k, t in tests.items()]))).alias("event_key"))
    final = fx.game.where("status = 'Final'").join(fx.line, "game_id", "left")
    sides = final.select("date", "game_id", F.expr("stack(2, home_team_id, home_score, away_team_id, away_score) as (team_id, score)"))
    of = lambda kind: {k: t for k, (g, t) in WITNESS_TEAMS.items() if g == kind}
    games = named(final.withColumn("teams", F.explode(F.array("home_team_id", "away_team_id"))), WITNESS_GAMES, team_id="teams", game_id="game_id")
    seen = named(sides, of("side"), team_id="team_id", game_id="game_id").unionByName(named(team_night(fx.stat), of("team"), team_id="team_id")).unionByName(named(fx.stat, WITNESS_PLAYERS, team_id="team_id", player_id="player_id", game_id="game_id")).unionByName(games)
    who = seen.groupBy("date", "event_key").agg(*[F.array_sort(F.collect_set(F.col(f"{k}_id").cast("long"))).alias(f"{k}_ids") for k in ("team", "player", "game")])
    none = F.array().cast("array<bigint>")
    counts = fx.game.groupBy("date").agg(F.count("*").alias("game_count"))
    return events.join(counts, "date", "left").join(who, ["date", "event_key"], "left").select("date", "season", "event_key", "game_count", *[F.coalesce(f"{k}_ids", none).alias(f"{k}_ids") for k in ("team", "player", "game")])


def meta_sql() -> dict[str, str]:
    """Common table expressions after events_sql that end in event_meta; lists are comma-joined texts there."""
    rows = [f"select date, '{k}' event_key, team_id, null player_id, game_id from meta_sides where {t}" for k, (g, t) in WITNESS_TEAMS.items() if g == "side"] + [f"select date, '{k}', team_id, null, null from team_night where {t}" for k, (g, t) in WITNESS_TEAMS.items() if g == "team"]
    rows += [f"select date, '{k}', team_id, player_id, game_id from fx_stat where {t}" for k, t in WITNESS_PLAYERS.items()] + [f"select date, '{k}', unnest([home_team_id, away_team_id]), null, game_id from gl where final and {t}" for k, t in WITNESS_GAMES.items()]
    return {
        "meta_sides": "select date, game_id, home_team_id team_id, home_score score from fx_game where status = 'Final' union all select date, game_id, away_team_id, away_score from fx_game where status = 'Final'",
        "seen": " union all ".join(rows),
        "who": "select date, event_key, " + ", ".join(f"coalesce(array_to_string(list_sort(list_distinct(list({k}_id) filter (where {k}_id is not null))), ','), '') {k}_ids" for k in ("team", "player", "game")) + " from seen group by date, event_key",
        "event_meta": "select n.date, n.season, n.event_key, c.games game_count, " + ", ".join(f"coalesce({k}_ids, '') {k}_ids" for k in ("team", "player", "game")) + " from night_events n join (select date, count(*) games from fx_game group by date) c on c.date = n.date left join who w on w.date = n.date and w.event_key = n.event_key",
    }


def events_sql(infra: bool = False) -> dict[str, str]:
    """Common table expressions that end in night_events."""
    select = lambda by, m, src: f"select {by}, {', '.join(f'{e} as {n}' for n, e in m.items())} from {src} group by {by}"
    keys = CATALOG | INFRA if infra else CATALOG
    zero = ", ".join(f"coalesce({c}, 0) {c}" for m in (SCORE, PLAYER, TEAM) for c in m)
    return {
        "gl": "select g.*, g.status = 'Final' final, spread_home, total_over from fx_game g left join fx_line l on l.game_id = g.game_id", "team_night": select("date, season, team_id", TEAM_NIGHT, "fx_stat"),
        "sides": "select date, home_team_id team_id, home_score score from fx_game where status = 'Final' union all select date, away_team_id, away_score from fx_game where status = 'Final'",
        "mg": select("date, season", GAME, "gl"), "ms": select("date", SCORE, "sides"), "mp": select("date", PLAYER, "fx_stat"), "mt": select("date", TEAM, "team_night"),
        "measures": f"select mg.*, {zero} from mg left join ms on ms.date = mg.date left join mp on mp.date = mg.date left join mt on mt.date = mg.date",
        "night_events": " union all ".join(f"select date, season, '{k}' event_key from measures where {e}" for k, e in keys.items()),
    }
