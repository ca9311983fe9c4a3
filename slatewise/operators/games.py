"""Game events: conditions known before a game, outcomes after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.operators import players
from slatewise.operators.asof import COLUMNS, SLATE_SQL, both_sides, game_context, states_of
from slatewise.sources.fixtures import Tables
from slatewise.sources.kept import keep

#: Conditions of one side; {me} and {opp} become home and away.
SIDE = {
    **{f"TOP_{n}_{k}": f"{{me}}_rank_{c} <= {n}" for n in (5, 10) for k, c in (("OFF", "off"), ("DEF", "def"))}, **{f"BOTTOM_{n}_{k}": f"{{me}}_rank_{c} >= {31 - n}" for n in (5, 10) for k, c in (("OFF", "off"), ("DEF", "def"))},
    "ON_B2B": "{me}_is_b2b", "RESTED_3_PLUS": "{me}_rest_days >= 3", "RESTED_4_PLUS": "{me}_rest_days >= 4", "REST_ADVANTAGE": "{me}_rest_days - {opp}_rest_days >= 2", "WINNING_RECORD": "{me}_wins > {me}_losses",
    **{f"WIN_STREAK_{n}": f"{{me}}_streak >= {n}" for n in (3, 5, 7)}, **{f"LOSING_STREAK_{n}": f"{{me}}_streak <= -{n}" for n in (3, 5, 7)},
    "WIN_PCT_OVER_600": "{me}_wins * 10 >= 6 * {me}_gp", "WIN_PCT_UNDER_400": "{me}_wins * 10 < 4 * {me}_gp", "WIN_PCT_OVER_700": "{me}_wins * 10 >= 7 * {me}_gp",
    "NET_RATING_PLUS_5": "{me}_ppg - {me}_oppg >= 5", "NET_RATING_MINUS_5": "{me}_ppg - {me}_oppg <= -5", "NET_RATING_PLUS_10": "{me}_ppg - {me}_oppg >= 10", "HIGH_SCORING": "{me}_ppg >= 115", "LOW_SCORING": "{me}_ppg < 105", "STINGY_DEF": "{me}_oppg < 108", "POROUS_DEF": "{me}_oppg >= 118",
    "HAS_TOP_5_SCORER": "{me}_best_ppg <= 5", "HAS_TOP_10_SCORER": "{me}_best_ppg <= 10", "HAS_TOP_5_REBOUNDER": "{me}_best_rpg <= 5", "HAS_TOP_10_REBOUNDER": "{me}_best_rpg <= 10", "HAS_TOP_10_PLAYMAKER": "{me}_best_apg <= 10",
}
#: A line of 0 counts as missing.
_spread, _line = "spread_home <> 0 and abs(spread_home)", "total_over <> 0 and total_over"
GAME = {
    "BOTH_ON_B2B": "home_is_b2b and away_is_b2b", "TOP_OFF_VS_BOTTOM_DEF": "(home_rank_off <= 10 and away_rank_def >= 21) or (away_rank_off <= 10 and home_rank_def >= 21)", "BOTH_TOP_10_OFF": "home_rank_off <= 10 and away_rank_off <= 10",
    "SPREAD_UNDER_3": f"{_spread} < 3", "SPREAD_3_TO_7": f"{_spread} between 3 and 7", "SPREAD_OVER_10": f"{_spread} > 10", "TOTAL_LINE_OVER_230": f"{_line} > 230", "TOTAL_LINE_OVER_235": f"{_line} > 235", "TOTAL_LINE_UNDER_210": f"{_line} < 210",
    "BIG_FAVORITE": "abs(home_wins * away_gp - away_wins * home_gp) * 10 >= 3 * home_gp * away_gp", "BOTH_HIGH_SCORING": "home_ppg >= 115 and away_ppg >= 115", "BOTH_LOW_SCORING": "home_ppg < 105 and away_ppg < 105", "BOTH_POROUS_DEF": "home_oppg >= 115 and away_oppg >= 115", "BOTH_STINGY_DEF": "home_oppg < 108 and away_oppg < 108",
    "BOTH_TOP_10_PACE": "home_rank_pace <= 10 and away_rank_pace <= 10", "BOTH_BOTTOM_10_PACE": "home_rank_pace >= 21 and away_rank_pace >= 21", "PACE_MISMATCH": "abs(home_rank_pace - away_rank_pace) >= 15",
    "STAR_MATCHUP": "home_best_ppg <= 10 and away_best_ppg <= 10", "TOP_5_SCORER_VS_BOTTOM_10_DEF": "least(home_weak_ppg, away_weak_ppg) <= 5",
}
_m, _t, _s = "(home_score - away_score)", "(home_score + away_score)", "spread_home <> 0 and"
OUTCOMES = {
    "HOME_COVERED": f"{_s} {_m} + spread_home > 0", "AWAY_COVERED": f"{_s} -{_m} - spread_home > 0", "FAVORITE_COVERED": f"{_s} case when spread_home < 0 then {_m} + spread_home > 0 else -{_m} - spread_home > 0 end", "UNDERDOG_COVERED": f"{_s} case when spread_home > 0 then {_m} + spread_home > 0 else -{_m} - spread_home > 0 end",
    "OVER_HIT": f"total_over <> 0 and {_t} > total_over", "UNDER_HIT": f"total_over <> 0 and {_t} < total_over", **{f"TOTAL_OVER_{n}": f"{_t} > {n}" for n in (220, 230, 240, 250)}, **{f"TOTAL_UNDER_{n}": f"{_t} < {n}" for n in (200, 210)},
    "HOME_WIN": f"{_m} > 0", "AWAY_WIN": f"{_m} < 0", "MARGIN_UNDER_5": f"abs({_m}) < 5", "MARGIN_UNDER_10": f"abs({_m}) < 10", "BLOWOUT_20_PLUS": f"abs({_m}) >= 20", "OVERTIME": "game_secs > 30000",
    "PLAYER_30_PLUS": "max_points >= 30", "PLAYER_40_PLUS": "max_points >= 40", "PLAYER_DOUBLE_DOUBLE": "max_tens >= 2", "PLAYER_TRIPLE_DOUBLE": "max_tens >= 3", "PLAYER_10_PLUS_ASSISTS": "max_assists >= 10", "PLAYER_10_PLUS_REBOUNDS": "max_rebounds >= 10", "PLAYER_5_PLUS_THREES": "max_threes >= 5",
}
#: The same for the top player of either side by each average: at least so much, and more than the own average before.
for _side in ("home", "away"):
    for _word, _avg, _stat, _bounds in (("SCORER", "ppg", "points", (25, 30)), ("REBOUNDER", "rpg", "rebounds", (10, 12)), ("ASSIST", "apg", "assists", (8, 10))):
        _name, _top = f"{_side.upper()}_TOP_{_word}", f"{_side}_top_{_avg}"
        OUTCOMES |= {f"{_name}_{n}_PLUS": f"{_top}_{_stat} >= {n}" for n in _bounds} | {f"{_name}_EXCEEDS_AVG": f"{_top}_{_avg} <> 0 and {_top}_{_stat} > {_top}_{_avg}"}
    OUTCOMES[f"{_side.upper()}_TOP_SCORER_DOUBLE_DOUBLE"] = " + ".join(f"case when {_side}_top_ppg_{c} >= 10 then 1 else 0 end" for c in ("points", "rebounds", "assists")) + " >= 2"
TENS = "case when points >= 10 then 1 else 0 end + case when rebounds >= 10 then 1 else 0 end + case when assists >= 10 then 1 else 0 end + case when steals >= 10 then 1 else 0 end + case when blocks >= 10 then 1 else 0 end"
BEST = {"game_secs": "sum(secs)", "max_points": "max(points)", "max_assists": "max(assists)", "max_rebounds": "max(rebounds)", "max_threes": "max(coalesce(fg3m, 0))", "max_tens": f"max({TENS})"}

CONDITIONS = {f"{k}:{me}": e.format(me=me, opp=opp) for k, e in SIDE.items() for me, opp in (("home", "away"), ("away", "home"))} | {f"{k}:game": e for k, e in GAME.items()}
KEYS = CONDITIONS | {f"{k}:game": e for k, e in OUTCOMES.items()}


#: Rows of player states (days of the calendar times players) up to which they are broadcast.
SENT = 2_000_000


def wide_games(fx: Tables) -> DataFrame:
    """One row per game with a context: the state of either side, its players, the score, the line and the game's best lines.

    Games meet their lines and odds by game_id, once; what was before a day, of teams and players, is as large as the calendar, whatever the games."""
    day = F.datediff("date", F.lit("1990-01-01").cast("date")).alias("day")
    state = keep(players.player_state(fx.stat.withColumn("day", day), fx.game.where("status = 'Final'").select("season", day).distinct()).select("season", "day", "player_id", "gp", *players.AVERAGES, *[f"rank_{a}" for a in players.AVERAGES]), "player_states")
    final = fx.game.where("status = 'Final'").select("game_id", "season", "date", "home_team_id", "away_team_id", "home_score", "away_score")
    lines = fx.stat.select("game_id", "player_id", "team_id", "points", "rebounds", "assists", "steals", "blocks", "secs", "fg3m")
    met = final.join(lines, "game_id", "left").withColumn("day", day).join(F.broadcast(state) if state.count() <= SENT else state, ["season", "day", "player_id"], "left").withColumn("home", F.col("team_id") == F.col("home_team_id"))
    one = met.groupBy(*final.columns).agg(*[F.expr(f"{e} filter (where player_id is not null)").alias(n) for n, e in BEST.items()], *players.lines_sides())
    wide = both_sides(one.join(fx.line, "game_id", "left"), fx.once("states", lambda fx: states_of(fx.game, fx.stat)))
    ranks = {"home": F.col("away_rank_def"), "away": F.col("home_rank_def")}
    return wide.select("game_id", "season", "date", *[f"{s}_{c}" for s in ("home", "away") for c in COLUMNS], *players.told_sides(ranks), "home_score", "away_score", "spread_home", "total_over", *BEST)


def wide_slate(fx: Tables) -> DataFrame:
    """The same of scheduled games with a context, as far as it is known before them."""
    context = fx.once("slate_context", lambda fx: game_context(fx.game, fx.stat, scheduled=True))
    return context.join(players.slate_sides(fx.game, fx.stat, context), "game_id", "left").join(fx.line, "game_id", "left")


def game_events(wide: DataFrame) -> DataFrame:
    """(game_id, season, event_key, kind) for every condition and outcome that holds in a game of ``wide``."""
    hits = F.array_compact(F.array(*[F.when(F.expr(e), F.struct(F.lit(k).alias("event_key"), F.lit("condition" if k in CONDITIONS else "outcome").alias("kind"))) for k, e in KEYS.items()]))
    return wide.select("game_id", "season", F.inline(hits))


def conditions(wide: DataFrame) -> DataFrame:
    """(game_id, season, date, event_key, kind): the conditions that hold in each game of ``wide``."""
    return wide.select("game_id", "season", "date", F.explode(F.array_compact(F.array(*[F.when(F.expr(e), F.lit(k)) for k, e in CONDITIONS.items()]))).alias("event_key"), F.lit("condition").alias("kind"))


EVENTS_SQL = players.PLAYER_SQL | {
    "best": "select game_id, " + ", ".join(f"{e} {n}" for n, e in BEST.items()) + " from fx_stat group by game_id",
    "wide": "select c.*, home_score, away_score, spread_home, total_over, game_secs, max_points, max_assists, max_rebounds, max_threes, max_tens, " + ", ".join(f"{s}_{c}" for s in ("home", "away") for c in players.SIDE_COLUMNS) + " from context c left join psides p on p.game_id = c.game_id join fx_game g on g.game_id = c.game_id left join fx_line l on l.game_id = c.game_id left join best b on b.game_id = c.game_id",
    "game_events": "select game_id, season, unnest(list_filter([" + ", ".join(f"case when {e} then '{k}' end" for k, e in KEYS.items()) + "], lambda x: x is not null)) event_key from wide",
}
SLATE_SQL = SLATE_SQL | players.SLATE_SQL | {
    "sl_wide": "select c.*, spread_home, total_over, " + ", ".join(f"{s}_{c}" for s in ("home", "away") for c in players.SLATE_COLUMNS) + " from sl_context c left join sl_sides p on p.game_id = c.game_id left join fx_line l on l.game_id = c.game_id",
    "sl_events": "select game_id, season, date, unnest(list_filter([" + ", ".join(f"case when {e} then '{k}' end" for k, e in CONDITIONS.items()) + "], lambda x: x is not null)) event_key from sl_wide",
}
