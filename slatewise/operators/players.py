"""Players as of a date: averages, ranks, form, and the best of either side of a game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.sources.kept import keep

#: Games and seconds a game a player needs for a rank.
MIN_GAMES, MIN_SECS = 10, 1200
TOTALS = ("points", "rebounds", "assists", "secs", "fg3m", "fg3a", "ftm", "fta")
#: Averages by name, each ranked league-wide and with the stat that it is the average of.
AVERAGES = {"ppg": "points", "rpg": "rebounds", "apg": "assists"}


def player_state(stat: DataFrame, days: DataFrame) -> DataFrame:
    """Per season, day of ``days`` (season, day) and player with games before it: latest team, games, averages, shares, ranks.

    A spine of days and players takes the daily sums; frames end a day before. Ranks are for players with
    MIN_GAMES games and MIN_SECS a game; ties go to the smaller player_id. A share without attempts is null."""
    daily = stat.groupBy("season", "player_id", "day").agg(F.count("*").alias("gp"), F.max_by("team_id", "game_id").alias("team_id"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in TOTALS])
    spine = days.join(stat.select("season", "player_id").distinct(), "season")
    before = Window.partitionBy("season", "player_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    sums = spine.join(daily, ["season", "player_id", "day"], "left").select("season", "day", "player_id", *[F.sum(F.coalesce(c, F.lit(0))).over(before).alias(c) for c in ("gp", *TOTALS)], F.max(F.when(F.col("team_id").isNotNull(), F.struct("day", "team_id"))).over(before)["team_id"].alias("team_id")).where("gp > 0")
    state = sums.select("season", "day", "player_id", "team_id", "gp", *[(F.col(c) / F.col("gp")).alias(a) for a, c in AVERAGES.items()], (F.col("secs") / F.col("gp") / 60).alias("mpg"), F.try_divide("fg3m", "fg3a").alias("fg3_pct"), F.try_divide("ftm", "fta").alias("ft_pct"), F.expr(f"gp >= {MIN_GAMES} and secs >= {MIN_SECS} * gp").alias("eligible"))
    on_day = Window.partitionBy("season", "day", "eligible")
    return state.select("*", *[F.when(F.col("eligible"), F.row_number().over(on_day.orderBy(F.desc(a), "player_id"))).alias(f"rank_{a}") for a in AVERAGES]).drop("eligible")


def last_five(stat: DataFrame) -> DataFrame:
    """(game_id, player_id, last5_ppg): mean points of the last five games before the game's date, null with fewer."""
    order = Window.partitionBy("season", "player_id").orderBy("day", "game_id")
    five = F.when(F.count("*").over(order.rowsBetween(-4, 0)) == 5, F.avg("points").over(order.rowsBetween(-4, 0)))
    before = Window.partitionBy("season", "player_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return stat.withColumn("five", five).select("game_id", "player_id", F.max(F.struct("day", "game_id", "five")).over(before)["five"].alias("last5_ppg"))


def player_context(game: DataFrame, stat: DataFrame, context: DataFrame) -> DataFrame:
    """One row per stat row of a game in ``context`` whose player has games before: state, opponent's rank, and the line itself."""
    day = F.datediff("date", F.lit("1990-01-01").cast("date"))
    days = game.where("status = 'Final'").select("season", day.alias("day")).distinct()
    stat = stat.withColumn("day", day)
    sides = context.select("game_id", "home_rank_def", "away_rank_def").join(game.select("game_id", "home_team_id"), "game_id")
    lines = stat.select("game_id", "season", "day", "player_id", "team_id", *AVERAGES.values()).join(sides, "game_id")
    at_home = F.col("team_id") == F.col("home_team_id")
    lines = lines.withColumn("home", at_home).withColumn("opp_rank_def", F.when(at_home, F.col("away_rank_def")).otherwise(F.col("home_rank_def"))).drop("home_rank_def", "away_rank_def", "home_team_id")
    return lines.join(player_state(stat, days).drop("team_id"), ["season", "day", "player_id"]).join(last_five(stat), ["game_id", "player_id"], "left")


def lines_sides() -> list[Column]:
    """The columns of SIDE_COLUMNS of home and away but ``weak_ppg`` as aggregates over a game's lines (home, player_id, gp, AVERAGES, their ranks and stats; gp null: none before): what ``best_of`` tells of either side."""
    out = []
    for side, own in (("home", F.col("home")), ("away", ~F.col("home"))):
        own = own & F.col("gp").isNotNull()
        out += [F.min(F.when(own, F.col(f"rank_{a}"))).alias(f"{side}_best_{a}") for a in AVERAGES]
        out += [F.max(F.when(own, F.struct(F.col(a).alias("key"), (-F.col("player_id")).alias("tie"), a, "player_id", *AVERAGES.values()))).alias(f"{side}_top_{a}") for a in AVERAGES]
    return out


def told_sides(rank_def: dict[str, Column]) -> list[Column]:
    """The columns of SIDE_COLUMNS of home and away from those of lines_sides; ``rank_def``: the defensive rank of each side's opponent."""
    weak = lambda side: F.when(rank_def[side] >= WEAK, F.col(f"{side}_best_ppg")).alias(f"{side}_weak_ppg")
    return [c for side in ("home", "away") for c in (*[F.col(f"{side}_best_{a}") for a in AVERAGES], weak(side), *[F.col(f"{side}_top_{a}")[c].alias(f"{side}_{n}") for n, (a, c) in TOP.items()])]


def slate_sides(game: DataFrame, stat: DataFrame, context: DataFrame) -> DataFrame:
    """``sides`` of slate_players without a row of each player and game: before its games a side's players depend on team and day alone, so
    their best are found once a team and day (as many as the calendar has, whatever the games), and each game takes those of its two teams."""
    day = F.datediff("date", F.lit("1990-01-01").cast("date"))
    stat = stat.withColumn("day", day)
    days = stat.select("season", "day").unionByName(game.where("status = 'Scheduled'").select("season", day.alias("day"))).distinct()
    state = player_state(stat, days).withColumns({"opp_rank_def": F.lit(WEAK), **{c: F.lit(None).cast("int") for c in AVERAGES.values()}})
    of_team = keep(best_of(state, ["season", "day", "team_id"]), "slate_teams")
    slate = context.select("game_id", "season", day.alias("day"), "home_rank_def", "away_rank_def").join(game.select("game_id", "home_team_id", "away_team_id"), "game_id")
    for name, other in (("home", "away"), ("away", "home")):
        own = of_team.select("season", "day", F.col("team_id").alias(f"{name}_team_id"), *[F.col(c).alias(f"{name}_{c}") for c in SIDE_COLUMNS])
        slate = slate.join(F.broadcast(own), ["season", "day", f"{name}_team_id"], "left").withColumn(f"{name}_weak_ppg", F.when(F.col(f"{other}_rank_def") >= WEAK, F.col(f"{name}_weak_ppg")))
    return slate.select("game_id", *[f"{s}_{c}" for s in ("home", "away") for c in SIDE_COLUMNS])


def slate_players(game: DataFrame, stat: DataFrame, context: DataFrame) -> DataFrame:
    """Per scheduled game in ``context`` every player whose latest team plays in it: state and opponent's rank; there are no lines yet."""
    day = F.datediff("date", F.lit("1990-01-01").cast("date"))
    stat = stat.withColumn("day", day)
    days = stat.select("season", "day").unionByName(game.where("status = 'Scheduled'").select("season", day.alias("day"))).distinct()
    teams = context.join(game.select("game_id", "home_team_id", "away_team_id"), "game_id").select("game_id", "season", day.alias("day"), F.expr("stack(2, home_team_id, true, away_rank_def, away_team_id, false, home_rank_def) as (team_id, home, opp_rank_def)"))
    return teams.join(player_state(stat, days), ["season", "day", "team_id"]).withColumns({c: F.lit(None).cast("int") for c in AVERAGES.values()})


#: The rank from which a defense is weak.
WEAK = 21
#: Of a side: best ranks, the best scorer's rank against a weak defense, and the lines of its top players.
BEST = {**{f"best_{a}": f"min(rank_{a})" for a in AVERAGES}, "weak_ppg": f"min(case when opp_rank_def >= {WEAK} then rank_ppg end)"}
TOP = {f"top_{a}_{c}": (a, c) for a in AVERAGES for c in (a, "player_id", "points", "rebounds", "assists")}
SIDE_COLUMNS = (*BEST, *TOP)
#: Of these what is known before a game.
SLATE_COLUMNS = (*BEST, *(f"top_{a}_{c}" for a in AVERAGES for c in (a, "player_id")))


def best_of(players: DataFrame, by: list[str]) -> DataFrame:
    """The columns of SIDE_COLUMNS of each group of ``players``. Of equal averages the smaller player_id is on top."""
    tops = [F.max(F.struct(F.col(a).alias("key"), (-F.col("player_id")).alias("tie"), a, "player_id", *AVERAGES.values())).alias(f"top_{a}") for a in AVERAGES]
    best = players.groupBy(*by).agg(*[F.expr(e).alias(n) for n, e in BEST.items()], *tops)
    return best.select(*by, *BEST, *[F.col(f"top_{a}")[c].alias(n) for n, (a, c) in TOP.items()])


def sides(players: DataFrame) -> DataFrame:
    """One row per game: the columns of SIDE_COLUMNS of home and away."""
    wide = best_of(players, ["game_id", "home"])
    side = lambda home, name: wide.where(F.col("home") == home).select("game_id", *[F.col(c).alias(f"{name}_{c}") for c in SIDE_COLUMNS])
    return side(True, "home").join(side(False, "away"), "game_id", "full")


_before = "window w as (partition by s.season, s.player_id order by s.day range between unbounded preceding and 1 preceding)"
PLAYER_SQL = {
    "ps": "select *, date_diff('day', date '1990-01-01', date) as day from fx_stat",
    "pdaily": "select season, player_id, day, count(*) gp, " + ", ".join(f"sum(coalesce({c}, 0)) {c}" for c in TOTALS) + " from ps group by all",
    "pspine": "select d.season, d.day, p.player_id from (select distinct season, day from tg) d join (select distinct season, player_id from ps) p on p.season = d.season",
    "psums": "select s.season, s.day, s.player_id, " + ", ".join(f"sum(coalesce({c}, 0)) over w {c}" for c in ("gp", *TOTALS)) + f" from pspine s left join pdaily d on d.season = s.season and d.player_id = s.player_id and d.day = s.day {_before}",
    "pstate": "select season, day, player_id, gp, " + ", ".join(f"{c} / gp {a}" for a, c in AVERAGES.items()) + f", secs / gp / 60 mpg, fg3m / nullif(fg3a, 0) fg3_pct, ftm / nullif(fta, 0) ft_pct, gp >= {MIN_GAMES} and secs >= {MIN_SECS} * gp eligible from psums where gp > 0",
    "pranks": "select *, " + ", ".join(f"case when eligible then row_number() over (partition by season, day, eligible order by {a} desc, player_id) end rank_{a}" for a in AVERAGES) + " from pstate",
    "pfive": "select *, case when count(*) over f = 5 then avg(points) over f end five from ps window f as (partition by season, player_id order by day, game_id rows between 4 preceding and current row)",
    "plast": f"select game_id, player_id, arg_max(five, day * 100000000 + game_id) over w last5_ppg from (select * from pfive) s {_before}",
    "pctx": "select p.game_id, p.season, p.player_id, p.team_id, p.points, p.rebounds, p.assists, p.team_id = g.home_team_id home, case when p.team_id = g.home_team_id then c.away_rank_def else c.home_rank_def end opp_rank_def, r.gp, r.ppg, r.rpg, r.apg, r.mpg, r.fg3_pct, r.ft_pct, r.rank_ppg, r.rank_rpg, r.rank_apg, l.last5_ppg"
    " from ps p join context c on c.game_id = p.game_id join fx_game g on g.game_id = p.game_id join pranks r on r.season = p.season and r.day = p.day and r.player_id = p.player_id left join plast l on l.game_id = p.game_id and l.player_id = p.player_id",
    "pnum": "select *, " + ", ".join(f"row_number() over (partition by game_id, home order by {a} desc, player_id) n_{a}" for a in AVERAGES) + " from pctx",
    "pbest": "select game_id, home, " + ", ".join(f"{e} {n}" for n, e in BEST.items()) + ", " + ", ".join(f"max(case when n_{a} = 1 then {c} end) {n}" for n, (a, c) in TOP.items()) + " from pnum group by game_id, home",
    "psides": "select game_id, " + ", ".join(f"max(case when home = {h} then {c} end) {s}_{c}" for s, h in (("home", "true"), ("away", "false")) for c in SIDE_COLUMNS) + " from pbest group by game_id",
}
_best = ", ".join(f"{e} {n}" for n, e in BEST.items())
#: The same for scheduled games, by joining each date with all lines before it.
SLATE_SQL = {
    "sl_sums": "select d.season, d.day, p.player_id, count(*) gp, arg_max(p.team_id, p.day * 100000000 + p.game_id) team_id, " + ", ".join(f"sum({c}) {c}" for c in ("points", "rebounds", "assists", "secs")) + " from (select distinct season, day from sl) d join ps p on p.season = d.season and p.day < d.day group by d.season, d.day, p.player_id",
    "sl_pstate": f"select season, day, player_id, team_id, gp, points / gp ppg, rebounds / gp rpg, assists / gp apg, gp >= {MIN_GAMES} and secs >= {MIN_SECS} * gp eligible from sl_sums",
    "sl_pranks": PLAYER_SQL["pranks"].replace("from pstate", "from sl_pstate"),
    "sl_players": "select c.game_id, h.home, case when h.home then c.away_rank_def else c.home_rank_def end opp_rank_def, r.* from sl_context c join sl_side h on h.game_id = c.game_id join sl_pranks r on r.season = h.season and r.day = h.day and r.team_id = h.team_id",
    "sl_num": "select *, " + ", ".join(f"row_number() over (partition by game_id, home order by {a} desc, player_id) n_{a}" for a in AVERAGES) + " from sl_players",
    "sl_best": f"select game_id, home, {_best}, " + ", ".join(f"max(case when n_{a} = 1 then {c} end) top_{a}_{c}" for a in AVERAGES for c in (a, "player_id")) + " from sl_num group by game_id, home",
    "sl_sides": "select game_id, " + ", ".join(f"max(case when home = {h} then {c} end) {s}_{c}" for s, h in (("home", "true"), ("away", "false")) for c in SLATE_COLUMNS) + " from sl_best group by game_id",
}
