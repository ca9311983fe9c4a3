"""As-of team features: everything strictly before a date, by cumulative windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.sources.kept import keep

#: Games a team must have played before it has a context.
MIN_GAMES = 10
#: What pace needs; a game whose lines lack a split leaves the team without pace for the rest of the season.
SPLITS = {"fga": "sum(fga)", "oreb": "sum(oreb)", "turnovers": "sum(turnovers)", "fta": "sum(fta)", "secs": "sum(secs)", "lacking": "max(case when fga is null or oreb is null then 1 else 0 end)"}
#: (fga - oreb + turnovers + 0.44 fta) * 48 / (secs / 60) * games, in whole numbers up to the division.
PACE = "case when lacking = 0 and secs > 0 then (100 * (fga - oreb + turnovers) + 44 * fta) * g * 288 / (secs * 10) end"


def team_days(game: DataFrame, stat: DataFrame) -> DataFrame:
    """(season, team_id, day): what the final games of a team's day add: games ``g``, won, scored, allowed, the sums of its players' lines (``stat``: those of
    final games), whether the last game was won, how many games at the day's end had the ``last`` result in a row, and whether all had.

    A tie counts as won by the road team. There are as many rows as the calendar has days of teams, whatever the games."""
    day, key = F.datediff("date", F.lit("1990-01-01").cast("date")).alias("day"), ["season", "team_id", "day"]
    sides = game.where("status = 'Final'").select("game_id", "season", day, F.expr("stack(2, home_team_id, home_score, away_score, true, away_team_id, away_score, home_score, false) as (team_id, scored, allowed, home)")).withColumn("won", F.expr("case when home then scored > allowed else scored >= allowed end"))
    last = lambda c: F.max(F.when(c, F.col("game_id")))
    won, lost = last(F.col("won")).alias("last_won"), last(~F.col("won")).alias("last_lost")
    scores = keep(sides.groupBy(*key).agg(F.count("*").alias("g"), F.count_if("won").alias("won"), F.sum("scored").alias("scored"), F.sum("allowed").alias("allowed"), won, lost), "team_days")
    # after the day's last game of the other result
    turns = scores.where("last_won is not null and last_lost is not null").select(*key, F.least("last_won", "last_lost").alias("turn"))
    ends = sides.select("game_id", *key).join(F.broadcast(turns), key).where("game_id > turn").groupBy(*key).agg(F.count("*").alias("ended"))
    lines = stat.groupBy("season", "team_id", day).agg(F.sum("rebounds").alias("rebounds"), F.sum("assists").alias("assists"), *[F.expr(e).alias(n) for n, e in SPLITS.items()])
    t = scores.join(lines, key, "left").fillna(0, ["rebounds", "assists", *SPLITS]).join(ends, key, "left")
    alike = F.col("last_won").isNull() | F.col("last_lost").isNull()
    return t.select(*key, "g", "won", "scored", "allowed", "rebounds", "assists", *SPLITS, F.coalesce(F.col("last_won") > F.col("last_lost"), F.col("last_lost").isNull()).alias("last"), F.coalesce("ended", "g").alias("ended"), alike.alias("alike"))


def team_states(games: DataFrame, days: DataFrame) -> DataFrame:
    """(season, day, team_id) and COLUMNS: the state of each team with MIN_GAMES games before a day of ``days`` (season, day): its games, averages, rest, streak and ranks.

    ``games``: see team_days. A spine of the season's days and teams takes the daily sums; frames end a day before, so that games of one date never see
    each other. Ties of ranks go to the smaller team_id."""
    order = Window.partitionBy("season", "team_id").orderBy("day")
    until, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    # a day of one result only goes on with the streak of the days before
    g = games.withColumn("run", F.sum(F.when(F.col("alike") & (F.col("last") == F.lag("last").over(order)), 0).otherwise(1)).over(until))
    in_run = F.sum("ended").over(Window.partitionBy("season", "team_id", "run").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumn("streak", F.when(F.col("last"), in_run).otherwise(-in_run).cast("int")).withColumn("played", F.col("day"))
    spine = days.distinct().join(games.select("season", "team_id").distinct(), "season")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(before).alias(c)
    t = spine.join(g, ["season", "team_id", "day"], "left").select("season", "day", "team_id", *[total(c) for c in ("g", "won", "scored", "allowed", "rebounds", "assists", *SPLITS)], F.max("played").over(before).alias("played"), F.last("streak", True).over(before).alias("streak"))
    per = lambda c: F.col(c) / F.col("g")
    t = t.where(F.col("g") >= MIN_GAMES).select(
        "season", "day", "team_id", F.col("g").alias("gp"), F.col("won").alias("wins"), (F.col("g") - F.col("won")).alias("losses"), per("scored").alias("ppg"), per("allowed").alias("oppg"), per("rebounds").alias("reb_pg"), per("assists").alias("ast_pg"),
        (F.col("day") - F.col("played") - 1).alias("rest_days"), "streak", F.expr(PACE).alias("pace"),
    )
    on_day = Window.partitionBy("season", "day")
    place = lambda *by: F.row_number().over(on_day.orderBy(*by, "team_id"))
    pace = F.col("pace")
    t = t.withColumns({"is_b2b": F.coalesce(F.col("rest_days") == 0, F.lit(False)), "rank_off": place(F.desc("ppg")), "rank_def": place("oppg"), "rank_pace": F.when(pace.isNotNull(), place(pace.desc_nulls_last()))})
    return t.select("season", "day", "team_id", *COLUMNS)


def head_to_head(game: DataFrame) -> DataFrame:
    """Per final game the earlier meetings of its two teams in the season, and how many of them the home side of the day won."""
    final = game.where("status = 'Final'").withColumn("day", F.datediff("date", F.lit("1990-01-01").cast("date")))
    before = Window.partitionBy("season", F.least("home_team_id", "away_team_id"), F.greatest("home_team_id", "away_team_id")).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return final.select("game_id", "season", F.count("*").over(before).alias("prior_meetings"), F.coalesce(F.sum((F.col("home_score") > F.col("away_score")).cast("int")).over(before), F.lit(0)).alias("prior_home_side_wins"))


#: The snapshot of a slate looks at so many latest games of a team, needs so many, and its form at so many.
SNAPSHOT, SNAPSHOT_LEAST, SNAPSHOT_FORM = 82, 5, 10


def snapshot(game: DataFrame, as_of: str) -> DataFrame:
    """Per team its latest SNAPSHOT completed games before ``as_of``, over all seasons: gp, wins, losses, ppg, oppg and
    ``form``, how many of the latest SNAPSHOT_FORM had the result of the last; teams with fewer than SNAPSHOT_LEAST are left out."""
    done = game.where((F.col("status") == "Final") & (F.col("home_score") > 0) & (F.col("date") < F.lit(as_of).cast("date")))
    sides = done.select("game_id", "date", F.expr("stack(2, home_team_id, home_score, away_score, away_team_id, away_score, home_score) as (team_id, scored, allowed)"))
    order = Window.partitionBy("team_id").orderBy(F.desc("date"), F.desc("game_id"))
    s = sides.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SNAPSHOT).withColumn("won", F.col("scored") > F.col("allowed"))
    s = s.withColumn("last_won", F.first("won").over(order))
    t = s.groupBy("team_id", "last_won").agg(F.count("*").alias("gp"), F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.avg("scored").alias("ppg"), F.avg("allowed").alias("oppg"), F.count_if((F.col("place") <= SNAPSHOT_FORM) & (F.col("won") == F.col("last_won"))).alias("form"))
    return t.where(F.col("gp") >= SNAPSHOT_LEAST).select("team_id", "gp", "wins", "losses", "ppg", "oppg", F.when(F.col("last_won"), F.col("form")).otherwise(-F.col("form")).alias("form"))


COLUMNS = ("gp", "wins", "losses", "ppg", "oppg", "reb_pg", "ast_pg", "rest_days", "is_b2b", "streak", "rank_off", "rank_def", "pace", "rank_pace")


def both_sides(games: DataFrame, states: DataFrame) -> DataFrame:
    """``games`` (season, date, home_team_id, away_team_id) whose teams both have a state (see team_states), with the columns of COLUMNS of home and away.

    States are as many as the calendar has days of teams, whatever the games, so games take theirs from a broadcast and are not shuffled."""
    g = games.withColumn("day", F.datediff("date", F.lit("1990-01-01").cast("date")))
    for side in ("home", "away"):
        own = F.broadcast(states.select("season", "day", F.col("team_id").alias(f"{side}_team_id"), *[F.col(c).alias(f"{side}_{c}") for c in COLUMNS]))
        g = g.join(own, ["season", "day", f"{side}_team_id"])
    return g.drop("day")


def states_of(game: DataFrame, stat: DataFrame, scheduled: bool = False) -> DataFrame:
    """``team_states`` of the days of final games, and of ``scheduled`` ones."""
    day = F.datediff("date", F.lit("1990-01-01").cast("date")).alias("day")
    games = keep(team_days(game, stat), "team_days")
    days = games.select("season", "day")
    return keep(team_states(games, days.unionByName(game.where("status = 'Scheduled'").select("season", day)) if scheduled else days), "team_states")


def game_context(game: DataFrame, stat: DataFrame, scheduled: bool = False) -> DataFrame:
    """One row per final (or ``scheduled``) game whose teams both have MIN_GAMES games before: the state of either side."""
    games = game.where(F.col("status") == ("Scheduled" if scheduled else "Final")).select("game_id", "season", "date", "home_team_id", "away_team_id")
    return both_sides(games, states_of(game, stat, scheduled)).select("game_id", "season", "date", *[f"{s}_{c}" for s in ("home", "away") for c in COLUMNS])


CONTEXT_SQL = {
    "side_sums": "select game_id, team_id, sum(rebounds) rebounds, sum(assists) assists, " + ", ".join(f"{e} {n}" for n, e in SPLITS.items()) + " from fx_stat group by game_id, team_id",
    "tg0": "select game_id, date, season, home_team_id team_id, home_score scored, away_score allowed, true home from fx_game where status = 'Final' union all select game_id, date, season, away_team_id, away_score, home_score, false from fx_game where status = 'Final'",
    "tg": "select t.*, coalesce(s.rebounds, 0) rebounds, coalesce(s.assists, 0) assists, " + "".join(f"coalesce(s.{c}, 0) {c}, " for c in SPLITS) + "date_diff('day', date '1990-01-01', t.date) as day, case when scored > allowed or (scored = allowed and not home) then 1 else 0 end won from tg0 t left join side_sums s on s.game_id = t.game_id and s.team_id = t.team_id",
    "tr": "select *, sum(case when won = lw then 0 else 1 end) over (partition by season, team_id order by day, game_id rows unbounded preceding) run from (select *, lag(won) over (partition by season, team_id order by day, game_id) lw from tg)",
    "ts": "select *, (case when won = 1 then 1 else -1 end) * row_number() over (partition by season, team_id, run order by day, game_id) streak_after from tr",
    "state": """select game_id, season, date, day, team_id, home, count(*) over w gp, coalesce(sum(won) over w, 0) wins, count(*) over w - coalesce(sum(won) over w, 0) losses, sum(scored) over w / nullif(count(*) over w, 0) ppg, sum(allowed) over w / nullif(count(*) over w, 0) oppg,
        sum(rebounds) over w / nullif(count(*) over w, 0) reb_pg, sum(assists) over w / nullif(count(*) over w, 0) ast_pg, day - max(day) over w - 1 rest_days, arg_max(streak_after, day * 100000000 + game_id) over w streak
        from ts window w as (partition by season, team_id order by day range between unbounded preceding and 1 preceding)""",
    "daily": "select season, team_id, day, count(*) g, " + ", ".join(f"sum({c}) {c}" for c in ("scored", "allowed", *SPLITS)) + " from tg group by all",
    "spine": "select d.season, d.day, t.team_id from (select distinct season, day from tg) d join (select distinct season, team_id from tg) t on t.season = d.season",
    "cum": "select s.season, s.day, s.team_id, sum(coalesce(g, 0)) over w g, " + ", ".join(f"sum(coalesce({c}, 0)) over w {c}" for c in ("scored", "allowed", *SPLITS)) + " from spine s left join daily d on d.season = s.season and d.team_id = s.team_id and d.day = s.day window w as (partition by s.season, s.team_id order by s.day range between unbounded preceding and 1 preceding)",
    "ranks": "select season, day, team_id, row_number() over (partition by season, day order by scored / g desc, team_id) rank_off, row_number() over (partition by season, day order by allowed / g, team_id) rank_def, pace, case when pace is not null then row_number() over (partition by season, day order by pace desc nulls last, team_id) end rank_pace from (select *, " + PACE + " pace from cum where g >= 10)",
    "ctx_side": "select s.*, coalesce(rest_days = 0, false) is_b2b, rank_off, rank_def, pace, rank_pace from state s left join ranks r on r.season = s.season and r.day = s.day and r.team_id = s.team_id where gp >= 10",
    "context": "select h.game_id, h.season, h.date, " + ", ".join(f"{a}.{c} {n}_{c}" for a, n in (("h", "home"), ("a", "away")) for c in COLUMNS) + " from ctx_side h join ctx_side a on a.game_id = h.game_id and h.home and not a.home",
}

_SUMS = ", ".join(f"{'max' if c == 'lacking' else 'sum'}({c}) {c}" for c in SPLITS)
#: The same for scheduled games, by joining each with all that lies before it.
SLATE_SQL = {
    "sl": "select *, date_diff('day', date '1990-01-01', date) as day from fx_game where status = 'Scheduled'",
    "sl_side": "select game_id, season, date, day, home_team_id team_id, true home from sl union all select game_id, season, date, day, away_team_id, false from sl",
    "sl_state": "select s.game_id, s.season, s.date, s.day, s.team_id, s.home, count(*) gp, sum(won) wins, count(*) - sum(won) losses, sum(scored) / count(*) ppg, sum(allowed) / count(*) oppg, sum(rebounds) / count(*) reb_pg, sum(assists) / count(*) ast_pg, s.day - max(t.day) - 1 rest_days, arg_max(streak_after, t.day * 100000000 + t.game_id) streak from sl_side s join ts t on t.season = s.season and t.team_id = s.team_id and t.day < s.day group by s.game_id, s.season, s.date, s.day, s.team_id, s.home having count(*) >= 10",
    "sl_cum": f"select d.season, d.day, t.team_id, count(*) g, sum(scored) scored, sum(allowed) allowed, {_SUMS} from (select distinct season, day from sl) d join tg t on t.season = d.season and t.day < d.day group by d.season, d.day, t.team_id having count(*) >= 10",
    "sl_ranks": CONTEXT_SQL["ranks"].replace("from cum", "from sl_cum"),
    "sl_ctx": "select s.*, coalesce(rest_days = 0, false) is_b2b, rank_off, rank_def, pace, rank_pace from sl_state s left join sl_ranks r on r.season = s.season and r.day = s.day and r.team_id = s.team_id",
    "sl_context": "select h.game_id, h.season, h.date, " + ", ".join(f"{a}.{c} {n}_{c}" for a, n in (("h", "home"), ("a", "away")) for c in COLUMNS) + " from sl_ctx h join sl_ctx a on a.game_id = h.game_id and h.home and not a.home",
}
