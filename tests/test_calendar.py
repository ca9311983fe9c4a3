"""What was before a day, of teams and players, is as large as the calendar: games take it and are not shuffled for it."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from slatewise.operators import asof, players, predict
from slatewise.plans import queries as q
from slatewise.plans import research
from slatewise.sources.fixtures import frames


def some_games(spark, n=1500, seed=5):
    """Many games a day: days of one result and of both, ties, games to come, lines that lack a split."""
    rng = random.Random(seed)
    games, lines = [], []
    for g in rng.sample(range(10 * n), n):
        home, away = rng.sample(range(1, 5), 2)
        season, day = 2000 + rng.randrange(2), rng.randrange(60)
        final = rng.random() < 0.9
        score = [rng.choice((90, 100, 110)) if final else 0 for _ in "ha"]
        games.append((g, season, day + 10_957 + 366 * (season - 2000), home, away, *score, "Final" if final else "Scheduled"))
        for team in (home, away) if final else ():
            lines += [(g, season, games[-1][2], team, 5, 3, 10 + rng.randrange(9), None if rng.random() < 0.0005 else 2, 1, 4, 1200) for _ in range(rng.randrange(3))]
    game = spark.createDataFrame(games, "game_id long, season int, d int, home_team_id int, away_team_id int, home_score int, away_score int, status string")
    stat = spark.createDataFrame(lines, "game_id long, season int, d int, team_id int, rebounds int, assists int, fga int, oreb int, turnovers int, fta int, secs int")
    return [t.withColumn("date", F.date_from_unix_date("d")).drop("d") for t in (game, stat)], games, lines


def test_states_are_those_of_the_games_before(spark):
    (game, stat), games, lines = some_games(spark)
    sums = defaultdict(lambda: [0] * 6)
    for g, _, _, team, rebounds, assists, *_ in lines:
        for i, x in enumerate((rebounds, assists)):
            sums[g, team][i] += x
    played = defaultdict(list)
    for g, season, day, home, away, a, b, status in games:
        if status == "Final":
            played[season, home].append((day, g, a, b, a > b))
            played[season, away].append((day, g, b, a, b >= a))
    for scheduled in (False, True):
        got = {r.game_id: r for r in asof.game_context(game, stat, scheduled).collect()}
        seen = 0
        for g, season, day, home, away, _, _, status in games:
            sides = {s: sorted(p for p in played[season, t] if p[0] < day) for s, t in (("home", home), ("away", away))}
            if (status == "Scheduled") != scheduled or min(map(len, sides.values())) < asof.MIN_GAMES:
                assert g not in got
                continue
            seen += 1
            for s, before in sides.items():
                streak = 0
                for p in reversed(before):
                    if p[4] != before[-1][4]:
                        break
                    streak += 1 if p[4] else -1
                n, team, r = len(before), home if s == "home" else away, got[g]
                assert (r[f"{s}_gp"], r[f"{s}_wins"], r[f"{s}_losses"], r[f"{s}_streak"]) == (n, sum(p[4] for p in before), sum(not p[4] for p in before), streak)
                assert (r[f"{s}_ppg"], r[f"{s}_oppg"], r[f"{s}_reb_pg"]) == (sum(p[2] for p in before) / n, sum(p[3] for p in before) / n, sum(sums[p[1], team][0] for p in before) / n)
                assert (r[f"{s}_rest_days"], r[f"{s}_is_b2b"]) == (day - before[-1][0] - 1, day - before[-1][0] == 1)
        assert seen == len(got) > 50


def test_games_are_not_shuffled_for_their_context(spark):
    """Before, all sides of games went through windows."""
    (game, stat), _, _ = some_games(spark, 300)
    plan = asof.game_context(game, stat)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Window" not in plan


def test_wide_games_are_of_their_players(spark, sf_dir):
    """The sides of a game from its lines at once are those of a row of each player and game, which they no longer need."""
    fx = frames(spark, sf_dir)
    fx.kept.pop("players", None)
    fx.kept.pop("game_wide", None)
    wide = q.game_wide(fx)
    assert "players" not in fx.kept
    want = players.sides(players.player_context(fx.game, fx.stat, asof.game_context(fx.game, fx.stat)))
    got = wide.select(want.columns).where(" or ".join(f"{s}_top_ppg_player_id is not null" for s in ("home", "away")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 100


def test_explanations_take_no_row_of_an_outcome_along(spark, sf_dir):
    """games meet their lines, not each outcome that holds in them."""
    fx = frames(spark, sf_dir)
    names = fx.stat.select("player_id", F.concat(F.lit("N"), "player_id").alias("name")).distinct().where("player_id % 3 = 0")
    got = predict.explained_games(q.game_wide(fx), fx.stat, names)
    want = predict.explained(q.game_events(fx).where("kind = 'outcome'").select("game_id", F.col("event_key").alias("outcome")), q.game_wide(fx), fx.stat, names)
    key = lambda r: tuple(map(str, r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(game_id" not in plan[: plan.index("Generate")]


def test_settled_by_a_games_own_outcomes(spark, sf_dir):
    """what games have of their outcomes settles what fits them as their events do, without a row of an event and without a shuffle."""
    fx = frames(spark, sf_dir)
    best = q.best(fx).withColumn("outcome", F.regexp_replace("outcome", ":game", ":home"))
    got, want = predict.settled_hits(q.profiles(fx), best), predict.settled_hits(q.profiles(fx), best, q.game_events(fx))
    cols = ["game_id", "combo", "outcome", "result"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == want.select(cols).exceptAll(got.select(cols)).count() == 0 and want.where("not result").count() > 0
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()


def test_feed_meets_a_games_row_once(spark, sf_dir):
    """targets from a game's row are those of a join with a row of each top player."""
    fx = frames(spark, sf_dir)
    f, tops = predict.feed(research.feed_games(fx), q.best(fx)).select("game_id", "outcome"), research.slate_tops(fx)
    every = f.unionByName(q.slate_wide(fx).select("game_id", F.explode(F.array(*[F.lit(f"{s}_TOP_{w}_X:game") for s in ("HOME", "AWAY") for w in predict.TARGETS])).alias("outcome")))
    want = predict.with_targets(every, tops)
    got = predict.with_own_targets(every.join(q.slate_wide(fx).select("game_id", predict.game_tops().alias("tops")), "game_id", "left"), "tops").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.where("target_player is not null").count() > 10
