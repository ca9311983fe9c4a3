"""Every registered query against its SQL on the smallest tables, and boundary cases of the catalogs."""

from collections import Counter
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from slatewise import registry
from slatewise.functions import significance
from slatewise.operators import games, mining, night, predict
from slatewise.plans import queries as q
from slatewise.sources.fixtures import frames


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", registry.QUERIES)
def test_sql(spark, sf_dir, con, name):
    got, want = registry.QUERIES[name](spark, sf_dir), con.execute(registry.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall())


def test_every_query_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES)


def test_rare_events(spark, sf_dir):
    """Conditions and outcomes that never hold on the tables, at their bounds."""
    wide = q.game_wide(frames(spark, sf_dir))
    row = dict.fromkeys(wide.columns) | {"game_id": 1, "season": 1999, "home_ppg": 104.9, "away_ppg": 104.0, "home_rank_off": 26, "away_rank_off": 25, "home_rank_def": 30, "away_rank_def": 25, "spread_home": -10.5, "total_over": 0.0, "game_secs": 30001, "home_score": 1, "away_score": 1}
    got = lambda **other: {r.event_key for r in games.game_events(spark.createDataFrame([row | other], wide.schema)).collect()}
    assert {"BOTH_LOW_SCORING:game", "BOTTOM_5_OFF:home", "BOTTOM_5_DEF:home", "SPREAD_OVER_10:game", "OVERTIME:game"} <= got()
    assert not {"BOTTOM_5_OFF:away", "BOTTOM_5_DEF:away"} & got()
    assert not {"BOTH_LOW_SCORING:game", "SPREAD_OVER_10:game", "OVERTIME:game"} & got(home_ppg=105.0, spread_home=10.0, game_secs=30000)


def test_plans_stay_small(spark, sf_dir):
    """No query of mining, predictions or tests scans more than 40 times, however often its parts are used."""
    fx = frames(spark, sf_dir)
    for name in ("gc_go_all", "pm01_night_patterns", "pm13_game_patterns", "pm14_scored", "pr03_picks", "pr04_feed", "bt02_walk_forward", "bt05_leave_one_out"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") <= 40, name
    assert fx is frames(spark, sf_dir)


def test_catalog_sizes():
    assert len(night.CATALOG) == 60 and len(games.SIDE) + len(games.GAME) == 53 and len(games.CONDITIONS) == 87 and len(games.OUTCOMES) == 45


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_night_bounds(spark):
    """A date at, below and above thresholds; a date without stats or final games has only slate events."""
    games_ = [(1, "2000-01-01", 1999, 1, 2, 130, 129, "Final"), (2, "2000-01-01", 1999, 3, 4, 105, 130, "Final"), (3, "2000-01-02", 1999, 1, 2, 0, 0, "Scheduled")]
    g = spark.createDataFrame(games_, "game_id long, date string, season int, home_team_id int, away_team_id int, home_score int, away_score int, status string").withColumn("date", F.to_date("date"))
    s = spark.createDataFrame([(1, 7, 1, 30, 10, 10, 0, 0, 8, 2700, None, None, 10, 10), (1, 8, 1, 29, 9, 9, 5, 0, 7, 2699, 10, 20, 9, 9)], "game_id long, player_id int, team_id int, points int, rebounds int, assists int, steals int, blocks int, turnovers int, secs int, fg3m int, fg3a int, ftm int, fta int")
    s = s.withColumns({"date": F.to_date(F.lit("2000-01-01")), "season": F.lit(1999)})
    line = spark.createDataFrame([(1, 1.0, 259.0)], "game_id long, spread_home double, total_over double")
    got = Counter()
    for r in night.night_events(SimpleNamespace(game=g, stat=s, line=line)).collect():
        got.setdefault(str(r.date), set()).add(r.event_key)
    assert {"TWO_TEAMS_130_PLUS", "ANY_TEAM_130_PLUS", "ANY_GAME_TOTAL_250_PLUS", "TRIPLE_DOUBLE_EXISTS", "ANY_PLAYER_45_PLUS_MINUTES", "ANY_PLAYER_PERFECT_FT_10_PLUS", "ANY_PLAYER_10_PLUS_THREES", "ANY_PLAYER_5_PLUS_STEALS"} <= got["2000-01-01"]
    assert not {"TEAM_POINTS_GE_140", "TWO_30PT_SCORERS", "GAME_SPREAD_COVERED", "GAME_WENT_OVER", "NO_30PT_SCORER", "BLOWOUTS_25_PLUS_GE_2", "GAMES_DECIDED_BY_3_GE_2"} & got["2000-01-01"]
    assert got["2000-01-02"] == {"SLATE_GAMES_LE_4"}


def test_significance(spark):
    r = spark.range(1).select(significance.z_score(F.lit(60), F.lit(100)).alias("z"), significance.p_value(F.lit(1.96)).alias("p"), *[c.alias(n) for c, n in zip(significance.wilson(F.lit(60), F.lit(100)), "lh", strict=True)], significance.z_score(F.lit(0), F.lit(0)).alias("none")).first()
    assert abs(r.z - 1.5218) < 1e-3 and abs(r.p - 0.05) < 1e-3 and abs(r.l - 0.5020) < 1e-3 and abs(r.h - 0.6906) < 1e-3 and r.none == 0


def test_support_falls(spark):
    rows = [(u, 2000 + u % 2, k) for u in range(40) for k in "abcd" if (u * 7 + ord(k)) % 3]
    events = spark.createDataFrame(rows, "u int, season int, event_key string")
    got = Counter(r.combo for r in mining.combinations(events, "u", 3, 3).collect())
    own = {k: {u for u, _, x in rows if x == k} for k in "abcd"}
    from itertools import combinations

    want = {"+".join(c): len(set.intersection(*(own[k] for k in c))) for n in (1, 2, 3) for c in combinations("abcd", n)}
    assert got == {c: n for c, n in want.items() if n >= 3}


def test_explained(spark):
    """Each kind of outcome in one game: side's players, any player's first line, covers as either side sees them, lines with halves, nothing to say."""
    tops = {f"{s}_top_{a}_{c}": v for s, n in (("home", 0), ("away", 10)) for a, p in (("ppg", 1), ("rpg", 2), ("apg", 3)) for c, v in (("player_id", n + p), ("points", 20 + n + p), ("rebounds", n + p), ("assists", 2 * n + p))}
    wide = spark.createDataFrame([tuple([1, 100, 95, -3.5, 194.5, *tops.values()]), tuple([2, 90, 95, 4.0, 180.0, *[None] * len(tops)])], "game_id long, home_score int, away_score int, spread_home double, total_over double, " + ", ".join(f"{c} int" for c in tops))
    lines = spark.createDataFrame([(1, 9, 31, 10, 10, 1, 0, 7), (1, 4, 30, 2, 12, 1, 0, None), (1, 5, 41, 2, 2, 10, 0, 5), (2, 6, 3, 2, 2, 1, 1, 4)], "game_id long, player_id int, points int, rebounds int, assists int, steals int, blocks int, fg3m int")
    names = spark.createDataFrame([(4, "Ann Four"), (1, "Bo One")], "player_id int, name string")
    want = {
        (1, "HOME_TOP_SCORER_25_PLUS:game"): "Bo One, 21 pts", (1, "AWAY_TOP_REBOUNDER_EXCEEDS_AVG:game"): "Player 12, 12 reb", (1, "AWAY_TOP_ASSIST_8_PLUS:game"): "Player 13, 23 ast", (1, "HOME_TOP_SCORER_DOUBLE_DOUBLE:game"): "Bo One",
        (1, "PLAYER_30_PLUS:game"): "Ann Four, 30 pts", (1, "PLAYER_40_PLUS"): "Player 5, 41 pts", (1, "PLAYER_DOUBLE_DOUBLE:game"): "Ann Four", (1, "PLAYER_TRIPLE_DOUBLE:game"): "Player 9", (1, "PLAYER_10_PLUS_ASSISTS:game"): "Ann Four, 12 ast",
        (1, "PLAYER_10_PLUS_REBOUNDS:game"): "Player 9, 10 reb", (1, "PLAYER_5_PLUS_THREES:game"): "Player 5, 5 3PM", (1, "HOME_COVERED:game"): "margin +5 (spread: -3.5)", (2, "AWAY_COVERED:game"): "margin +5 (spread: -4)",
        (1, "OVER_HIT:game"): "195 total (line: 194.5)", (2, "OVER_HIT:game"): "185 total (line: 180)", (1, "FAVORITE_COVERED:game"): None, (1, "HOME_WIN:game"): None, (2, "HOME_TOP_SCORER_25_PLUS:game"): None, (2, "PLAYER_5_PLUS_THREES:game"): None, (3, "OVER_HIT:game"): None,
    }
    hits = spark.createDataFrame([(*k, 7) for k in want], "game_id long, outcome string, home_score int")
    got = predict.explained(hits, wide, lines, names)
    assert got.columns == [*hits.columns, "explanation"] and {(r.game_id, r.outcome): r.explanation for r in got.collect()} == want
    assert {r.explanation for r in predict.explained(hits, wide, lines).where("outcome = 'PLAYER_30_PLUS:game'").collect()} == {"Player 4, 30 pts"}
    assert predict.explained(hits.limit(0), wide, lines).count() == 0 and predict.explained(hits, wide.limit(0), lines.limit(0)).where("explanation is not null").count() == 0


def test_tables_follow_their_files(spark, sf_dir, tmp_path):
    """A folder whose files change within an application is derived anew; one left alone is not."""
    for t in ("region", "nation", "customer", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.limit(100).write.parquet(f"{tmp_path}/orders.parquet")
    first = frames(spark, str(tmp_path))
    assert first.game.count() == 100 and frames(spark, str(tmp_path)) is first
    orders.orderBy("o_orderkey").limit(7).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert frames(spark, str(tmp_path)).game.count() == 107 and first.game.count() == 100
