"""Registered queries of reports, predictions and walk-forward tests, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatewise.operators import asof, backtest, games, mining, night, players, predict, reports
from slatewise.plans import queries as q
from slatewise.plans.queries import COUNTS, GAME_SQL, NIGHT_PATTERNS, NIGHT_SQL, register, totals_sql
from slatewise.sources import sinks
from slatewise.sources.fixtures import with_ctes

#: Six digits; what differs in the last bits doesn't tip a half that a value lies on.
r6 = lambda *names: [F.round(F.col(n) + 1e-11, 6).alias(n) for n in names]
sql6 = lambda *names: ", ".join(f"round({n} + 1e-11, 6) {n}" for n in names)

# ---- profiles and coverage
_per_game = "select team_id, game_id, " + ", ".join(f"sum({c}) {c}" for c in reports.COUNTED) + " from fx_stat group by team_id, game_id"
_over = (("points", 140), ("points", 120), ("assists", 35), ("blocks", 12), ("rebounds", 50))
register("ag06_team_profile", lambda fx: reports.team_profile(fx.game, fx.stat), with_ctes(
    "select coalesce(r.team_id, l.team_id) team_id, gp, " + ", ".join(f"{c}_pg" for c in reports.COUNTED) + ", " + ", ".join(f"{c}_{n}" for c, n in _over) + ", wins, losses, blowout_wins, blowout_losses from "
    "(select team_id, count(case when margin > 0 then 1 end) wins, count(case when margin < 0 then 1 end) losses, count(case when margin >= 20 then 1 end) blowout_wins, count(case when margin <= -20 then 1 end) blowout_losses from sm group by team_id) r full join "
    "(select team_id, count(*) gp, " + ", ".join(f"round(avg({c}), 4) {c}_pg" for c in reports.COUNTED) + ", " + ", ".join(f"count(case when {c} >= {n} then 1 end) {c}_{n}" for c, n in _over) + " from pg group by team_id) l on l.team_id = r.team_id",
    {"pg": _per_game, "sm": "select home_team_id team_id, home_score - away_score margin from fx_game where status = 'Final' union all select away_team_id, away_score - home_score from fx_game where status = 'Final'"}))
register("tk05_team_scorers", lambda fx: reports.top_scorers(fx.stat), with_ctes("select * from (select team_id, player_id, sum(points) points, count(*) games, row_number() over (partition by team_id order by sum(points) desc, player_id) place from fx_stat group by team_id, player_id) where place <= 10"))
register("ag05_best_games", lambda fx: reports.best_games(fx.stat), with_ctes("select * from (select *, row_number() over (partition by player_id, measure order by value desc, game_id) place from (" + " union all ".join(f"select player_id, game_id, '{m}' measure, {m} \"value\" from fx_stat" for m in ("points", "assists", "rebounds")) + ")) where place <= 5"))
register("ag05_minute_buckets", lambda fx: reports.minute_buckets(fx.stat), with_ctes("select player_id, count(*) games, " + ", ".join(f"count(case when secs >= {m * 60} then 1 end) games_{m}, round(avg(case when secs >= {m * 60} then 1 else 0 end) * 100, 4) pct_{m}" for m in (30, 35, 40)) + " from fx_stat group by player_id"))
register("ag12_leaders", lambda fx: reports.leaders(fx.game, fx.stat, 1996, "1997-06-01", 2), with_ctes(
    "select team_id, measure, player_id, games, round(mean, 6) mean from (select *, row_number() over (partition by team_id, measure order by round(mean, 9) desc, player_id) place from (" + " union all ".join(f"select team_id, player_id, games, '{m}' measure, {m} mean from pa" for m in ("points", "rebounds", "assists")) + ")) where place = 1",
    {"pa": "select s.team_id, player_id, count(*) games, avg(points) points, avg(rebounds) rebounds, avg(assists) assists from fx_stat s join fx_game g on g.game_id = s.game_id where g.season = 1996 and home_score > 0 and g.date < date '1997-06-01' group by s.team_id, player_id having count(*) >= 2"}))
register("ag08_event_coverage", lambda fx: reports.event_coverage(q.night_events(fx), q.night_measures(fx).select("date", "season")), with_ctes(
    "select event_key, total, round(total / nights, 6) rate, least, most, case when total = 0 then 'broken' when total / nights >= 0.8 then 'common' when least = 0 and seasons > 1 then 'gaps' else 'fine' end state from "
    "(select k.event_key, cast(sum(coalesce(h, 0)) as bigint) total, min(coalesce(h, 0)) least, max(coalesce(h, 0)) most, count(*) seasons from (select season, event_key from (select distinct season from measures) s, (select unnest([" + ", ".join(f"'{k}'" for k in night.CATALOG) + "]) event_key) e) k "
    "left join (select season, event_key, count(*) h from night_events group by all) n on n.season = k.season and n.event_key = k.event_key group by k.event_key), (select count(*) nights from measures)", NIGHT_SQL))  # fmt: skip
register("ag09_aggregate_coverage", lambda fx: reports.aggregate_coverage(fx.game, fx.stat, night.team_night(fx.stat).where("season <> 1995")), with_ctes(
    "select g.season, games, dates, coalesce(stat_games, 0) stat_games, coalesce(stat_dates, 0) stat_dates, coalesce(expected, 0) expected, coalesce(present, 0) present from (select season, count(*) games, count(distinct date) dates from fx_game where status = 'Final' group by season) g "
    "left join (select season, count(distinct game_id) stat_games, count(distinct date) stat_dates from fx_stat group by season) s on s.season = g.season left join (select season, count(*) expected, count(case when season <> 1995 then 1 end) present from (select distinct season, date, team_id from fx_stat) group by season) p on p.season = g.season"))  # fmt: skip
register("ag02_missing_aggregates", lambda fx: night.team_night(reports.missing_aggregates(fx.stat, night.team_night(fx.stat).where("season <> 1995"))).select("date", "season", "team_id", *night.STATS), with_ctes(f"select date, season, team_id, {', '.join(night.STATS)} from team_night where season = 1995", NIGHT_SQL))
register("ag13_split_status", lambda fx: reports.split_status(fx.stat), with_ctes("select season, count(*) as lines, count(case when fg3m is not null and fg3a is not null and ftm is not null and fta is not null and fga is not null and oreb is not null then 1 end) with_splits from fx_stat group by season"))
register("ag07_first_missing", lambda fx: reports.completeness(fx.game, fx.stat), with_ctes("select season, date, game_id from fx_game g where status = 'Final' and not exists (select 1 from fx_stat s where s.game_id = g.game_id) order by date, game_id limit 20"))
register("fl01_filtered_totals", lambda fx: reports.totals(reports.Filter(season=1996, side="home", date_from="1996-11-01", least_minutes=20).lines(fx.stat, fx.game)), with_ctes(f"select player_id, {', '.join(f'sum({s}) {s}' for s in night.STATS)}, count(distinct s.game_id) games from fx_stat s join fx_game g on g.game_id = s.game_id where s.season = 1996 and s.date >= date '1996-11-01' and s.team_id = g.home_team_id and secs >= 1200 group by player_id"))
register("wn13_snapshot", lambda fx: asof.snapshot(fx.game, "1999-01-01").select("team_id", "gp", "wins", "losses", *r6("ppg", "oppg"), "form"), with_ctes(
    "select team_id, count(*) gp, count(case when won then 1 end) wins, count(case when not won then 1 end) losses, round(avg(scored) + 1e-11, 6) ppg, round(avg(allowed) + 1e-11, 6) oppg, (case when max(case when place = 1 and won then 1 else 0 end) = 1 then 1 else -1 end) * count(case when place <= 10 and won = first_won then 1 end) form from "
    "(select *, first_value(won) over (partition by team_id order by place) first_won from (select *, scored > allowed won, row_number() over (partition by team_id order by date desc, game_id desc) place from (select game_id, date, home_team_id team_id, home_score scored, away_score allowed from fx_game where status = 'Final' and home_score > 0 union all select game_id, date, away_team_id, away_score, home_score from fx_game where status = 'Final' and home_score > 0) where date < date '1999-01-01') where place <= 82) group by team_id having count(*) >= 5"))  # fmt: skip

# ---- stored night patterns
seasons_of = lambda fx: mining.calendar(q.night_events(fx))
stored_dates = lambda fx: fx.once("stored_dates", lambda fx: reports.pattern_dates(q.stored(fx), seasons_of(fx)))
event_meta = lambda fx: fx.once("event_meta", lambda fx: night.event_meta(fx, q.night_events(fx)))
_text = lambda *names: [F.concat_ws(",", F.col(n).cast("array<string>")).alias(n) for n in names]
META = NIGHT_SQL | night.meta_sql()
_metas = ("team_ids", "player_ids", "game_ids")
register("ne_meta", lambda fx: event_meta(fx).select("date", "season", "event_key", "game_count", *_text(*_metas)), with_ctes("select date, season, event_key, game_count, team_ids, player_ids, game_ids from event_meta", META))

_inside = "season between 1995 and 1999"
_older = "10 * n_seasons + 10 / (1 + sd) - 15 * most / hits + coalesce(least(longest_gap / 30, 5.0), 0.0) - legs"
register("pm06_rerank", lambda fx: reports.reranked(q.stored(fx), seasons_of(fx)), with_ctes(
    f"""select combo, legs, hits, n_seasons, round(hits / n_seasons, 2) avg_hits, round(most / hits, 3) cluster_share, longest_gap, round({_older}, 4) older_score, round(st, 4) stability, round(ba, 4) balance, round(ra, 4) rarity, round(re, 4) recency, round(0.35 * st + 0.25 * ba + 0.25 * ra + 0.15 * re, 4) overall, first_hits
    from (select *, len(string_split(combo, '+')) legs, least(n_seasons / (select count(distinct season) from night_events where {_inside}), 1.0) st, 1 - most / hits ba, 1 - least(1.0, abs(hits / n_seasons - 2.5) / 3) ra, greatest(0.0, 1 - date_diff('day', last, date '2001-01-01') / 730) re
    from (select combo, sum(h) hits, count(*) n_seasons, max(h) most, max(d) last, max(gap) longest_gap, stddev_pop(h) sd, array_to_string(list_sort(flatten(list(ds)))[1:3], ',') first_hits from (select combo, season, count(*) h, max(date) d, max(gap) gap, list(cast(date as varchar)) ds from (select *, date_diff('day', lag(date) over (partition by combo order by date), date) gap from shits where {_inside}) group by combo, season) group by combo))
    order by overall desc, combo limit 25""", NIGHT_PATTERNS))  # fmt: skip
_counts = {"keys": "select combo, legs, hits, unnest(string_split(combo, '+')) k from stored"}
register("pm08_subsets", lambda fx: reports.subset_redundancy(q.stored(fx)), with_ctes("select a.combo, a.hits, b.combo part, b.hits part_hits, round(1 - a.hits / b.hits, 6) hit_reduction, 'FULLY_REDUNDANT' verdict from keys a join keys b on a.k = b.k and b.legs < a.legs group by a.combo, a.hits, b.combo, b.hits, b.legs having count(*) = b.legs", NIGHT_PATTERNS | _counts))
register("pm08_near_duplicates", lambda fx: reports.near_duplicates(stored_dates(fx)), with_ctes(
    "select legs, a, b, shared, round(shared / (x + y - shared), 6) likeness from (select p.legs, l.combo a, r.combo b, count(*) shared, max(p.hits) x, max(o.hits) y from shits l join shits r on l.date = r.date and l.combo < r.combo join stored p on p.combo = l.combo join stored o on o.combo = r.combo and o.legs = p.legs group by p.legs, l.combo, r.combo) where shared / (x + y - shared) >= 0.9", NIGHT_PATTERNS))
register("pm09_support", lambda fx: reports.support(q.stored(fx), q.night_measures(fx).agg(F.count("*").alias("n")).select("n").scalar()), with_ctes("select combo, hits, overall, round(hits / (select count(*) from measures), 6) \"support\" from stored order by overall desc, combo limit 10", NIGHT_PATTERNS))
register("pm05_pattern_hits", lambda fx: fx.once("pattern_hits", lambda fx: reports.pattern_hits(stored_dates(fx), event_meta(fx))).select("combo", "date", "season", "game_count", *_text("team_ids"), F.to_json(F.transform("metas", lambda m: F.concat_ws(";", m["event_key"], *[F.concat_ws(",", m[k].cast("array<string>")) for k in _metas]))).alias("metas")), with_ctes(
    "select combo, date, season, game_count, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(flatten(list(string_split(team_ids, ','))), lambda x: x <> ''), lambda x: x::bigint))), ','), '') team_ids, '[' || array_to_string(list_transform(list_sort(list(event_key || ';' || team_ids || ';' || player_ids || ';' || game_ids)), lambda x: '\"' || x || '\"'), ',') || ']' metas "
    "from (select h.combo, h.date, h.season, unnest(string_split(h.combo, '+')) k from shits h) h join (select date d, event_key, game_count, team_ids, player_ids, game_ids from event_meta) m on m.d = h.date and m.event_key = h.k group by combo, date, season, game_count", NIGHT_PATTERNS | night.meta_sql()))  # fmt: skip
register("fl04_listing", lambda fx: reports.listed(q.stored(fx), "turnover", 3).select("combo", "hits", "overall"), with_ctes("select combo, hits, overall from stored where combo ilike '%turnover%' and legs = 3 order by overall desc, combo limit 500", NIGHT_PATTERNS))
register("pm07_explain", lambda fx: stored_dates(fx).groupBy("combo", "season").agg(F.count("*").alias("hits"), F.min("date").alias("first"), F.max("date").alias("last")), with_ctes("select combo, season, count(*) hits, min(date) \"first\", max(date) \"last\" from shits group by combo, season", NIGHT_PATTERNS))
register("pm16_latest_hits", lambda fx: reports.latest_of(stored_dates(fx), ["combo"]).select("combo", "date", "place"), with_ctes("select * from (select combo, date, row_number() over (partition by combo order by date desc) place from shits) where place <= 50", NIGHT_PATTERNS))
register("pm11_watched", lambda fx: reports.watch_check(reports.watch_add(q.stored(fx).select("combo", F.lit(True).alias("enabled")).where("combo like '%SLATE%'"), q.stored(fx).where("combo like 'A%'")), q.night_events(fx), reports.recent_dates(fx.game), fx.stat), with_ctes(
    "select w.combo, d.date, (select count(*) from night_events n where n.date = d.date and list_contains(string_split(w.combo, '+'), n.event_key)) = w.legs hit, d.date in (select date from fx_stat) has_stats from stored w, (select distinct date from fx_game where status = 'Final' order by date desc limit 3) d where w.combo like '%SLATE%' or w.combo like 'A%'", NIGHT_PATTERNS))
register("pm12_stored_and_live", lambda fx: reports.stored_and_live(q.night_events(fx).where("season <> 1997 or event_key not like 'ANY_%'"), q.night_events(fx)), with_ctes("select date, event_key, not (season = 1997 and event_key like 'ANY\\_%' escape '\\') as stored, true as live, (season = 1997 and event_key like 'ANY\\_%' escape '\\') as mismatch from night_events", NIGHT_SQL))

# ---- game patterns and games to come
SLATE = GAME_SQL | games.SLATE_SQL
_combo = lambda: mining.combo_name(mining.CONDITION_KEYS).alias("combo")
register("wn12_slate_conditions", lambda fx: games.conditions(q.slate_wide(fx)).select("game_id", "season", "event_key"), with_ctes("select game_id, season, event_key from sl_events", SLATE))
_day = "date '2001-01-01'"
KEPT = GAME_SQL | COUNTS | {
    "kept": "select * from (" + totals_sql("counts", "combo") + ') where hits / "sample" - 0.524 >= 0.02 and most / "sample" <= 0.85',
    "latest": "select combo, outcome, max(date) last from (" + " union all ".join(f"select combo, outcome, date from g{n} join (select game_id, date from fx_game where date_diff('day', date, {_day}) between 0 and 89) d using (game_id) join outcomes using (game_id)" for n in (1, 2, 3, 4)) + ") group by combo, outcome",
    "scored": f"""select {q._name(mining.CONDITION_KEYS)} as \"name\", combo, outcome, "sample", hits, n_seasons, hits / "sample" hit_rate, hits / "sample" - 0.524e0 edge, round((hits / "sample" - 0.524e0) * sqrt("sample"), 9) "value",
        round(least(0.4e0 * "sample" / (select max("sample") from kept) + 0.3e0 * n_seasons / (select count(distinct season) from game_events) + 0.3e0 * (1 - most / "sample") + coalesce(0.05e0 * (1 - date_diff('day', last, {_day}) / 90), 0), 1.0), 9) confidence from kept left join latest using (combo, outcome)""".replace('\"name\"', '"name"'),
}
register("pm14_scored", lambda fx: q.scored(fx).select(_combo(), "outcome", "sample", "hits", "n_seasons", *r6("hit_rate", "edge", "confidence", "value")), with_ctes("select \"name\" combo, outcome, \"sample\", hits, n_seasons, " + sql6("hit_rate", "edge", "confidence") + ", round(\"value\" + 1e-11, 6) \"value\" from scored", KEPT))
_pool = lambda src, at: f"select f.game_id, f.date, f.season, p.* exclude (combo) from (select e.game_id, {at}.date, {at}.season, t.combo from {src} e join (select combo, unnest(string_split(\"name\", '+')) k, len(string_split(\"name\", '+')) legs from (select distinct combo, \"name\" from best_patterns)) t on t.k = e.event_key{' join fx_game g on g.game_id = e.game_id' if at == 'g' else ''} group by all having count(*) = any_value(t.legs)) f join best_patterns p on p.combo = f.combo"
MET = KEPT | games.SLATE_SQL | {
    "best_patterns": 'select * from scored order by confidence desc, "value" desc, "name", outcome limit 2000',
    "met": _pool("sl_events", "e").replace("group by all", "group by e.game_id, e.date, e.season, t.combo"),
    "best_hits": "select m.\"name\", m.outcome, m.game_id, m.season, m.date, case when o.outcome is null then 0 else 1 end hit from (" + _pool("game_events", "g").replace("group by all", "group by e.game_id, g.date, g.season, t.combo") + ") m left join outcomes o on o.game_id = m.game_id and o.outcome = m.outcome",
}
_any = "split_part(outcome, ':', 1) in (" + ", ".join(f"'{o}'" for o in predict.PLAYER_OUTCOMES) + ")"
_bet = "case when outcome like '%COVERED%' or outcome like '%SPREAD%' then 'spread' when outcome like '%OVER_HIT%' or outcome like '%UNDER_HIT%' or outcome like '%TOTAL_%' then 'total' when regexp_matches(outcome, '_WIN') then 'moneyline' when regexp_matches(outcome, 'SCORER|REBOUNDER|ASSIST|DOUBLE|TRIPLE|PLAYER_') then 'player_prop' else 'other' end"
slate_players = lambda fx: fx.once("slate_players", lambda fx: players.slate_players(fx.game, fx.stat, fx.once("slate_context", lambda fx: asof.game_context(fx.game, fx.stat, scheduled=True))))
for _name, _player in (("pr01_predictions", False), ("pr02_player_predictions", True)):
    register(_name, lambda fx, player=_player: predict.predictions(q.slate_profiles(fx), q.best(fx), 10, player).select("game_id", "date", "combo", "outcome", *r6("hit_rate", "confidence", "value"), "sample", "place"), with_ctes(
        f'select * from (select game_id, date, "name" combo, outcome, {sql6("hit_rate", "confidence")}, round("value" + 1e-11, 6) "value", "sample", row_number() over (partition by game_id order by m.confidence desc, m."value" desc, m."name", outcome) place from met m {"where " + _any if _player else ""}) where place <= 10', MET))
register("pr02_notable_players", lambda fx: predict.notable_players(slate_players(fx)), with_ctes(
    'select * from (select *, row_number() over (partition by game_id order by "rank", player_id) place from (select game_id, player_id, least(coalesce(rank_ppg, 1073741824), coalesce(rank_rpg, 1073741824), coalesce(rank_apg, 1073741824)) "rank", case least(coalesce(rank_ppg, 1073741824), coalesce(rank_rpg, 1073741824), coalesce(rank_apg, 1073741824)) when rank_ppg then \'ppg\' when rank_rpg then \'rpg\' else \'apg\' end "by" from sl_players) where "rank" <= 20) where place <= 6', SLATE))
_kelly = "least(greatest((100e0 / 110 * hit_rate - (1 - hit_rate)) / (100e0 / 110), 0), 0.25e0)"
_e9 = "round(edge, 9)"
PICKED = MET | {"picked": f"""select * from (select game_id, date, "name" combo, outcome, {_bet} bet_type, round(hit_rate, 6) hit_rate, "sample", case when ({_e9} >= 0.15 and "sample" >= 200 and n_seasons >= 5) or ({_e9} >= 0.10 and "sample" >= 150 and n_seasons >= 4) then 'A' when {_e9} >= 0.08 and "sample" >= 100 and n_seasons >= 3 then 'B' when {_e9} >= 0.05 and "sample" >= 75 then 'C' else 'D' end grade,
    round({_kelly}, 6) kelly, round(round({_kelly}, 9) * 1000) / 10 units from met where confidence >= 0.5 and {_e9} >= 0.05) where grade <= 'B'"""}  # fmt: skip
picked = lambda fx: predict.picks(q.slate_profiles(fx), q.best(fx), min_confidence=0.5)
register("pr03_picks", picked, with_ctes("select * from picked", PICKED))
register("pr03_totals", lambda fx: predict.pick_totals(picked(fx)), with_ctes("select date, grade, bet_type, count(*) picks, count(distinct game_id) games, round(sum(units), 4) units from picked group by date, grade, bet_type", PICKED))


def slate_tops(fx):
    """game_id, side, stat, player_id, value, lastname of the top players of games to come."""
    at = ", ".join(f"'{s}', '{a}', {s}_top_{a}_player_id, {s}_top_{a}_{a}" for s in ("home", "away") for a in ("ppg", "rpg", "apg"))
    rows = q.slate_wide(fx).select("game_id", F.expr(f"stack(6, {at}) as (side, stat, player_id, value)")).where("player_id is not null")
    return rows.withColumn("lastname", F.concat(F.lit("Last"), F.col("player_id").cast("string"), F.lit("x")))


def slate_props(fx):
    """A points line for two in three top scorers and rebounders of a game to come, a rebounds line for half of the rebounders."""
    t = slate_tops(fx).where("stat <> 'apg'")
    market = F.expr("case when (game_id + player_id) % 3 > 0 then array('player_points') else array() end").cast("array<string>")
    both = F.concat(market, F.expr("case when stat = 'rpg' and player_id % 2 = 0 then array('player_rebounds') else array() end").cast("array<string>"))
    return t.select("game_id", F.concat(F.lit("First "), "lastname").alias("player"), F.explode(both).alias("market"), (F.lit(8.5) + F.col("player_id") % 24).alias("line")).distinct()


TOPS = PICKED | {
    "tops": "select game_id, side, stat, player_id, \"value\", 'Last' || player_id || 'x' lastname from (" + " union all ".join(f"select game_id, '{s}' side, '{a}' stat, {s}_top_{a}_player_id player_id, {s}_top_{a}_{a} as \"value\" from sl_wide" for s in ("home", "away") for a in ("ppg", "rpg", "apg")) + ") where player_id is not null",
    "props": "select distinct game_id, 'First ' || lastname player, market, 8.5 + player_id % 24 line from (select game_id, lastname, player_id, 'player_points' market from tops where stat <> 'apg' and (game_id + player_id) % 3 > 0 union all select game_id, lastname, player_id, 'player_rebounds' from tops where stat = 'rpg' and player_id % 2 = 0)",
    "lined": """select o.*, p.player, p.line, t.side, row_number() over (partition by o.game_id, o.outcome, t.side order by p.player, p.line) n from (select distinct game_id, outcome from picked where regexp_matches(outcome, 'TOP_SCORER_(25|30)_PLUS|REBOUNDER_1[02]_PLUS|10_PLUS_REBOUNDS|DOUBLE_DOUBLE')) o
        join tops t on t.game_id = o.game_id and t.stat = case when regexp_matches(outcome, 'TOP_SCORER_(25|30)_PLUS') then 'ppg' else 'rpg' end join props p on p.game_id = o.game_id and contains(lower(p.player), lower(t.lastname)) and p.market = case when regexp_matches(outcome, 'REBOUNDER_1[02]_PLUS|10_PLUS_REBOUNDS') then 'player_rebounds' else 'player_points' end
        where not regexp_matches(outcome, 'TOP_SCORER_(25|30)_PLUS') or t.side = case when contains(outcome, 'HOME') then 'home' else 'away' end""",
    "fitted": "select game_id, outcome, arg_max(player, pref) prop_player, arg_max(line, pref) prop_line from (select *, case when side = case when contains(outcome, 'DOUBLE_DOUBLE') or contains(outcome, 'HOME') or (regexp_matches(outcome, 'REBOUNDER_1[02]_PLUS|10_PLUS_REBOUNDS') and not contains(outcome, 'AWAY')) then 'home' else 'away' end then 1 else 0 end pref from lined where n = 1 and line >= case when regexp_matches(outcome, 'TOP_SCORER_30') then 28.5 when regexp_matches(outcome, 'TOP_SCORER_25') then 23.5 when regexp_matches(outcome, 'REBOUNDER_12') then 10.5 when regexp_matches(outcome, 'REBOUNDER_10|10_PLUS_REBOUNDS') then 8.5 else -1 end) group by game_id, outcome",
}
register("j14_prop_lines", lambda fx: predict.lined_picks(q.slate_profiles(fx), q.best(fx), slate_tops(fx), slate_props(fx), min_confidence=0.5), with_ctes("select p.game_id, p.combo, p.outcome, prop_player, prop_line from picked p left join fitted f on f.game_id = p.game_id and f.outcome = p.outcome", TOPS))


def feed_games(fx):
    """Games to come and played games with a context, as profiles."""
    return q.slate_profiles(fx).unionByName(q.profiles(fx), allowMissingColumns=True)


def the_feed(fx):
    f = fx.once("feed", lambda fx: predict.feed(feed_games(fx), q.best(fx)))
    recent = predict.recent_performance(predict.daily_hits(q.profiles(fx), q.best(fx)), f.select("combo", "outcome", "date").distinct())
    side = lambda s: [F.concat_ws("-", f"{s}_wins", f"{s}_losses").alias(f"{s}_record"), F.col(f"{s}_streak")]
    shown = q.slate_wide(fx).select("game_id", *side("home"), *side("away"), predict.game_tops().alias("tops"))
    return predict.with_own_targets(f.join(recent, ["combo", "outcome", "date"]).join(shown, "game_id", "left"), "tops").drop("tops")


FEED = TOPS | {
    "pool": "select game_id, date, \"name\", outcome, hit_rate, \"sample\", cast(null as boolean) result from met union all select h.game_id, h.date, h.\"name\", h.outcome, b.hit_rate, b.\"sample\", hit = 1 from best_hits h join best_patterns b on b.\"name\" = h.\"name\" and b.outcome = h.outcome",
    "fed": "select *, count(*) over (partition by game_id) outcomes, row_number() over (partition by game_id order by round(hit_rate, 9) desc, \"sample\" desc, outcome) place from (select *, row_number() over (partition by game_id, outcome order by round(hit_rate, 9) desc, \"sample\" desc, \"name\") n from pool where not (" + _any + ")) where n = 1",
    "shown": "select f.*, case when outcome like 'HOME\\_TOP\\_%' escape '\\' then 'home' when outcome like 'AWAY\\_TOP\\_%' escape '\\' then 'away' end target_side, case when regexp_matches(outcome, '^(HOME|AWAY)_TOP_SCORER') then 'ppg' when regexp_matches(outcome, '^(HOME|AWAY)_TOP_REBOUNDER') then 'rpg' when regexp_matches(outcome, '^(HOME|AWAY)_TOP_ASSIST') then 'apg' end target_stat from fed f where place <= 10",
    "asked": "select distinct \"name\", outcome, date from shown",
    "recent": "select a.\"name\", a.outcome, a.date, cast(coalesce(sum(h.hit), 0) as bigint) recent_hits, count(h.hit) recent_games from asked a left join best_hits h on h.\"name\" = a.\"name\" and h.outcome = a.outcome and h.date < a.date and date_diff('day', h.date, a.date) <= 30 group by a.\"name\", a.outcome, a.date",
}
register("pr04_feed", lambda fx: the_feed(fx).withColumn("target_value", F.round("target_value", 6)), with_ctes(
    f"""select f.game_id, f.date, f.place, f.outcomes, f."name" combo, f.outcome, round(hit_rate, 6) hit_rate, "sample", regexp_matches(f.outcome, 'UNDERDOG_COVERED|FAVORITE_COVERED') or (round(hit_rate, 9) >= 0.65 and "sample" >= 100) high_value, {_bet.replace("outcome", "f.outcome")} bet_type, result, f.target_side, f.target_stat, t.player_id target_player, round(t."value", 6) target_value, recent_hits, recent_games,
    w.home_wins || '-' || w.home_losses home_record, w.home_streak, w.away_wins || '-' || w.away_losses away_record, w.away_streak
    from shown f join recent r on r."name" = f."name" and r.outcome = f.outcome and r.date = f.date left join tops t on t.game_id = f.game_id and t.side = f.target_side and t.stat = f.target_stat left join sl_wide w on w.game_id = f.game_id""", FEED))  # fmt: skip
register("pm15_hits", lambda fx: mining.hits_of(q.profiles(fx), q.best(fx)), with_ctes("select * from best_hits", MET))
register("pr05_settled", lambda fx: predict.settled_hits(q.profiles(fx), q.best(fx).withColumn("outcome", F.regexp_replace("outcome", ":game", ":home"))).select("game_id", "combo", "outcome", "result"), with_ctes("select game_id, \"name\" combo, replace(outcome, ':game', ':home') outcome, hit = 1 result from best_hits", MET))
_num = lambda e: f"regexp_replace(({e})::varchar, '\\.0$', '')"
_sign = lambda e: f"(case when {e} > 0 then '+' else '' end || {_num(e)})"
_cover = lambda m, s: f"'margin ' || {_sign(m)} || ' (spread: ' || {_sign(s)} || ')'"
_tops = [(f"{s.upper()}_TOP_{w}", f"{s}_top_{a}_player_id", f"{s}_top_{a}_{predict.TOP_NUMBERS[a][0]}", predict.TOP_NUMBERS[a][1]) for s in ("home", "away") for w, a in predict.TARGETS.items()]
EXPLAINED = GAME_SQL | COUNTS | {
    "firsts": " union all ".join(f"select game_id, '{o}' first_of, min(player_id) first_id, {f"arg_min({c}, player_id) || ' {unit}'" if c else 'null'} first_said from fx_stat where {e} group by game_id" for o, (e, c, unit) in predict.FIRST_LINES.items()),
    "told": "select o.game_id, o.outcome, case " + " ".join(f"when starts_with(base, '{k}') then {p}" for k, p, _, _ in _tops) + " else first_id end player, case when ends_with(base, 'DOUBLE_DOUBLE') then null " + " ".join(f"when starts_with(base, '{k}') then {c} || ' {unit}'" for k, _, c, unit in _tops)
    + f" when base = 'HOME_COVERED' then {_cover('(home_score - away_score)', '(spread_home)')} when base = 'AWAY_COVERED' then {_cover('(away_score - home_score)', '(-spread_home)')} when base in ('OVER_HIT', 'UNDER_HIT') then (home_score + away_score) || ' total (line: ' || {_num('total_over')} || ')' else first_said end said"
    " from (select *, split_part(outcome, ':', 1) base from outcomes) o join wide using (game_id) left join firsts f on f.game_id = o.game_id and f.first_of = o.base",
}
_named = "player % 5 <> 0"
prj3_names = lambda fx: fx.stat.select("player_id").distinct().where("player_id % 5 <> 0").select("player_id", F.concat(F.lit("First Last"), F.col("player_id").cast("string")).alias("name"))
register("prj3_explained", lambda fx: predict.explained_games(q.game_wide(fx), fx.stat, prj3_names(fx)), with_ctes(
    f"select game_id, outcome, nullif(concat_ws(', ', case when {_named} then 'First Last' || player else 'Player ' || player end, said), '') explanation from told", EXPLAINED))


register("j09_latest_context", lambda fx: predict.latest_before(q.player_lines(fx).withColumn("date", F.date_add(F.lit("1990-01-01").cast("date"), F.col("day"))), ["player_id"], "1998-01-01").select("player_id", "game_id", "date", "gp", *r6("ppg")), with_ctes(
    f"select player_id, game_id, date, gp, {sql6('ppg')} from (select p.*, g.date, row_number() over (partition by p.player_id order by g.date desc, p.game_id desc) n from pctx p join fx_game g on g.game_id = p.game_id where g.date < date '1998-01-01') where n = 1", GAME_SQL))


def tipped(fx):
    """Games with a tip-off: none for one in ten, on the day after for another, else on the evening of their date; stored twice where the id ends in 7."""
    tip = F.expr("case when game_id % 10 = 0 then null when game_id % 10 = 1 then timestampadd(day, 1, cast(date as timestamp)) + interval 23 hours else cast(date as timestamp) + interval 23 hours end")
    code = fx.team.select("team_id", F.concat(F.lit("N"), (F.col("team_id") % 20).cast("string")).alias("code"))
    side = lambda s: code.select(F.col("team_id").alias(f"{s}_team_id"), F.col("code").alias(f"{s}_code"))
    g = fx.game.withColumn("tipoff", tip).join(F.broadcast(side("home")), "home_team_id").join(F.broadcast(side("away")), "away_team_id")
    return g.select("game_id", "date", "tipoff", "home_code", "away_code")


def tipped_known(fx):
    """The same with whether a game has a context and odds."""
    context = fx.once("context", lambda fx: asof.game_context(fx.game, fx.stat))
    known = lambda t, n: t.select("game_id", F.lit(True).alias(n))
    return tipped(fx).join(known(fx.line, "has_odds"), "game_id", "left").join(known(context, "has_context"), "game_id", "left").fillna(False, ["has_odds", "has_context"])


TIPPED = GAME_SQL | {
    "tipped": "select game_id, date, case when game_id % 10 = 0 then null when game_id % 10 = 1 then date + interval 47 hours else date + interval 23 hours end tipoff, 'N' || home_team_id % 20 home_code, 'N' || away_team_id % 20 away_code, game_id in (select game_id from wide) has_context, game_id in (select game_id from fx_line) has_odds from fx_game",
    "dayed": "select *, case when tipoff is null or game_id % 10 <> 1 then date else date + 1 end as day from tipped",
}
register("fl05_game_day", lambda fx: predict.game_day(tipped(fx)).select("game_id", "date", F.col("day").alias("game_day")), with_ctes("select game_id, date, cast(day as date) game_day from dayed", TIPPED))
register("tk07_matchups", lambda fx: predict.one_of_matchup(predict.game_day(tipped_known(fx))).select("game_id", F.col("day").alias("game_day"), "away_code", "home_code"), with_ctes("select game_id, cast(day as date) game_day, away_code, home_code from (select *, row_number() over (partition by day, away_code, home_code order by has_context desc, has_odds desc, tipoff nulls first, game_id) n from dayed) where n = 1", TIPPED))
register("j11_same_teams", lambda fx: predict.team_ids_of_code(fx.team.select("team_id", F.expr("case when team_id <> 5 then concat('N', team_id % 20) end").alias("code"))), with_ctes("select a.team_id, b.team_id same_id from fx_team a join fx_team b on a.team_id % 20 = b.team_id % 20 where a.team_id <> 5 and b.team_id <> 5"))
register("j07_versus", lambda fx: reports.versus(fx.stat, fx.game, 7), with_ctes("with t as (select distinct player_id, team_id from fx_stat) select s.player_id, s.game_id, s.points from fx_stat s join fx_game g on g.game_id = s.game_id where (g.home_team_id = 7 and exists (select 1 from t where t.player_id = s.player_id and t.team_id = g.away_team_id)) or (g.away_team_id = 7 and exists (select 1 from t where t.player_id = s.player_id and t.team_id = g.home_team_id))".replace("with t as (select distinct player_id, team_id from fx_stat) ", ""), {"t": "select distinct player_id, team_id from fx_stat"}))

# ---- walk-forward tests
_p = lambda z: f"((1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2))) * (0.254829592e0 + (1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2))) * (-0.284496736e0 + (1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2))) * (1.421413741e0 + (1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2))) * (-1.453152027e0 + (1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2))) * 1.061405429e0)))) * exp(-{z} * {z} / 2))"
_fold = "combo, outcome, test_season"
SEASONS = {
    "seasons": "select distinct season from game_events",
    "whole": "select s.season as test_season, count(*) n from seasons s join seasons x on x.season < s.season group by s.season",
}
FOLDS = GAME_SQL | COUNTS | SEASONS | {
    "short": "select c.*, s.season as test_season from counts c join seasons s on c.season < s.season where combo < 2097152",
    "train": f"select {q._name(mining.CONDITION_KEYS)} combo, combo code, test_season, outcome, \"sample\" train_n, hits train_hits, n_seasons train_seasons, most from (" + totals_sql("short", "combo, test_season") + ")",
    "found": "select t.*, round(0.4e0 * train_n / max(train_n) over (partition by test_season) + 0.3e0 * train_seasons / n + 0.3e0 * (1 - most / train_n), 9) confidence, round((train_hits / train_n - 0.524e0) * sqrt(train_n), 9) \"value\" from train t join whole using (test_season)",
    "cand": "select * from (select *, row_number() over (partition by test_season order by confidence desc, \"value\" desc, combo, outcome) place from found) where place <= 500",
    "bets": "select c.combo, c.outcome, c.test_season, train_hits / train_n train_rate, g.date, b.game_id, case when o.outcome is null then 0 else 1 end hit from cand c join (select game_id, combo, season from g1 union all select game_id, combo, season from g2 union all select game_id, combo, season from g3) b on b.combo = c.code and b.season = c.test_season join fx_game g on g.game_id = b.game_id left join outcomes o on o.game_id = b.game_id and o.outcome = c.outcome",
    "staked": "select *, case when hit = 1 then 100e0 / 110 else -1 end ret, least(greatest((100e0 / 110 * train_rate - (1 - train_rate)) / (100e0 / 110), 0) / 2, 0.02e0) share from bets",
    "book": f"select *, bankroll / (1 + share * ret) * share wager, bankroll / (1 + share * ret) * share * ret profit, greatest(10000, max(bankroll) over (partition by {_fold} order by date, game_id rows unbounded preceding)) peak from (select *, 10000 * exp(sum(ln(1 + share * ret)) over (partition by {_fold} order by date, game_id rows unbounded preceding)) bankroll from staked where share > 0)",
    "money": f"select {_fold}, count(*) bets, sum(wager) wagered, sum(profit) net, sum(profit) / sum(wager) roi, max((peak - bankroll) / peak) max_drawdown, case when count(*) >= 30 and stddev_pop(ret) > 1e-12 then avg(ret) / stddev_pop(ret) end sharpe from book group by {_fold}",
    "seen": f"select {_fold}, count(*) test_n, cast(sum(hit) as bigint) test_hits from bets group by {_fold} having count(*) >= 5",
    "t1": "select c.*, test_n, test_hits, coalesce(bets, 0) bets, coalesce(net, 0) net, coalesce(roi, 0) roi, coalesce(max_drawdown, 0) max_drawdown, sharpe, train_hits / train_n train_rate, test_hits / test_n test_rate, (test_hits / test_n - 0.524e0) / sqrt(0.524e0 * 0.476e0 / test_n) z, (train_hits + test_hits) / (train_n + test_n) pooled from cand c join seen s on s.combo = c.combo and s.outcome = c.outcome and s.test_season = c.test_season left join money m on m.combo = c.combo and m.outcome = c.outcome and m.test_season = c.test_season",
    "t2": "select *, case when train_n > 0 and pooled > 0 and pooled < 1 then (test_rate - train_hits / train_n) / sqrt(pooled * (1 - pooled) * (1 / test_n + 1 / train_n)) else 0 end z_train, coalesce(train_hits / nullif(train_n, 0), 0) trained, (test_hits - test_n * 0.524e0) ** 2 / (test_n * 0.524e0) + (test_hits - test_n * 0.524e0) ** 2 / (test_n * 0.476e0) chi, train_rate * 100e0 / 110 - (1 - train_rate) ev, 1.96e0 * sqrt(test_rate * (1 - test_rate) / test_n + 3.8416e0 / (4 * test_n * test_n)) / (1 + 3.8416e0 / test_n) half, (test_rate + 3.8416e0 / (2 * test_n)) / (1 + 3.8416e0 / test_n) mid from t1",
    "t3": f"select *, {_p('z')} p, {_p('z_train')} p_train, least(mid + half, 1) - greatest(mid - half, 0) width, (train_rate - test_rate) / train_rate lost from t2",
    "t4": """select *, p < 0.05 and test_rate > 0.524 significant, p_train > 0.05 or test_rate >= trained consistent, least(greatest((test_rate - 0.524e0) / 0.15e0 * 25, 0), 25) edge_score,
        least((case when z >= 1.96 then 10 when z >= 1.65 then 7 when z >= 1.28 then 4 else 0 end) + (case when p < 0.01 then 8 when p < 0.05 then 5 when p < 0.1 then 2 else 0 end) + (case when width < 0.1 then 7 when width < 0.15 then 5 when width < 0.2 then 3 else 0 end), 25) significance_score,
        least((case when test_rate >= train_rate then 15 when lost < 0.05 then 12 when lost < 0.1 then 9 when lost < 0.15 then 6 when lost < 0.25 then 3 else 0 end) + (case when p_train > 0.05 or test_rate >= trained then 10 else 0 end), 25) consistency_score,
        least((case when round(roi, 9) >= 0.1 then 10 when round(roi, 9) >= 0.05 then 8 when round(roi, 9) > 0 then 5 when round(roi, 9) > -0.05 then 2 else 0 end) + (case when round(max_drawdown, 9) < 0.1 then 5 when round(max_drawdown, 9) < 0.2 then 3 when round(max_drawdown, 9) < 0.3 then 1 else 0 end) + (case when sharpe is not null then case when round(sharpe, 9) >= 1.5 then 5 when round(sharpe, 9) >= 1 then 4 when round(sharpe, 9) >= 0.5 then 2 else 0 end when bets >= 30 and round(roi, 9) > 0 then 2 else 0 end) + (case when ev > 0.05 then 5 when ev > 0.02 then 3 when ev > 0 then 1 else 0 end), 25) pnl_score from t3""",
    "done": "select *, edge_score + significance_score + consistency_score + pnl_score total_score from t4",
}


candidates = lambda fx: fx.once("candidates", lambda fx: backtest.candidates(q.counts(fx), mining.calendar(q.profiles(fx))))
rated = lambda fx: candidates(fx).withColumn("train_rate", F.col("train_hits") / F.col("train_n"))
flat = lambda fx: fx.once("walked_flat", lambda fx: backtest.walked_flat(q.profiles(fx), candidates(fx)))


def done(fx, sizing: str = "halfKelly"):
    played = lambda fx: flat(fx) if sizing == "flat" else backtest.walked(q.profiles(fx), rated(fx), sizing)
    return fx.once(f"done_{sizing}", lambda fx: backtest.judged(candidates(fx), played(fx)))


#: Flat stakes of 200 until a bankroll is short of one: then what is left, bet by bet.
FLAT = FOLDS | {
    "staked": f"select *, case when hit = 1 then 100e0 / 110 else -1 end ret, row_number() over (partition by {_fold} order by date, game_id) n from bets",
    "book": """select combo, outcome, test_season, train_rate, date, game_id, hit, ret, l.wager, l.wager * ret profit, l.bank bankroll, greatest(10000, max(l.bank) over (partition by combo, outcome, test_season order by date, game_id rows unbounded preceding)) peak from
        (select s.*, list_reduce(list_prepend({'wager': 0e0, 'bank': 10000e0, 'ret': 0e0}, list_transform(list(ret) over (partition by combo, outcome, test_season order by date, game_id rows unbounded preceding), lambda r: {'wager': 0e0, 'bank': 0e0, 'ret': r})), lambda a, b: {'wager': least(200e0, a.bank), 'bank': a.bank + least(200e0, a.bank) * b.ret, 'ret': 0e0}) l from staked s) where l.wager > 0""",
}
_TESTED = ("z", "p", "z_train", "p_train", "chi", "chi_p", "roi", "max_drawdown", "sharpe", "total_score")
_letter = "case when total_score >= 85 then 'A' when total_score >= 70 then 'B' when total_score >= 55 then 'C' when total_score >= 40 then 'D' else 'F' end grade"
_select = f"select {_fold}, train_n, train_hits, test_n, test_hits, significant, consistent, {_letter}, {sql6(*_TESTED)} from (select *, p chi_p from done)"
_shown = lambda d: d.select(*backtest.FOLD, "train_n", "train_hits", "test_n", "test_hits", "significant", "consistent", "grade", *r6(*_TESTED))
register("bt02_walk_forward", lambda fx: _shown(done(fx)), with_ctes(_select, FOLDS))
register("bt02_walk_forward_flat", lambda fx: _shown(done(fx, "flat")), with_ctes(_select, FLAT))
register("bt03_robust", lambda fx: backtest.robust(done(fx)).select("combo", "outcome", "folds", "test_season", *r6("z")), with_ctes("select combo, outcome, folds, test_season, round(z + 1e-11, 6) z from (select combo, outcome, count(*) folds, min(roi) least_roi, max(z) z, arg_max(test_season, round(z, 9) - test_season * 1e-12) test_season from done group by combo, outcome) where folds = (select count(distinct test_season) from done) and least_roi > 0", FOLDS))
register("bt04_folds", lambda fx: backtest.fold_summary(done(fx)).select("test_season", "tested", "passed", "degraded", *r6("hit_rate", "edge"), F.round("net", 4).alias("net"), *r6("fold_roi")), with_ctes(
    "select test_season, count(*) tested, count(case when significant or roi > 0 then 1 end) passed, count(case when test_rate < 0.85e0 * train_rate then 1 end) degraded, round(sum(test_hits) / sum(test_n) + 1e-11, 6) hit_rate, round(sum(test_hits) / sum(test_n) - 0.524e0 + 1e-11, 6) edge, round(sum(net), 4) net, round(sum(net) / (sum(bets) * 200e0) + 1e-11, 6) fold_roi from done group by test_season", FOLDS))
_results = ("wagered", "net", "roi", "peak", "final", "max_drawdown", "sharpe")
register("bt06_ledger_flat", lambda fx: flat(fx).select(*backtest.FOLD, "bets", "wins", *r6(*_results)), with_ctes(
    f"select {_fold}, count(*) bets, cast(sum(hit) as bigint) wins, round(sum(wager) + 1e-11, 6) wagered, round(sum(profit) + 1e-11, 6) net, round(sum(profit) / sum(wager) + 1e-11, 6) roi, round(max(peak) + 1e-11, 6) peak, round(10000 + sum(profit) + 1e-11, 6) final, round(max((peak - bankroll) / peak) + 1e-11, 6) max_drawdown, round(case when count(*) >= 30 and stddev_pop(ret) > 1e-12 then avg(ret) / stddev_pop(ret) end + 1e-11, 6) sharpe from book group by {_fold}", FLAT))
register("bt07_combined", lambda fx: backtest.combined_days(backtest.walked_days(q.profiles(fx), rated(fx)), "test_season").select("test_season", "bets", "wins", *[F.round(c, 4).alias(c) for c in ("net", "peak", "final")], *r6("roi", "max_drawdown")), with_ctes(
    "select test_season, cast(sum(bets) as bigint) bets, cast(sum(wins) as bigint) wins, round(sum(profit), 4) net, round(max(peak), 4) peak, round(10000 + sum(profit), 4) final, round(sum(profit) / sum(wagered) + 1e-11, 6) roi, round(max((peak - bankroll) / peak) + 1e-11, 6) max_drawdown from (select *, greatest(10000, max(bankroll) over (partition by test_season order by date)) peak from "
    "(select *, 10000 + sum(profit) over (partition by test_season order by date) bankroll from (select test_season, date, count(*) bets, sum(hit) wins, sum(wager) wagered, sum(profit) profit from book group by test_season, date))) group by test_season", FOLDS))  # fmt: skip
register("tk04_by_grade", lambda fx: backtest.report(done(fx)).select(*backtest.FOLD, "grade", *r6("roi")), with_ctes(f"select {_fold}, grade, {sql6('roi')} from (select *, {_letter} from done) order by grade, round(roi, 9) desc, {_fold} limit 100", FOLDS))
_implied = lambda o: f"(case when {o} > 0 then 100e0 / ({o} + 100) else abs({o}) / (abs({o}) + 100e0) end)"
_odds = "case when game_id % 7 = 0 then null else cast(-125 + game_id % 31 as int) end"
register("bt08_closing", lambda fx: backtest.closing_value(backtest.bets(q.profiles(fx), candidates(fx)).withColumn("odds", F.expr(_odds)), ["test_season"]).withColumn("value", F.round("value", 9)), with_ctes(
    f"select test_season, round(avg(v), 9) \"value\", count(case when v > 0 then 1 end) \"above\", count(case when v < 0 then 1 end) \"below\" from (select *, {_implied('-110')} - {_implied(f'coalesce({_odds}, -110)')} v from bets) group by test_season", FOLDS))
register("snk08_best_results", lambda fx: sinks.best_results(done(fx)).select("combo", "outcome", "test_season", "grade", "grade_score", *r6("z")), with_ctes(
    f"select combo, outcome, test_season, grade, case grade when 'A' then 90 when 'B' then 75 when 'C' then 60 when 'D' then 45 else 30 end grade_score, round(z + 1e-11, 6) z from (select *, {_letter}, row_number() over (partition by combo, outcome order by z desc, test_season) n from done) where n = 1", FOLDS))

# ---- stored game patterns tested on seasons
#: Their hits by season: one season out at a time, and the last season alone with the rate of all.
def season_table(fx):
    best = q.best(fx).select("combo", "o", "name", "outcome")
    own = q.counts(fx).join(F.broadcast(best), "combo")
    hits = F.array(*[f"h{i}" for i in range(len(mining.OUTCOME_KEYS))])
    return own.select(F.col("name").alias("combo"), "outcome", F.col("combo").alias("code"), "o", "season", F.col("sample").alias("n"), F.get(hits, F.col("o")).alias("h"))


OUT = MET | SEASONS | {k: v for k, v in FOLDS.items() if k in ("staked", "book", "money", "seen", "t2", "t3", "t4", "done")} | {
    "by_season": "select \"name\" combo, outcome, season, count(*) n, sum(hit) h from best_hits group by all",
    "cand": "select a.combo, a.outcome, a.season as test_season, cast(sum(b.n) as bigint) train_n, cast(sum(b.h) as bigint) train_hits from by_season a join by_season b on b.combo = a.combo and b.outcome = a.outcome and b.season <> a.season group by all having sum(b.n) >= 10",
    "bets": "select c.combo, c.outcome, c.test_season, train_hits / train_n train_rate, h.date, h.game_id, h.hit from cand c join best_hits h on h.\"name\" = c.combo and h.outcome = c.outcome and h.season = c.test_season",
}
_rate = "select *, hits / \"sample\" rate from (select * from best_patterns order by confidence desc, \"value\" desc, \"name\", outcome limit 100)"
LAST = OUT | {
    "hundred": _rate,
    "cand": "select p.\"name\" combo, p.outcome, (select max(season) from seasons) test_season, cast(sum(case when b.season < (select max(season) from seasons) then b.n else 0 end) as bigint) train_n, cast(sum(case when b.season < (select max(season) from seasons) then b.h else 0 end) as bigint) train_hits, rate from hundred p join by_season b on b.combo = p.\"name\" and b.outcome = p.outcome group by p.\"name\", p.outcome, rate",
    "bets": "select c.combo, c.outcome, c.test_season, c.rate train_rate, h.date, h.game_id, h.hit from cand c join best_hits h on h.\"name\" = c.combo and h.outcome = c.outcome and h.season = c.test_season",
}
_t1 = FOLDS["t1"]
OUT = OUT | {"t1": _t1}
LAST = LAST | {"t1": _t1.replace("train_hits / train_n train_rate", "rate train_rate")}
_order_ctes = lambda parts: {k: parts[k] for k in [*(k for k in parts if k not in _last), *_last] if k in parts}
_last = ("seasons", "by_season", "hundred", "cand", "bets", "staked", "book", "money", "seen", "t1", "t2", "t3", "t4", "done")
register("bt05_leave_one_out", lambda fx: _shown(backtest.leave_one_out(season_table(fx), q.profiles(fx))), with_ctes(_select, _order_ctes(OUT)))
register("bt05_stored", lambda fx: _shown(backtest.stored_test(q.best(fx), season_table(fx), q.profiles(fx), mining.calendar(q.profiles(fx))[-1])), with_ctes(_select, _order_ctes(LAST)))
register("bt05_quick", lambda fx: backtest.quick(season_table(fx)).select("combo", "outcome", "seasons", *r6("mean_rate", "spread", "variation"), "stable"), with_ctes("select combo, outcome, count(*) seasons, round(avg(h / n) + 1e-11, 6) mean_rate, round(max(h / n) - min(h / n) + 1e-11, 6) spread, round(case when count(*) < 2 or avg(h) = 0 then 0 else stddev_pop(h) / avg(h) end + 1e-11, 6) variation, min(h / n) > 0.524 stable from by_season where n >= 3 group by combo, outcome", _order_ctes(OUT)))
