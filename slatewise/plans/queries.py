"""Registered queries over the fixture tables and their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatewise.operators import asof, games, mining, night, players
from slatewise.sources.fixtures import frames, with_ctes

NIGHT_SQL, GAME_SQL = night.events_sql(), asof.CONTEXT_SQL | games.EVENTS_SQL
QUERIES: dict = {}
SQL: dict[str, str] = {}


def rounded(c: Column | str, digits: int) -> Column:
    """``c`` to so many digits as the SQL's round takes it: the double times a power of ten, halves away from 0. F.round looks at the shortest decimals instead."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 10.0**digits) / 10.0**digits


def register(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(frames(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


# ---- tables that several queries read, each written once (see fixtures.Tables)
night_measures = lambda fx: fx.once("night_measures", night.night_measures)
player_lines = lambda fx: fx.once("players", lambda fx: players.player_context(fx.game, fx.stat, fx.once("context", lambda fx: asof.game_context(fx.game, fx.stat))))
night_events = lambda fx: fx.once("night_events", lambda fx: night.events_of(night_measures(fx)))
game_wide = lambda fx: fx.once("game_wide", games.wide_games)
slate_wide = lambda fx: fx.once("slate_wide", games.wide_slate)
game_events = lambda fx: fx.once("game_events", lambda fx: games.game_events(game_wide(fx)))
profiles = lambda fx: fx.once("profiles", lambda fx: mining.wide_profiles(game_wide(fx)))
slate_profiles = lambda fx: fx.once("slate_profiles", lambda fx: mining.wide_profiles(slate_wide(fx), outcomes=False))
night_patterns = lambda fx: fx.once("night_patterns", lambda fx: mining.night_patterns(night_events(fx)))
stored = lambda fx: fx.once("stored", lambda fx: mining.stored(night_patterns(fx)))
counts = lambda fx: fx.once("pattern_counts", lambda fx: mining.pattern_counts(profiles(fx)))
kept = lambda fx: fx.once("kept_patterns", lambda fx: mining.kept_patterns(counts(fx)))
scored = lambda fx: fx.once("scored", lambda fx: mining.scored(kept(fx), profiles(fx)))
best = lambda fx: fx.once("best_patterns", lambda fx: mining.top(scored(fx)))


def _grown(source: str, unit: str, extra: str, legs: int, prefix: str) -> dict[str, str]:
    """Common table expressions of the combinations of 1 to ``legs`` codes (c, from 1) of a unit of ``source``, as numbers."""
    parts = {f"{prefix}1": f"select {unit}, {extra}, c as last, c::bigint as combo from {source}"}
    for n in range(2, legs + 1):
        parts[f"{prefix}{n}"] = f"select a.{unit}, {', '.join('a.' + x for x in extra.split(', '))}, b.c as last, a.combo * 128 + b.c as combo from {prefix}{n - 1} a join {source} b on a.{unit} = b.{unit} and b.c > a.last"
    return parts


def _name(keys: tuple[str, ...]) -> str:
    names = "[" + ", ".join(f"'{k}'" for k in keys) + "]"
    return "concat_ws('+', " + ", ".join(f"{names}[(combo >> {7 * p}) & 127]" for p in (3, 2, 1, 0)) + ")"


_night_keys = tuple(sorted(night.CATALOG))
_list = lambda keys: "[" + ", ".join(f"'{k}'" for k in keys) + "]"
_nights = _grown("nk", "date", "season", 4, "n")
_four = _nights.pop("n4")
#: Night patterns of all lengths, by plain joins of each night's events.
NIGHT_PATTERNS = NIGHT_SQL | {"nk": f"select date, season, list_position({_list(_night_keys)}, event_key) c from night_events"} | _nights | {
    "nper": " union all ".join(f"select combo, season, count(*) h, max(date) d from {t} group by combo, season" for t in ("n1", "n2", "n3", f"({_four})")),
    "nall": "select combo, sum(h)::bigint hits, count(*) n_seasons, max(h) most, max(d) last from nper group by combo having sum(h) >= 3",
    "npat": f"""select {_name(_night_keys)} combo, hits, n_seasons, round(st, 4) stability, round(ba, 4) balance, round(ra, 4) rarity, round(re, 4) recency, round(0.35 * st + 0.25 * ba + 0.25 * ra + 0.15 * re, 4) overall
        from (select combo, hits, n_seasons, least(n_seasons / (select count(distinct season) from night_events), 1.0) st, 1 - most / hits ba, 1 - least(1.0, abs(hits / n_seasons - 2.5) / 3) ra, greatest(0.0, 1 - date_diff('day', last, date '2001-01-01') / 730) re
        from nall where n_seasons >= 2 and most / hits <= 0.6 and hits / n_seasons between 0.5 and 6)""",
    "stored": "select *, len(string_split(combo, '+')) legs from npat order by overall desc, combo limit 5000",
    "shits": "select s.combo, n.date, n.season from (select combo, legs, unnest(string_split(combo, '+')) k from stored) s join night_events n on n.event_key = s.k group by s.combo, s.legs, n.date, n.season having count(*) = s.legs",
}

is_condition = "event_key in (" + ", ".join(f"'{k}'" for k in games.CONDITIONS) + ")"
_width = len(mining.OUTCOME_KEYS)
#: Game patterns of all lengths: each game's conditions as numbers, its outcomes as bits, counts of all outcomes in one row.
COUNTS = {
    "gk": f"select game_id, season, list_position({_list(mining.CONDITION_KEYS)}, event_key) c from game_events where {is_condition}",
    "outcomes": f"select game_id, event_key outcome from game_events where not {is_condition}",
    "gbits": f"select game_id, bit_or(1::bigint << (list_position({_list(mining.OUTCOME_KEYS)}, outcome) - 1)) bits from outcomes group by game_id",
} | _grown("gk", "game_id", "season", 4, "g") | {
    "counts": "select combo, season, count(*) as sample_n, " + ", ".join(f"sum((bits >> {i}) & 1)::bigint h{i}" for i in range(_width)) + " from (" + " union all ".join(f"select game_id, season, combo, coalesce(bits, 0) bits from g{n} left join gbits using (game_id)" for n in (1, 2, 3, 4)) + ") group by combo, season",
}


def totals_sql(source: str, by: str) -> str:
    """Outcomes of combinations with samples of 15 and rates of 0.58, summed over the seasons of ``source``."""
    wide = f"select {by}, sum(sample_n)::bigint n, " + ", ".join(f"sum(h{i})::bigint s{i}, count(case when h{i} > 0 then 1 end) c{i}, max(h{i}) m{i}" for i in range(_width)) + f" from {source} group by {by} having sum(sample_n) >= 15"
    each = ", ".join(f"{{'outcome': '{k}', 'hits': s{i}, 'n_seasons': c{i}, 'most': m{i}}}" for i, k in enumerate(mining.OUTCOME_KEYS))
    return f"select {by}, \"sample\", o.outcome, o.hits, o.n_seasons, o.most from (select {by}, n as \"sample\", unnest(list_filter([{each}], lambda x: x.hits / n >= 0.58)) o from ({wide}))"


register("ne_all", lambda fx: night_events(fx).groupBy("season", "event_key").agg(F.count("*").alias("nights")), with_ctes("select season, event_key, count(*) nights from night_events group by season, event_key", NIGHT_SQL))
register("ne_rows", lambda fx: night.events_of(night_measures(fx), infra=True), with_ctes("select date, season, event_key from night_events", night.events_sql(infra=True)))
register("ag01_team_night", lambda fx: night.team_night(fx.stat).select("date", "season", "team_id", *night.STATS), with_ctes(f"select date, season, team_id, {', '.join(night.STATS)} from team_night", NIGHT_SQL))
register("ag03_player_totals", lambda fx: fx.stat.groupBy("player_id").agg(*[F.sum(s).alias(s) for s in night.STATS], F.count_distinct("game_id").alias("games")), with_ctes(f"select player_id, {', '.join(f'sum({s}) {s}' for s in night.STATS)}, count(distinct game_id) games from fx_stat group by player_id"))
register("ag04_team_totals", lambda fx: fx.stat.groupBy("team_id").agg(*[F.sum(s).alias(s) for s in night.STATS], F.count_distinct("game_id").alias("games")), with_ctes(f"select team_id, {', '.join(f'sum({s}) {s}' for s in night.STATS)}, count(distinct game_id) games from fx_stat group by team_id"))
register("ag05_player_highs", lambda fx: fx.stat.groupBy("player_id").agg(F.count("*").alias("games"), *[F.count_if(F.col("points") >= n).alias(f"games_{n}") for n in (30, 40, 50)], *[F.count_if(F.expr(f"{night.TENS} >= {n}")).alias(a) for n, a in ((2, "double_doubles"), (3, "triple_doubles"))], F.round(F.avg("points"), 4).alias("ppg")),
         with_ctes(f"select player_id, count(*) games, {', '.join(f'count(case when points >= {n} then 1 end) games_{n}' for n in (30, 40, 50))}, count(case when {night.TENS} >= 2 then 1 end) double_doubles, count(case when {night.TENS} >= 3 then 1 end) triple_doubles, round(avg(points), 4) ppg from fx_stat group by player_id"))
register("ag07_games_without_stats", lambda fx: fx.game.where("status = 'Final'").join(fx.stat, "game_id", "left_anti").groupBy("season").agg(F.count("*").alias("games")), with_ctes("select season, count(*) games from fx_game g where status = 'Final' and not exists (select 1 from fx_stat s where s.game_id = g.game_id) group by season"))
register("ag10_night_summary", lambda fx: night.summary(night_measures(fx), night_events(fx)), with_ctes("select m.date, m.season, n_games, n_scored, n_stats, coalesce(n, 0) n_events from measures m left join (select date, count(*) n from night_events group by date) e on e.date = m.date", NIGHT_SQL))
ROUNDED = ("ppg", "oppg", "reb_pg", "ast_pg", "pace")
register("wn_context", lambda fx: fx.once("context", lambda fx: asof.game_context(fx.game, fx.stat)).select("game_id", "season", *[(rounded(f"{s}_{c}", 6) if c in ROUNDED else F.col(f"{s}_{c}")).alias(f"{s}_{c}") for s in ("home", "away") for c in asof.COLUMNS]),
         with_ctes("select game_id, season, " + ", ".join(f"round({s}_{c}, 6) {s}_{c}" if c in ROUNDED else f"{s}_{c}" for s in ("home", "away") for c in asof.COLUMNS) + " from context", asof.CONTEXT_SQL))
register("wn06_head_to_head", lambda fx: asof.head_to_head(fx.game), with_ctes(
    """select game_id, season, count(*) over w prior_meetings, coalesce(sum(case when home_score > away_score then 1 else 0 end) over w, 0) prior_home_side_wins
    from (select *, date_diff('day', date '1990-01-01', date) as day from fx_game where status = 'Final') g
    window w as (partition by season, least(home_team_id, away_team_id), greatest(home_team_id, away_team_id) order by day range between unbounded preceding and 1 preceding)"""))  # fmt: skip
AVERAGED, RANKED = ("ppg", "rpg", "apg", "mpg", "fg3_pct", "ft_pct", "last5_ppg"), ("rank_ppg", "rank_rpg", "rank_apg", "opp_rank_def")
register("wn11_player_context", lambda fx: player_lines(fx).select("game_id", "player_id", "team_id", "gp", *RANKED, *[rounded(c, 6).alias(c) for c in AVERAGED]),
         with_ctes("select game_id, player_id, team_id, gp, " + ", ".join([*RANKED, *[f"round({c}, 6) {c}" for c in AVERAGED]]) + " from pctx", asof.CONTEXT_SQL | players.PLAYER_SQL))
register("gc_go_all", lambda fx: game_events(fx).select("game_id", "season", "event_key"), with_ctes("select game_id, season, event_key from game_events", GAME_SQL))
register("ing15_consensus", lambda fx: fx.line, with_ctes("select * from fx_line"))
register("pm01_night_patterns", lambda fx: night_patterns(fx).select("combo", "hits", "n_seasons", "stability", "balance", "rarity", "recency", "overall"), with_ctes("select combo, hits, n_seasons, stability, balance, rarity, recency, overall from npat", NIGHT_PATTERNS))
register("pm13_game_patterns", lambda fx: kept(fx).select(mining.combo_name(mining.CONDITION_KEYS).alias("combo"), "outcome", "sample", "hits", "n_seasons", *[rounded(c, d).alias(n) for n, c, d in (("hit_rate", F.col("hits") / F.col("sample"), 6), ("edge", F.col("hits") / F.col("sample") - mining.BREAK_EVEN, 6), ("value_score", (F.col("hits") / F.col("sample") - mining.BREAK_EVEN) * F.sqrt("sample"), 4))]), with_ctes(
    f'select {_name(mining.CONDITION_KEYS)} combo, outcome, "sample", hits, n_seasons, round(hits / "sample", 6) hit_rate, round(hits / "sample" - 0.524, 6) edge, round((hits / "sample" - 0.524) * sqrt("sample"), 4) value_score from kept', GAME_SQL | COUNTS | {"kept": "select * from (" + totals_sql("counts", "combo") + ") where hits / \"sample\" - 0.524 >= 0.02 and most / \"sample\" <= 0.85"}))
