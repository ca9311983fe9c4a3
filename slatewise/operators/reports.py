"""Reports: profiles, coverage, leaders, re-ranked and redundant patterns, filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.operators.mining import SEASON_WORDS, hit_dates, rated
from slatewise.operators.night import CATALOG, STATS

COUNTED = ("points", "assists", "rebounds", "steals", "blocks", "turnovers")


@dataclass(frozen=True)
class Filter:
    """Which lines a rollup takes; None takes all. Dates are inclusive; ``side`` is home, away or either."""

    season: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    opponent: int | None = None
    side: str = "either"
    least_minutes: float | None = None

    def __post_init__(self) -> None:
        if self.side not in ("home", "away", "either"):
            raise ValueError(f"side: {self.side}")

    def lines(self, stat: DataFrame, game: DataFrame) -> DataFrame:
        """Lines by the team of the line itself; conditions on the game reach its scan."""
        at_home = F.col("team_id") == F.col("home_team_id")
        tests = [
            None if self.season is None else F.col("season") == self.season, None if self.date_from is None else F.col("date") >= F.lit(self.date_from).cast("date"), None if self.date_to is None else F.col("date") <= F.lit(self.date_to).cast("date"),
            None if self.opponent is None else F.when(at_home, F.col("away_team_id")).otherwise(F.col("home_team_id")) == self.opponent, {"home": at_home, "away": ~at_home}.get(self.side), None if self.least_minutes is None else F.col("secs") >= self.least_minutes * 60,
        ]
        out = stat.join(game.select("game_id", "home_team_id", "away_team_id"), "game_id")
        for t in tests:
            out = out if t is None else out.where(t)
        return out.select(*stat.columns)


def versus(stat: DataFrame, game: DataFrame, opponent: int) -> DataFrame:
    """(player_id, game_id, points) of every line in a game that ``opponent`` played against any team that the line's player ever played for."""
    teams = stat.select("player_id", F.col("team_id").alias("other")).distinct()
    against = game.where((F.col("home_team_id") == opponent) | (F.col("away_team_id") == opponent)).select("game_id", F.when(F.col("home_team_id") == opponent, F.col("away_team_id")).otherwise(F.col("home_team_id")).alias("other"))
    return stat.select("player_id", "game_id", "points").join(against, "game_id").join(teams, ["player_id", "other"], "left_semi").select("player_id", "game_id", "points")


def sides_of(game: DataFrame) -> DataFrame:
    """(game_id, date, season, team_id, margin) of final games, two rows each."""
    return game.where("status = 'Final'").select("game_id", "date", "season", F.expr("stack(2, home_team_id, home_score - away_score, away_team_id, away_score - home_score) as (team_id, margin)"))


def team_profile(game: DataFrame, stat: DataFrame) -> DataFrame:
    """Per team: games with lines, averages, nights over thresholds; record and blowouts of 20 from its final games."""
    per_game = stat.groupBy("team_id", "game_id").agg(*[F.sum(c).alias(c) for c in COUNTED])
    over = (("points", 140), ("points", 120), ("assists", 35), ("blocks", 12), ("rebounds", 50))
    lines = per_game.groupBy("team_id").agg(F.count("*").alias("gp"), *[F.round(F.avg(c), 4).alias(f"{c}_pg") for c in COUNTED], *[F.count_if(F.col(c) >= n).alias(f"{c}_{n}") for c, n in over])
    record = sides_of(game).groupBy("team_id").agg(F.count_if(F.col("margin") > 0).alias("wins"), F.count_if(F.col("margin") < 0).alias("losses"), F.count_if(F.col("margin") >= 20).alias("blowout_wins"), F.count_if(F.col("margin") <= -20).alias("blowout_losses"))
    return record.join(lines, "team_id", "full_outer")


def top_scorers(stat: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` players of each team with the most points for it; of equal ones the smaller id."""
    sums = stat.groupBy("team_id", "player_id").agg(F.sum("points").alias("points"), F.count("*").alias("games"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("points"), "player_id"))).where(F.col("place") <= n)


def best_games(stat: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best lines of each player by points, assists and rebounds; earlier games come first among equals."""
    long = stat.select("player_id", "game_id", F.expr("stack(3, 'points', points, 'assists', assists, 'rebounds', rebounds) as (measure, value)"))
    # how often each value came tells which values can be among the first, so that only their lines are put in order
    above = F.sum("times").over(Window.partitionBy("player_id", "measure").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
    high = long.groupBy("player_id", "measure", "value").agg(F.count("*").alias("times")).withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < n)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("player_id", "measure", "value")]
    some = long.alias("a").join(F.broadcast(high.alias("b")), same, "left_semi")
    return some.withColumn("place", F.row_number().over(Window.partitionBy("player_id", "measure").orderBy(F.desc("value"), "game_id"))).where(F.col("place") <= n)


def minute_buckets(stat: DataFrame) -> DataFrame:
    """Per player how often, and in what share of games, 30, 35 and 40 minutes were reached."""
    return stat.groupBy("player_id").agg(F.count("*").alias("games"), *[F.count_if(F.col("secs") >= m * 60).alias(f"games_{m}") for m in (30, 35, 40)], *[F.round(F.avg((F.col("secs") >= m * 60).cast("int")) * 100, 4).alias(f"pct_{m}") for m in (30, 35, 40)])


def leaders(game: DataFrame, stat: DataFrame, season: int, before: str, least: int = 5) -> DataFrame:
    """Per team its top player by average points, rebounds and assists in ``season`` before a date, of those with ``least`` games."""
    done = game.where((F.col("season") == season) & (F.col("home_score") > 0) & (F.col("date") < F.lit(before).cast("date"))).select("game_id")
    avg = stat.join(done, "game_id", "left_semi").groupBy("team_id", "player_id").agg(F.count("*").alias("games"), *[F.avg(c).alias(c) for c in ("points", "rebounds", "assists")]).where(F.col("games") >= least)
    long = avg.select("team_id", "player_id", "games", F.expr("stack(3, 'points', points, 'rebounds', rebounds, 'assists', assists) as (measure, mean)"))
    order = Window.partitionBy("team_id", "measure").orderBy(F.desc(F.round("mean", 9)), "player_id")
    return long.withColumn("place", F.row_number().over(order)).where("place = 1").select("team_id", "measure", "player_id", "games", F.round("mean", 6).alias("mean"))


def event_coverage(events: DataFrame, nights: DataFrame) -> DataFrame:
    """Per key of the catalog: nights hit, their rate, least and most in a season (0 where none), and what is odd about it."""
    seasons = nights.groupBy("season").agg(F.count("*").alias("nights"))
    every = seasons.select("season", F.explode(F.array(*[F.lit(k) for k in CATALOG])).alias("event_key"))
    counts = every.join(events.groupBy("season", "event_key").agg(F.count("*").alias("hits")), ["season", "event_key"], "left").fillna(0, ["hits"])
    total = seasons.agg(F.sum("nights").alias("n")).select("n").scalar()
    s = counts.groupBy("event_key").agg(F.sum("hits").alias("total"), F.min("hits").alias("least"), F.max("hits").alias("most"), F.count("*").alias("seasons"))
    rate = F.col("total") / total
    state = F.when(F.col("total") == 0, "broken").when(rate >= 0.8, "common").when((F.col("least") == 0) & (F.col("seasons") > 1), "gaps").otherwise("fine")
    return s.select("event_key", "total", F.round(rate, 6).alias("rate"), "least", "most", state.alias("state"))


def aggregate_coverage(game: DataFrame, stat: DataFrame, present: DataFrame) -> DataFrame:
    """Per season: final games and dates, those with lines, (date, team) pairs that should have an aggregate and those ``present``."""
    final = game.where("status = 'Final'").groupBy("season").agg(F.count("*").alias("games"), F.count_distinct("date").alias("dates"))
    lined = stat.groupBy("season").agg(F.count_distinct("game_id").alias("stat_games"), F.count_distinct("date").alias("stat_dates"))
    pairs = stat.select("season", "date", "team_id").distinct().join(present.select("date", "team_id").distinct().withColumn("has", F.lit(1)), ["date", "team_id"], "left").groupBy("season").agg(F.count("*").alias("expected"), F.count("has").alias("present"))
    return final.join(lined, "season", "left").join(pairs, "season", "left").fillna(0)


def missing_aggregates(stat: DataFrame, present: DataFrame) -> DataFrame:
    """Lines of the (date, team) pairs that ``present`` lacks: what a fill-in has to aggregate."""
    return stat.join(present.select("date", "team_id"), ["date", "team_id"], "left_anti")


def split_status(stat: DataFrame) -> DataFrame:
    """Per season how many lines have all shooting splits."""
    whole = " and ".join(f"{c} is not null" for c in ("fg3m", "fg3a", "ftm", "fta", "fga", "oreb"))
    return stat.groupBy("season").agg(F.count("*").alias("lines"), F.count_if(F.expr(whole)).alias("with_splits"))


def completeness(game: DataFrame, stat: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` final games without lines."""
    return game.where("status = 'Final'").join(stat, "game_id", "left_anti").select("season", "date", "game_id").orderBy("date", "game_id").limit(n)


def reranked(patterns: DataFrame, seasons: list[int], first: int = 1995, last: int = 1999, reference_date: str = "2001-01-01", n: int = 25, legs: int | None = None) -> DataFrame:
    """The ``n`` best of the stored night ``patterns`` (combo, legs, bits) by their hits in the seasons ``first`` to ``last``, of ``legs``
    keys if that is given: scores, longest gap, the older stability score and the first three hits.

    What scores don't need is worked out for the best ones alone."""
    at = [i for i, s in enumerate(seasons) if first <= s <= last]
    inside = [seasons[i] for i in at]
    words = F.flatten(F.array(*[F.slice("bits", SEASON_WORDS * i + 1, SEASON_WORDS) for i in at])) if at else F.array().cast("array<bigint>")
    own = patterns if legs is None else patterns.where(F.col("legs") == legs)
    best = rated(own.select("combo", "legs", words.alias("bits")), inside, reference_date, filtered=False).orderBy(F.desc("overall"), "combo").limit(n)
    dates = best.withColumn("dates", hit_dates(inside))
    gaps = F.transform(F.sequence(F.lit(1), F.size("dates") - 1), lambda i: F.datediff(F.element_at("dates", i + 1), F.element_at("dates", i)))
    mean = F.col("hits") / F.col("n_seasons")
    sd = F.sqrt(F.aggregate(F.filter("per", lambda h: h > 0), F.lit(0.0), lambda a, h: a + (h - mean) * (h - mean)) / F.col("n_seasons"))
    d = dates.withColumns({"longest_gap": F.when(F.size("dates") > 1, F.array_max(gaps)), "sd": sd})
    older = 10 * F.col("n_seasons") + 10 / (1 + F.col("sd")) - 15 * F.col("most") / F.col("hits") + F.coalesce(F.least(F.col("longest_gap") / 30, F.lit(5.0)), F.lit(0.0)) - F.col("legs")
    return d.select("combo", "legs", "hits", "n_seasons", F.round(mean, 2).alias("avg_hits"), F.round(F.col("most") / F.col("hits"), 3).alias("cluster_share"), "longest_gap", F.round(older, 4).alias("older_score"), "stability", "balance", "rarity", "recency", "overall", F.concat_ws(",", F.transform(F.slice("dates", 1, 3), lambda x: x.cast("string"))).alias("first_hits"))


def pattern_dates(patterns: DataFrame, seasons: list[int]) -> DataFrame:
    """(combo, legs, date, season) of every hit of the night ``patterns`` (combo, legs, bits)."""
    d = patterns.select("combo", "legs", F.explode(hit_dates(seasons)).alias("date"))
    return d.withColumn("season", (F.year("date") - F.when(F.month("date") < 10, 1).otherwise(0)).cast("int"))


def pattern_hits(dates: DataFrame, meta: DataFrame) -> DataFrame:
    """(combo, date, season, game_count, team_ids, metas): each hit with the date's games, the teams of all its events, and what each names.

    ``dates``: see pattern_dates. ``meta``: see night.event_meta. A hit meets its events by date and key; lists don't repeat."""
    named = dates.select("combo", "date", "season", F.explode(F.split("combo", r"\+")).alias("event_key")).join(meta.drop("season"), ["date", "event_key"])
    each = F.struct("event_key", *[F.col(f"{k}_ids") for k in ("team", "player", "game")])
    return named.groupBy("combo", "date", "season").agg(F.max("game_count").alias("game_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("team_ids")))).alias("team_ids"), F.array_sort(F.collect_list(each)).alias("metas"))


def explained(dates: DataFrame, combo: str) -> DataFrame:
    """(season, hits, first, last, place) of a pattern, its seasons in order."""
    own = dates.where(F.col("combo") == combo)
    return own.groupBy("season").agg(F.count("*").alias("hits"), F.min("date").alias("first"), F.max("date").alias("last"))


def subset_redundancy(patterns: DataFrame) -> DataFrame:
    """Stored ``patterns`` (combo, legs, hits) beside each stored one of a part of their keys, and how much the extra keys narrow the hits.

    A part holds wherever the whole does, so its containment is always whole; the pairs come from the keys
    alone: every pattern names its parts, which meet the stored ones on equality."""
    counts = patterns.select("combo", "hits")
    keys = F.split("combo", r"\+")
    part = lambda bits: F.array_join(F.filter(keys, lambda _, i: F.bit_get(bits, i) == 1), "+")
    parts = counts.where(F.size(keys) > 1).select("combo", "hits", F.explode(F.transform(F.sequence(F.lit(1), F.expr("shiftleft(1, size(split(combo, '[+]'))) - 2")), part)).alias("part"))
    simple = counts.select(F.col("combo").alias("part"), F.col("hits").alias("part_hits"))
    return parts.join(simple, "part").select("combo", "hits", "part", "part_hits", F.round(1 - F.col("hits") / F.col("part_hits"), 6).alias("hit_reduction"), F.lit("FULLY_REDUNDANT").alias("verdict"))


def near_duplicates(dates: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs of patterns of as many keys whose hit dates (see pattern_dates) have a Jaccard likeness of ``threshold``.

    Of two such sets of dates in order the first few of one hold one of the other's, so only those are joined on."""
    sets = dates.groupBy("combo", "legs").agg(F.array_sort(F.collect_set("date")).alias("dates")).withColumn("n", F.size("dates"))
    prefix = sets.select("combo", "legs", "n", F.explode(F.slice("dates", 1, F.expr(f"cast(n - ceil({threshold} * n) + 1 as int)"))).alias("d"))
    met = prefix.alias("a").join(prefix.alias("b"), ["d", "legs"]).where(f"a.combo < b.combo and least(a.n, b.n) >= {threshold} * greatest(a.n, b.n)").select("legs", F.col("a.combo").alias("a"), F.col("b.combo").alias("b")).distinct()
    both = met.join(sets.select(F.col("combo").alias("a"), F.col("dates").alias("x")), "a").join(sets.select(F.col("combo").alias("b"), F.col("dates").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("shared", shared).withColumn("likeness", F.col("shared") / (F.size("x") + F.size("y") - F.col("shared"))).where(F.col("likeness") >= threshold).select("legs", "a", "b", F.col("shared"), F.round("likeness", 6).alias("likeness"))


def support(patterns: DataFrame, nights: int | Column, n: int = 10) -> DataFrame:
    """The ``n`` best patterns with the share of nights that they hit."""
    return patterns.orderBy(F.desc("overall"), "combo").limit(n).select("combo", "hits", "overall", F.round(F.col("hits") / nights, 6).alias("support"))


def stored_and_live(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(date, event_key, stored, live, mismatch) of events on either side."""
    s, x = stored.select("date", "event_key").distinct().withColumn("s", F.lit(True)), live.select("date", "event_key").distinct().withColumn("l", F.lit(True))
    no = F.lit(False)
    return s.join(x, ["date", "event_key"], "full_outer").select("date", "event_key", F.coalesce("s", no).alias("stored"), F.coalesce("l", no).alias("live"), (F.coalesce("s", no) != F.coalesce("l", no)).alias("mismatch"))


def totals(lines: DataFrame) -> DataFrame:
    """Sums of every stat and the games of each player in ``lines``."""
    return lines.groupBy("player_id").agg(*[F.sum(s).alias(s) for s in STATS], F.count_distinct("game_id").alias("games"))


def listed(patterns: DataFrame, text: str | None = None, legs: int | None = None, n: int = 500) -> DataFrame:
    """The ``n`` best of ``patterns`` whose name holds ``text`` in any case and that have ``legs`` keys."""
    own = patterns if text is None else patterns.where(F.lower("combo").contains(text.lower()))
    return (own if legs is None else own.where(F.col("legs") == legs)).orderBy(F.desc("overall"), "combo").limit(n)


def latest_of(rows: DataFrame, by: list[str], n: int = 50) -> DataFrame:
    """The ``n`` latest rows (date) of each key, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date")))).where(F.col("place") <= n)


def recent_dates(game: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` latest dates with final games."""
    return game.where("status = 'Final'").select("date").distinct().orderBy(F.desc("date")).limit(n)


def watch_check(watched: DataFrame, events: DataFrame, dates: DataFrame, stat: DataFrame) -> DataFrame:
    """(combo, date, hit, has_stats): whether all keys of each watched pattern (combo, enabled) hold on each of ``dates``; dates without lines say so.

    ``watched`` and ``dates`` are a person's list and a few dates; every pattern meets every date."""
    keys = watched.where("enabled").select("combo").distinct().withColumn("event_key", F.explode(F.split("combo", r"\+")))
    every = keys.withColumn("date", F.explode(F.lit([r[0] for r in dates.collect()]).cast("array<date>")))
    held = every.join(events.select("date", "event_key", F.lit(1).alias("held")), ["date", "event_key"], "left")
    lined = stat.join(F.broadcast(dates), "date", "left_semi").select("date").distinct().withColumn("has_stats", F.lit(True))
    return held.groupBy("combo", "date").agg((F.count("held") == F.count("*")).alias("hit")).join(lined, "date", "left").fillna(False, ["has_stats"])


def watch_add(watched: DataFrame, combos: DataFrame) -> DataFrame:
    """The watchlist with ``combos`` (combo) on it and enabled, also those that were taken off."""
    new = combos.select("combo").distinct()
    return watched.join(new, "combo", "left_anti").select("combo", "enabled").unionByName(new.withColumn("enabled", F.lit(True)))


def watch_remove(watched: DataFrame, combos: DataFrame) -> DataFrame:
    return watched.join(combos.select("combo").distinct(), "combo", "left_anti")


def label(city, name, key) -> Column:
    """City and name as far as they are not empty, else # and the id."""
    text = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in (city, name)])
    return F.when(text != "", text).otherwise(F.concat(F.lit("#"), key.cast("string")))


def game_card(game: DataFrame, team: DataFrame) -> DataFrame:
    """A line per game of a night's report: date, game_id, both sides' labels and scores, the margin and who won (H, A or T)."""
    named = lambda side: team.select(F.col("team_id").alias(f"{side}_team_id"), label(F.col("city"), F.col("name"), F.col("team_id")).alias(f"{side}_label"))
    both = game.join(named("away"), "away_team_id", "left").join(named("home"), "home_team_id", "left")
    told = lambda side: F.coalesce(f"{side}_label", F.concat(F.lit("#"), F.col(f"{side}_team_id").cast("string"))).alias(side)
    ahead = F.col("home_score") - F.col("away_score")
    return both.select("date", "game_id", told("away"), "away_score", told("home"), "home_score", F.abs(ahead).alias("margin"), F.when(ahead > 0, "H").when(ahead < 0, "A").otherwise("T").alias("winner"))


def alignment(catalog: DataFrame, live: DataFrame) -> DataFrame:
    """(event_key, issue): keys of ``live`` (event_key) that the ``catalog`` (event_key) lacks, NOT_IN_CATALOG, and keys of it that nothing live has, NEVER_LIVE."""
    keys, seen = catalog.select("event_key").distinct(), live.select("event_key").distinct()
    return seen.join(keys, "event_key", "left_anti").withColumn("issue", F.lit("NOT_IN_CATALOG")).unionByName(keys.join(seen, "event_key", "left_anti").withColumn("issue", F.lit("NEVER_LIVE")))
