"""Patterns held against games: predictions, picks, prop lines and the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.parsing import eastern_date
from slatewise.functions.significance import kelly
from slatewise.operators.games import OUTCOMES, TENS
from slatewise.operators.mining import OUTCOME_KEYS, first_matches, hit_bit, matches

#: Outcomes of any player, which name nobody to bet on.
PLAYER_OUTCOMES = ("PLAYER_30_PLUS", "PLAYER_40_PLUS", "PLAYER_DOUBLE_DOUBLE", "PLAYER_TRIPLE_DOUBLE", "PLAYER_10_PLUS_ASSISTS", "PLAYER_10_PLUS_REBOUNDS", "PLAYER_5_PLUS_THREES")
#: The average by which an outcome's word names the player that it is about.
TARGETS = {"SCORER": "ppg", "REBOUNDER": "rpg", "ASSIST": "apg"}
#: Days of play that a pattern's recent performance looks back.
RECENT = 30


def base_outcome() -> Column:
    return F.substring_index("outcome", ":", 1)


def met_patterns(games: DataFrame, patterns: DataFrame) -> DataFrame:
    """``games`` (game_id, date, codes, low, high and what else they have) beside each of ``patterns`` that fits; ``combo`` is its name."""
    met = matches(games.drop("season"), patterns)
    return met.withColumnsRenamed({"combo": "code", "name": "combo"})


def first_patterns(games: DataFrame, patterns: DataFrame, order: list[Column | str], n: int, each: str | None = None) -> DataFrame:
    """``games`` beside the first ``n`` of ``patterns`` in ``order`` that fit (see mining.first_matches); ``combo`` is its name, as in ``order``."""
    named = patterns.withColumns({"code": F.col("combo"), "_name": F.col("name")}).drop("name")
    order = [F.col("_name") if isinstance(c, str) and c == "combo" else c for c in order]
    met = first_matches(games.drop("season"), named, order, n, each)
    return met.withColumn("combo", F.col("_name")).drop("_name")


def predictions(slate: DataFrame, patterns: DataFrame, per_game: int = 10, player: bool = False) -> DataFrame:
    """The patterns that fit a game of ``slate``, with their scores and place: by confidence, then value; at most ``per_game`` of a game.

    ``patterns``: see mining.top. ``player`` keeps the outcomes of any player, else all."""
    asked = patterns.where(base_outcome().isin(*PLAYER_OUTCOMES)) if player else patterns
    return first_patterns(slate, asked, [F.desc("confidence"), F.desc("value"), "combo", "outcome"], per_game)


def notable_players(players: DataFrame, most: int = 20, n: int = 6) -> DataFrame:
    """(game_id, player_id, rank, by, place): of each game the ``n`` players of the best rank by any average, of those ranked ``most`` or better."""
    ranks = [(F.coalesce(F.col(f"rank_{a}"), F.lit(1 << 30)), a) for a in ("ppg", "rpg", "apg")]
    best = F.least(*[r for r, _ in ranks])
    by = F.coalesce(*[F.when(r == best, F.lit(a)) for r, a in ranks])
    order = Window.partitionBy("game_id").orderBy("rank", "player_id")
    return players.select("game_id", "player_id", best.alias("rank"), by.alias("by")).where(F.col("rank") <= most).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def bet_type(outcome: Column) -> Column:
    """The kind of bet that an outcome is; the first that fits. Substrings are fixed values."""
    has = lambda *parts: outcome.rlike("|".join(parts))
    return F.when(has("COVERED", "SPREAD"), "spread").when(has("OVER_HIT", "UNDER_HIT", "TOTAL_"), "total").when(has("_WIN"), "moneyline").when(has("SCORER", "REBOUNDER", "ASSIST", "DOUBLE", "TRIPLE", "PLAYER_"), "player_prop").otherwise("other")


def pick_grade(edge: Column, sample: Column, seasons: Column) -> Column:
    """Letters by edge, sample and seasons. Bounds are fixed values."""
    a = ((edge >= 0.15) & (sample >= 200) & (seasons >= 5)) | ((edge >= 0.10) & (sample >= 150) & (seasons >= 4))
    return F.when(a, "A").when((edge >= 0.08) & (sample >= 100) & (seasons >= 3), "B").when((edge >= 0.05) & (sample >= 75), "C").otherwise("D")


def picks(slate: DataFrame, patterns: DataFrame, least: str = "B", min_confidence: float = 0.70, min_edge: float = 0.05, also: tuple[str, ...] = ()) -> DataFrame:
    """Bets on games of ``slate`` of at least grade ``least``, with the Kelly stake (at most a quarter) in units.

    Of ``patterns`` those of high confidence whose hit rate is the break-even rate and ``min_edge`` at least. ``also``: columns of either that stay."""
    edge = F.round("edge", 9)
    stake = F.round(kelly(F.col("hit_rate"), F.lit(-110), 0.25), 9)
    good = patterns.where((F.col("confidence") >= min_confidence) & (edge >= min_edge)).withColumn("grade", pick_grade(edge, F.col("sample"), F.col("n_seasons"))).where(F.col("grade") <= least)
    # all that a bet tells is the pattern's, so it is worked out before the games are met
    told = good.select("combo", "name", "outcome", bet_type(F.col("outcome")).alias("bet_type"), F.round("hit_rate", 6).alias("hit_rate"), "sample", "grade", F.round(kelly(F.col("hit_rate"), F.lit(-110), 0.25), 6).alias("kelly"), (F.round(stake * 1000) / 10).alias("units"), *[c for c in also if c in patterns.columns])
    return met_patterns(slate, told).select("game_id", "date", "combo", "outcome", "bet_type", "hit_rate", "sample", "grade", "kelly", "units", *also)


def pick_totals(picked: DataFrame) -> DataFrame:
    """Per date, grade and kind of bet: picks, games and units staked."""
    return picked.groupBy("date", "grade", "bet_type").agg(F.count("*").alias("picks"), F.count_distinct("game_id").alias("games"), F.round(F.sum("units"), 4).alias("units"))


# ---- players and their lines
def target_of(outcome: Column) -> tuple[Column, Column]:
    """(side, average) of the player that an outcome is about; null where it is about none."""
    side = F.when(outcome.startswith("HOME_TOP_"), "home").when(outcome.startswith("AWAY_TOP_"), "away")
    average = F.coalesce(*[F.when(outcome.contains(f"TOP_{w}"), F.lit(a)) for w, a in TARGETS.items()])
    return side, F.when(side.isNotNull(), average)


def with_targets(met: DataFrame, tops: DataFrame) -> DataFrame:
    """``met`` (game_id, outcome) with target_side, target_stat, target_player and target_value: the top player of the side by that average.

    ``tops``: game_id, side, stat, player_id, value."""
    side, stat = target_of(F.col("outcome"))
    t = tops.select("game_id", F.col("side").alias("target_side"), F.col("stat").alias("target_stat"), F.col("player_id").alias("target_player"), F.col("value").alias("target_value"))
    return met.withColumns({"target_side": side, "target_stat": stat}).join(t, ["game_id", "target_side", "target_stat"], "left")


def game_tops() -> Column:
    """The top players of a game's row (see games.wide_games) as structs of player_id and value: by side and average, in the order of with_own_targets."""
    return F.array(*[F.struct(F.col(f"{s}_top_{a}_player_id").alias("player_id"), F.col(f"{s}_top_{a}_{a}").alias("value")) for s in ("home", "away") for a in TARGETS.values()])


def with_own_targets(met: DataFrame, tops: str) -> DataFrame:
    """``with_targets`` of rows that have their game's top players as the column ``tops`` (see game_tops; null: none are known)."""
    side, stat = target_of(F.col("outcome"))
    place = F.when(side == "away", len(TARGETS)).otherwise(0) + F.array_position(F.array(*[F.lit(a) for a in TARGETS.values()]), stat).cast("int") - 1
    return met.withColumns({"target_side": side, "target_stat": stat}).withColumn("_top", F.get(tops, place)).withColumns({"target_player": F.col("_top.player_id"), "target_value": F.col("_top.value")}).drop("_top")


#: The lines that outcomes ask for: the average by which the player is a side's top, and the market.
LINED = (("ppg", "player_points"), ("rpg", "player_rebounds"), ("rpg", "player_points"))


def asked_line() -> Column:
    """What line an outcome asks for: its ``kind`` (place in LINED; null: none), the ``least`` it must be, whether the home side is its ``own``, and whether only that side's line fits."""
    o = F.col("outcome")
    half = lambda n: F.lit(n - 1.5)
    points, rebounds, double = o.rlike("TOP_SCORER_(25|30)_PLUS"), o.rlike("REBOUNDER_1[02]_PLUS|10_PLUS_REBOUNDS"), o.contains("DOUBLE_DOUBLE")
    least = F.when(points, F.when(o.contains("30"), half(30)).otherwise(half(25))).when(rebounds, F.when(o.contains("12"), half(12)).otherwise(half(10))).otherwise(F.lit(float("-inf")))
    return F.struct(F.when(points, 0).when(rebounds, 1).when(double, 2).alias("kind"), least.alias("least"), (double | o.contains("HOME") | (rebounds & ~o.contains("AWAY"))).alias("home"), points.alias("alone"))


def first_lines(tops: DataFrame, props: DataFrame) -> DataFrame:
    """(game_id, lines): per game and side, of each kind of LINED, the first line by name of those that hold the top player's last name.

    ``tops``: game_id, side, stat, lastname. ``props``: game_id, player (a name), market, line."""
    top = tops.where(F.col("stat").isin(*{a for a, _ in LINED})).select("game_id", "side", "stat", F.lower("lastname").alias("lastname"))
    met = top.join(props, "game_id").where(F.lower("player").contains(F.col("lastname")))
    kinds = lambda side: F.array(*[F.min(F.when((F.col("side") == side) & (F.col("stat") == a) & (F.col("market") == m), F.struct("player", "line"))) for a, m in LINED])
    return met.groupBy("game_id").agg(kinds("home").alias("home"), kinds("away").alias("away")).select("game_id", F.struct("home", "away").alias("lines"))


def _fitting() -> list[Column]:
    """prop_player and prop_line from ``_asked`` (see asked_line) and ``lines`` (see first_lines)."""
    ask, home = F.col("_asked"), F.col("_asked.home")
    of = lambda own: F.get(F.when(home == own, F.col("lines.home")).otherwise(F.col("lines.away")), ask["kind"])
    fits = lambda line: F.when(line["line"] >= ask["least"], line)
    one = F.coalesce(fits(of(True)), F.when(~ask["alone"], fits(of(False))))
    return [one["player"].alias("prop_player"), one["line"].alias("prop_line")]


def with_prop_lines(picked: DataFrame, tops: DataFrame, props: DataFrame) -> DataFrame:
    """``picked`` (game_id, combo, outcome) with prop_player and prop_line: the line of the market that fits the outcome.

    ``tops``: game_id, side, stat, lastname. ``props``: game_id, player (a name), market, line. A line fits the
    outcome's player where its name holds the last name; the first by name stands. Points and rebounds must lie at
    the outcome's bound, less one, at least; where the own side's top rebounder has no such line the other side's stands. A double-double
    takes the points of a side's top rebounder, the home side's first.
    Lines and players meet within a game."""
    asked = picked.withColumn("_asked", asked_line()).join(first_lines(tops, props), "game_id", "left")
    return asked.select(*picked.columns, *_fitting())


def lined_picks(slate: DataFrame, patterns: DataFrame, tops: DataFrame, props: DataFrame, **bounds) -> DataFrame:
    """(game_id, combo, outcome, prop_player, prop_line): ``picks`` as with_prop_lines has them. Games take their lines along before patterns meet
    them and patterns what they ask for, so that no pick is shuffled."""
    met = picks(slate.join(first_lines(tops, props), "game_id", "left"), patterns.withColumn("_asked", asked_line()), also=("_asked", "lines"), **bounds)
    return met.select("game_id", "combo", "outcome", *_fitting())


# ---- the feed
def game_day(games: DataFrame) -> DataFrame:
    """``games`` (date, tipoff) with ``day``, the Eastern date of the tip-off, or the stored date where there is none; of a game whose
    dates are more than a day apart neither is taken."""
    return games.withColumn("day", F.coalesce(eastern_date(F.col("tipoff")), F.col("date"))).where(F.abs(F.datediff("day", "date")) <= 1)


def on_day(games: DataFrame, day: str) -> DataFrame:
    """The games of a day: only rows stored within a day of it are read."""
    d = F.lit(day).cast("date")
    return game_day(games.where(F.col("date").between(F.date_sub(d, 1), F.date_add(d, 1)))).where(F.col("day") == d)


def one_of_matchup(games: DataFrame) -> DataFrame:
    """Of the rows of a day and match-up (day, away_code, home_code) one: with context, with odds, of the earliest tip-off, then of the smallest id."""
    order = Window.partitionBy("day", "away_code", "home_code").orderBy(F.desc("has_context"), F.desc("has_odds"), F.asc_nulls_first("tipoff"), "game_id")
    return games.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def team_ids_of_code(team: DataFrame) -> DataFrame:
    """(team_id, same_id): all ids that stand for the team of an id, by its code; a team without a code has none."""
    return team.where("code is not null").select("team_id", "code").join(team.select("code", F.col("team_id").alias("same_id")), "code").select("team_id", "same_id")


def daily_hits(own: DataFrame, patterns: DataFrame) -> DataFrame:
    """(name, outcome, date, hit, games): of each of ``patterns`` (see mining.top) the games of a day that it fits and its hits among them.

    Games are dealt by days first, so that a task sums few days of each pattern and what fits is not shuffled."""
    near = own.select("date", "bits", "codes", "low", "high").repartitionByRange(4 * own.sparkSession.sparkContext.defaultParallelism, "date")
    met = matches(near, patterns.select("combo", "o"))
    days = met.groupBy("combo", "o", "date").agg(F.sum(hit_bit()).alias("hit"), F.count("*").alias("games"))
    return days.join(F.broadcast(patterns.select("combo", "o", "name", "outcome")), ["combo", "o"]).select("name", "outcome", "date", "hit", "games")


def recent_performance(hits: DataFrame, asked: DataFrame, days: int = RECENT) -> DataFrame:
    """``asked`` (combo, outcome, date; distinct) with recent_hits and recent_games of the ``days`` before the date, 0 where there are none.

    ``hits``: name, outcome, date, hit, or days of them as daily_hits has them. Days are summed first; one window over a pattern's days answers all dates."""
    day = F.datediff("date", F.lit("1990-01-01").cast("date"))
    daily = hits.groupBy(F.col("name").alias("combo"), "outcome", day.alias("day")).agg(F.sum("hit").alias("h"), F.sum("games" if "games" in hits.columns else F.lit(1)).alias("g"))
    both = daily.unionByName(asked.select("combo", "outcome", day.alias("day"), "date").withColumn("asked", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy("combo", "outcome").orderBy("day").rangeBetween(-days, -1)
    out = both.withColumns({"recent_hits": F.coalesce(F.sum("h").over(before), F.lit(0)), "recent_games": F.coalesce(F.sum("g").over(before), F.lit(0))})
    return out.where("asked").select("combo", "outcome", "date", "recent_hits", "recent_games")


def feed(games: DataFrame, patterns: DataFrame, per_game: int = 10) -> DataFrame:
    """Per game its best pattern for each outcome one can bet on, the best ``per_game`` of them: rate, whether of high value, kind of bet, how
    many such outcomes there are, and for played games (with ``bits``) whether the outcome came."""
    rate = F.round("hit_rate", 9)
    asked = patterns.where(~base_outcome().isin(*PLAYER_OUTCOMES))
    ranked = first_patterns(games, asked, [F.desc(rate), F.desc("sample"), "outcome", "combo"], per_game, "outcome").withColumnRenamed("values", "outcomes")
    high = F.col("outcome").rlike("UNDERDOG_COVERED|FAVORITE_COVERED") | ((rate >= 0.65) & (F.col("sample") >= 100))
    result = (hit_bit() == 1).alias("result")
    return ranked.select("game_id", "date", "place", "outcomes", "combo", "outcome", F.round("hit_rate", 6).alias("hit_rate"), "sample", high.alias("high_value"), bet_type(F.col("outcome")).alias("bet_type"), result)


#: The line of a game that an outcome of any player is about: its condition and the number that is told, with its unit.
FIRST_LINES = {
    "PLAYER_30_PLUS": ("points >= 30", "points", "pts"), "PLAYER_40_PLUS": ("points >= 40", "points", "pts"), "PLAYER_DOUBLE_DOUBLE": (f"{TENS} >= 2", None, None), "PLAYER_TRIPLE_DOUBLE": (f"{TENS} >= 3", None, None),
    "PLAYER_10_PLUS_ASSISTS": ("assists >= 10", "assists", "ast"), "PLAYER_10_PLUS_REBOUNDS": ("rebounds >= 10", "rebounds", "reb"), "PLAYER_5_PLUS_THREES": ("fg3m >= 5", "fg3m", "3PM"),
}
#: The number that is told of a side's top player by each average, with its unit.
TOP_NUMBERS = {"ppg": ("points", "pts"), "rpg": ("rebounds", "reb"), "apg": ("assists", "ast")}


def _first_wide(lines: DataFrame) -> DataFrame:
    """One row per game with a line that made an outcome of FIRST_LINES hold: of each outcome, side by side, the smallest player_id of such
    lines and the number that it tells, where it tells one. One aggregation over ``lines`` (game_id, player_id, stats), in each task first."""
    firsts = [f for o, (e, c, _) in FIRST_LINES.items() for who in [F.when(F.expr(e), F.col("player_id"))] for f in (F.min(who).alias(f"{o}_id"), *([F.min_by(c, who).alias(f"{o}_number")] if c else []))]
    return lines.where(F.expr(" or ".join(f"({e})" for e, _, _ in FIRST_LINES.values()))).groupBy("game_id").agg(*firsts)


def _first_told() -> dict[str, tuple[Column, Column]]:
    """(player_id, said) of each outcome of FIRST_LINES from the columns of ``_first_wide``."""
    return {o: (F.col(f"{o}_id"), F.concat(F.col(f"{o}_number").cast("string"), F.lit(f" {unit}")) if c else F.lit(None).cast("string")) for o, (_, c, unit) in FIRST_LINES.items()}


def _who_said() -> tuple[Column, Column]:
    """The player that an outcome ``_name`` is about and what is told of it, from the columns of ``_known``."""
    name = F.col("_name")
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    signed = lambda c: F.concat(F.when(c > 0, "+").otherwise(""), number(c))
    who, said = [], []
    for side in ("home", "away"):
        for word, average in TARGETS.items():
            stat, unit = TOP_NUMBERS[average]
            own = name.startswith(f"{side.upper()}_TOP_{word}")
            who.append(F.when(own, F.col(f"{side}_top_{average}_player_id")))
            said.append(F.when(own & ~name.endswith("DOUBLE_DOUBLE"), F.concat(F.col(f"{side}_top_{average}_{stat}").cast("string"), F.lit(f" {unit}"))))
    margin, spread = F.col("home_score") - F.col("away_score"), F.col("spread_home")
    cover = lambda m, s: F.concat(F.lit("margin "), signed(m), F.lit(" (spread: "), signed(s), F.lit(")"))
    said.append(F.when(name == "HOME_COVERED", cover(margin, spread)).when(name == "AWAY_COVERED", cover(-margin, -spread)))
    said.append(F.when(name.isin("OVER_HIT", "UNDER_HIT"), F.concat(number(F.col("home_score") + F.col("away_score")), F.lit(" total (line: "), number(F.col("total_over")), F.lit(")"))))
    for o, (player, number_said) in _first_told().items():
        who.append(F.when(name == o, player))
        said.append(F.when(name == o, number_said))
    return F.coalesce(*who), F.coalesce(*said)


#: What an explanation needs of a game's row.
NEEDED = ("game_id", "home_score", "away_score", "spread_home", "total_over", *(f"{s}_top_{a}_{c}" for s in ("home", "away") for a, (stat, _) in TOP_NUMBERS.items() for c in ("player_id", stat)))


def _called(told: DataFrame, names: DataFrame | None) -> DataFrame:
    """``told`` (_player, _said) with ``explanation``."""
    called = F.concat(F.lit("Player "), F.col("_player").cast("string"))
    if names is not None:
        told = told.join(F.broadcast(names.select(F.col("player_id").alias("_player"), F.col("name").alias("_called"))), "_player", "left")
        called = F.coalesce("_called", called)
    return told.withColumn("explanation", F.nullif(F.concat_ws(", ", called, "_said"), F.lit("")))


def explained(hits: DataFrame, wide: DataFrame, lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``hits`` (game_id, outcome), outcomes that held, with ``explanation``: what made them hold.

    An outcome of a side's top player names the player and the number it is about; one of any player the first line that reached the bound, with
    its points, rebounds, assists or three-pointers; a double-double the player alone. Covers of the home or away side tell the margin and
    the spread as that side sees them, overs and unders the total and the line. The rest, and games without what is needed, have null.
    A player is called by ``names`` (player_id, name), by number where no name is known.
    ``wide``: a game's scores, line and top players; ``lines``: player lines."""
    # what is known of a game meets once, in one row, and each hit meets that: a hit takes nothing along to a second join
    known = wide.select(*NEEDED).join(_first_wide(lines), "game_id", "full")
    asked = hits.select("game_id", base_outcome().alias("_name"), F.struct(*hits.columns).alias("_hit"))
    who, said = _who_said()
    told = asked.join(known, "game_id", "left").select("_hit", who.alias("_player"), said.alias("_said"))
    return _called(told, names).select("_hit.*", "explanation")


def explained_games(wide: DataFrame, lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(game_id, outcome, explanation): ``explained`` of all outcomes that hold in the games of ``wide`` (see games.wide_games). A game takes the places of its
    outcomes along to its lines, so that games are shuffled and not what holds in them."""
    came = F.array_compact(F.array(*[F.when(F.expr(e), F.lit(i)) for i, e in enumerate(OUTCOMES.values())]))
    known = wide.select(*NEEDED, came.alias("_came")).join(_first_wide(lines), "game_id", "left")
    name = F.get(F.array(*[F.lit(k) for k in OUTCOMES]), F.col("_at"))
    who, said = _who_said()
    told = known.select("*", F.explode("_came").alias("_at")).withColumn("_name", name).select("game_id", F.concat("_name", F.lit(":game")).alias("outcome"), who.alias("_player"), said.alias("_said"))
    return _called(told, names).select("game_id", "outcome", "explanation")


def settled(met: DataFrame, events: DataFrame) -> DataFrame:
    """Predictions with ``result``: whether the outcome is among the game's events, under its own key or another side's; null for games without any."""
    own = events.select("game_id", F.substring_index("event_key", ":", 1).alias("base"), F.lit(True).alias("seen")).distinct()
    known = events.select("game_id").distinct().withColumn("known", F.lit(True))
    out = met.withColumn("base", base_outcome()).join(own, ["game_id", "base"], "left").join(known, "game_id", "left")
    return out.withColumn("result", F.when(F.col("known"), F.coalesce("seen", F.lit(False)))).drop("base", "seen", "known")


def settled_hits(games: DataFrame, patterns: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """``patterns`` (see mining.top) that fit a game of ``games`` (with codes, low, high), with ``result`` as ``settled`` has it.

    Each game takes its events' outcomes along as bits, so that what is shuffled are games and not what fits them. Without ``events`` these are
    the ``bits`` of ``games`` (see mining.profiles), made of the same events; a game that a pattern fits has events."""
    if events is not None:
        number = F.create_map(*[F.lit(x) for i, k in enumerate(OUTCOME_KEYS) for x in (k.split(":")[0], i)])
        place = F.try_element_at(number, F.substring_index("event_key", ":", 1))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        own = events.groupBy("game_id").agg(F.coalesce(F.bit_or(one), F.lit(0).cast("long")).alias("bits"))
        games = games.drop("bits").join(own, "game_id", "left")
    return met_patterns(games, patterns).withColumn("result", hit_bit() == 1)


def latest_before(rows: DataFrame, by: list[str], date: str) -> DataFrame:
    """The latest row of each key before a date."""
    order = Window.partitionBy(*by).orderBy(F.desc("date"), F.desc("game_id"))
    return rows.where(F.col("date") < F.lit(date).cast("date")).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
