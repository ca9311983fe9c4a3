"""Games, player lines and odds derived from the driver's tables, and the same as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.sources.kept import keep, shared_dir

BASE = ("region", "nation", "customer", "orders", "lineitem")

#: Common table expressions that Spark and DuckDB read alike: only floors and integer arithmetic.
CTES = {
    "fx_team": "select cast(n_nationkey + 1 as int) team_id, n_name name, concat('N', cast(n_nationkey as string)) code, r_name city from nation join region on n_regionkey = r_regionkey",
    "fx_game": """select game_id, date, cast(year(date) - case when month(date) < 10 then 1 else 0 end as int) season, home_team_id, cast((home_team_id + game_id % 24) % 25 + 1 as int) away_team_id,
        case when final then cast(85 + price % 61 as int) else 0 end home_score, case when final then cast(85 + cast(floor(price / 61) as bigint) % 61 as int) else 0 end away_score, case when final then 'Final' else 'Scheduled' end status
        from (select cast(o_orderkey as bigint) game_id, cast(o_orderdate as date) date, cast(c_nationkey + 1 as int) home_team_id, cast(floor(o_totalprice) as bigint) price, o_orderstatus <> 'P' final from orders join customer on o_custkey = c_custkey) o""",
    "fx_stat": """select game_id, date, season, player_id, cast(case when l_linenumber % 2 = 1 then home_team_id else away_team_id end as int) team_id, cast(floor(l_quantity) as int) points, cast(x % 22 as int) rebounds,
        cast(cast(floor(x / 22) as bigint) % 18 as int) assists, cast(l_suppkey % 7 as int) steals, cast(l_partkey % 7 as int) blocks, cast((game_id + l_linenumber) % 12 as int) turnovers, cast(600 + x % 2400 as int) secs,
        cast(case when season > 1994 then x % 13 end as int) fg3m, cast(case when season > 1994 then x % 13 + l_suppkey % 6 end as int) fg3a, cast(case when season > 1994 then l_partkey % 13 end as int) ftm,
        cast(case when season > 1994 then l_partkey % 13 + x % 3 end as int) fta, cast(case when season > 1994 then 5 + x % 20 end as int) fga, cast(case when season > 1994 then x % 6 end as int) oreb
        from (select g.game_id, g.date, g.season, g.home_team_id, g.away_team_id, cast(l_partkey % 300 + 1 as int) player_id, l_linenumber, l_quantity, l_suppkey, l_partkey, cast(floor(l_extendedprice) as bigint) x,
        row_number() over (partition by g.game_id, l_partkey % 300 order by l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_shipdate) rn from lineitem join fx_game g on l_orderkey = g.game_id where g.status = 'Final') s where rn = 1""",
    "fx_odds": """select game_id, 'fanduel' source, cast((game_id % 31 - 15) / 2.0 as double) spread_home, cast(200 + game_id % 61 as double) total_over from fx_game where game_id % 4 <> 0
        union all select game_id, 'draftkings' source, cast((game_id % 31 - 15) / 2.0 + 0.5 as double) spread_home, cast(201 + game_id % 61 as double) total_over from fx_game where game_id % 3 = 0""",
    # the first of the books in this order, one row per game (the consensus line)
    "fx_line": "select game_id, spread_home, total_over from (select *, row_number() over (partition by game_id order by case source when 'fanduel' then 1 when 'draftkings' then 2 when 'betmgm' then 3 when 'pointsbet' then 4 else 5 end) rn from fx_odds) o where rn = 1",
}


def with_ctes(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` over the fixture tables as one statement; each part is worked out once."""
    parts = CTES | (extra or {})
    return "with " + ", ".join(f"{n} as materialized ({q})" for n, q in parts.items()) + " " + select


class Tables:
    """The fixture tables of one folder, and what is derived from them, each written once and read back.

    Queries over the same tables share them, so that no plan holds more than its own work."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.kept: dict = {}

    def once(self, name: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
        """The table ``name``, from ``build`` (of these tables) where it isn't there yet."""
        if name not in self.kept:
            self.kept[name] = keep(build(self), name)
        return self.kept[name]

    def __getattr__(self, name: str) -> DataFrame:
        view = f"fx_{name}"
        if view not in CTES:
            raise AttributeError(name)
        return self.once(name, lambda _: self._fixture(view))

    def _fixture(self, view: str) -> DataFrame:
        for t in BASE:
            self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        for other in CTES:
            if other != view and other in CTES[view]:
                getattr(self, other.removeprefix("fx_")).createOrReplaceTempView(other)
        return self.spark.sql(CTES[view])


_known: dict[tuple[str, str, str], tuple[int, Tables]] = {}


def files_state(spark: SparkSession, sf_dir: str) -> int:
    """A number that tells whether any file of the base tables was changed, added or taken away: of names, lengths and times, no content is read."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in BASE])
    return files.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()[0]


def frames(spark: SparkSession, sf_dir: str) -> Tables:
    """The fixture tables of ``sf_dir``: team, game, stat, odds, line; the same object as long as the application runs and the files stay as they are."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir)
    state = files_state(spark, sf_dir)
    if key not in _known or _known[key][0] != state:
        _known[key] = state, Tables(spark, sf_dir)
    return _known[key][1]
