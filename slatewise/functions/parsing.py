"""Fields of landed records as columns: minutes, dates, seasons, names, surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Season types by the first three characters of a game id.
SEASON_TYPES = {"001": "PRE", "002": "REG", "003": "ASG", "004": "POST", "005": "PIT"}


def seconds(text: Column) -> Column:
    """Seconds of playing time of MM:SS, PT12M34.5S or a number of minutes; 0 for null, empty and anything else."""
    s = F.trim(text.cast("string"))
    part = lambda pattern, group: F.coalesce(F.regexp_extract(s, pattern, group).try_cast("double"), F.lit(0.0))
    clock, iso = r"^(\d+):(\d+)", r"^PT(?:(\d+)M)?(?:([0-9.]+)S)?$"
    number = s.try_cast("double")
    return F.when(s.rlike(clock), part(clock, 1) * 60 + part(clock, 2)).when(s.rlike(iso), part(iso, 1) * 60 + F.floor(part(iso, 2))).when(number > 0, F.round(number * 60)).otherwise(0).cast("int")


def date_only(text: Column) -> Column:
    """The first YYYY-MM-DD in a text, null where there is none."""
    return F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def eastern_date(utc: Column) -> Column:
    """The New York calendar date of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(utc, "America/New_York"))


def season_of(date: Column) -> Column:
    """October starts a season."""
    return F.year(date) - F.when(F.month(date) < 10, 1).otherwise(0)


def season_of_label(label: Column) -> Column:
    """2024 of "2024-25"."""
    return F.split(label, "-")[0].try_cast("int")


def season_type(game_id: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SEASON_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.substring(game_id, 1, 3)), F.lit("REG"))


def is_regular(stage: Column, league: Column) -> Column:
    return (stage.cast("string") == "2") & (F.lower(F.coalesce(league, F.lit("standard"))) == "standard")


def did_not_play(comment: Column, *stats: Column) -> Column:
    """A comment that says so, or nothing but zeros and nulls."""
    said = F.lower(F.coalesce(comment, F.lit("")))
    idle = F.lit(True)
    for s in stats:
        idle = idle & (F.coalesce(s, F.lit(0)) == 0)
    return said.contains("dnp") | said.contains("did not play") | idle


def canonical(name: Column) -> Column:
    """Lower-case letters and digits of a team's name."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def surrogate_id(text: Column) -> Column:
    """A negative id from a text: the 32-bit hash of factor 31 over its characters, its sign taken off."""
    wrapped = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)))
    return -F.abs(F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped))
