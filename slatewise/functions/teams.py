"""The league's teams: fixed values, and the names that stand for them."""

from __future__ import annotations

import re

#: Internal id, provider's id, code, city, name.
TEAMS = (
    (1, 1610612737, "ATL", "Atlanta", "Hawks"), (2, 1610612738, "BOS", "Boston", "Celtics"), (3, 1610612751, "BKN", "Brooklyn", "Nets"), (4, 1610612766, "CHA", "Charlotte", "Hornets"), (5, 1610612741, "CHI", "Chicago", "Bulls"),
    (6, 1610612739, "CLE", "Cleveland", "Cavaliers"), (7, 1610612742, "DAL", "Dallas", "Mavericks"), (8, 1610612743, "DEN", "Denver", "Nuggets"), (9, 1610612765, "DET", "Detroit", "Pistons"), (10, 1610612744, "GSW", "Golden State", "Warriors"),
    (11, 1610612745, "HOU", "Houston", "Rockets"), (12, 1610612754, "IND", "Indiana", "Pacers"), (13, 1610612746, "LAC", "Los Angeles", "Clippers"), (14, 1610612747, "LAL", "Los Angeles", "Lakers"), (15, 1610612763, "MEM", "Memphis", "Grizzlies"),
    (16, 1610612748, "MIA", "Miami", "Heat"), (17, 1610612749, "MIL", "Milwaukee", "Bucks"), (18, 1610612750, "MIN", "Minnesota", "Timberwolves"), (19, 1610612740, "NOP", "New Orleans", "Pelicans"), (20, 1610612752, "NYK", "New York", "Knicks"),
    (21, 1610612760, "OKC", "Oklahoma City", "Thunder"), (22, 1610612753, "ORL", "Orlando", "Magic"), (23, 1610612755, "PHI", "Philadelphia", "76ers"), (24, 1610612756, "PHX", "Phoenix", "Suns"), (25, 1610612757, "POR", "Portland", "Trail Blazers"),
    (26, 1610612758, "SAC", "Sacramento", "Kings"), (27, 1610612759, "SAS", "San Antonio", "Spurs"), (28, 1610612761, "TOR", "Toronto", "Raptors"), (29, 1610612762, "UTA", "Utah", "Jazz"), (30, 1610612764, "WAS", "Washington", "Wizards"),
)
#: What else a team is called.
NICKNAMES = {"CLE": ("cavs",), "DAL": ("mavs",), "LAC": ("laclippers",), "LAL": ("lalakers",), "MIN": ("wolves",), "PHI": ("sixers",), "POR": ("blazers",)}


def _plain(text: str) -> str:
    return re.sub("[^a-z0-9]", "", text.lower())


def aliases() -> list[tuple[int, str, str]]:
    """(place, alias, canonical name): full name, name, nicknames and code of each team, in the order in which a part of a name is looked for."""
    rows = []
    for _, _, code, city, name in TEAMS:
        for alias in (_plain(city + name), _plain(name), *NICKNAMES.get(code, ()), code.lower()):
            rows.append((len(rows), alias, _plain(name.split()[-1])))
    return rows
