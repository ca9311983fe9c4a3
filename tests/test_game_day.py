"""What the days and match-ups of games need of the derived tables, and no more."""

import pytest

from slatewise import registry
from slatewise.plans import queries as q
from slatewise.sources.fixtures import Tables


@pytest.mark.parametrize(("name", "kept"), [("fl05_game_day", {"game", "team"}), ("tk07_matchups", {"game", "team", "stat", "odds", "line", "context"})])
def test_tables_made(spark, sf_dir, monkeypatch, name, kept):
    fx = Tables(spark, sf_dir)
    monkeypatch.setattr(q, "frames", lambda *_: fx)
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
    assert set(fx.kept) == kept
