"""Blocks lay games of the same conditions side by side, so that counting passes over most words."""

import numpy as np

from slatewise.operators import vertical


def test_games_of_a_condition_share_words(spark):
    rows = [(g, 2000 + g % 2, [g % 8], g % 3) for g in range(4096)]
    table, total = vertical.blocks(spark.createDataFrame(rows, "game_id long, season int, codes array<int>, bits long"), 8, 2)
    words = np.concatenate([np.frombuffer(r.words, "<u8").reshape(11, -1) for r in table.collect()], axis=1)
    assert total == table.count() and int(np.bitwise_count(words[0]).sum()) == 4096
    for code in range(8):
        row = words[3 + code]
        assert int(np.bitwise_count(row).sum()) == 512
        assert np.count_nonzero(row) <= 512 // 64 + 2 * total + 1
