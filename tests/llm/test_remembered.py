"""What the packers spend time on: words merged again, windows put in order."""

import numpy as np

from slatewise.llm.packing import Encoder, default_tokenizer
from slatewise.llm.retrieval_packing import Index, windows


def test_known_words_are_not_merged_again(monkeypatch):
    code = Encoder(default_tokenizer())
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(200_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    ids = [code.encode(t) for t in texts]
    assert ids[7] == np.array(code.tokenizer.encode(texts[7], add_special_tokens=False).ids, dtype="<u4").tobytes()
    merged = []
    monkeypatch.setattr(Encoder, "_merge", lambda self, words: merged.extend(words) or [b""] * len(words))
    assert [code.encode(t) for t in texts] == ids and not merged


def test_windows_take_neighbours_in_order():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 40, rng.integers(1, 30)).astype("<u2") for _ in range(300)]
    idf = np.where(np.arange(40) < 4, 0, rng.random(40))
    got = list(windows(items, idf, 15.0, 64))
    index, lengths, used, rest, want = Index(items, idf, 15.0), [len(i) for i in items], set(), None, []
    while len(used) < len(items) or rest:
        if rest is None:
            i = min(set(range(300)) - used)
            used.add(i)
            rest = (i, 0, lengths[i])
        window, room, rest = [rest], 64 - (rest[2] - rest[1]), None
        scores = index.scores(index.of(window[0][0])[0])
        for i in sorted((i for i in range(300) if scores[i] > 0 and i not in used), key=lambda i: (-scores[i], i)):
            if lengths[i] <= room:
                window.append((i, 0, lengths[i]))
                used.add(i)
                room -= lengths[i]
        near = sorted((i for i in range(300) if scores[i] > 0 and i not in used), key=lambda i: (-scores[i], i))
        while room and len(used) < 300:
            i = near[0] if near else min(set(range(300)) - used)
            used.add(i)
            end = min(room, lengths[i])
            window.append((i, 0, end))
            room, rest = room - end, (i, end, lengths[i]) if end < lengths[i] else None
        want.append(window)
    assert got == want
