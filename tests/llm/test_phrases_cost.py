"""Steps of the removal of repeated phrases that did the same work more than once."""

import numpy as np

from artifactlake.llm import phrases


class Asked(np.ndarray):
    """Counts how often stretches are looked at."""

    looks = 0

    def __getitem__(self, at):
        Asked.looks += 1
        return np.ndarray.__getitem__(self, at)


def test_known_words_are_not_looked_at_again():
    width, tile = 6, 3
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    passages = [words[:1000], words[500:1500], words[100:130]]
    text = np.concatenate([words[200:1200], rng.integers(0, 1 << 63, 40, dtype=np.uint64), words[:5], words[7:20]])
    gone = np.zeros(len(text), bool).view(Asked)
    Asked.looks = 0
    for automaton in phrases.compile_tiles(passages, tile):
        phrases.locate(text, phrases.letters(text), automaton, passages, tile, width, gone)
    want = np.zeros(len(text), bool)
    places = {p[i : i + width].tobytes() for p in passages for i in range(len(p) - width + 1)}
    for i in range(len(text) - width + 1):
        if text[i : i + width].tobytes() in places:
            want[i : i + width] = True
    assert np.array_equal(np.asarray(gone), want) and want.sum() > 1000
    # once where a stretch begins, not once a tile (some 333)
    assert Asked.looks < 40
