import numpy as np
import pytest

from nightjar.llm.fm_index import FMIndex, repeated_windows, suffix_order


def occurrences(text, pattern):
    m = len(pattern)
    return sum(text[i:i + m] == pattern for i in range(len(text) - m + 1))


@pytest.mark.parametrize("seed,top", [(0, 1), (1, 2), (2, 5), (3, 60)])
def test_backward_search_counts_like_scanning(seed, top):
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(0, top + 1, 400), 0)
    index = FMIndex(text, 12)
    plain = text.tolist()
    for _ in range(60):
        at = int(rng.integers(0, 390))
        pattern = plain[at:at + int(rng.integers(1, 10))]
        if 0 in pattern:
            continue
        low, high = index.first[pattern[-1:]], index.first[[pattern[-1] + 1]]
        for symbol in reversed(pattern[:-1]):
            low, high = index.extend(np.array([symbol]), low, high)
        assert high[0] - low[0] == occurrences(plain, pattern)


def test_suffixes_are_ordered_to_the_depth():
    text = np.random.default_rng(5).integers(0, 3, 300)
    order = suffix_order(text, 16)
    heads = [tuple(text[i:i + 16]) for i in order]
    padded = [h + (0,) * (16 - len(h)) for h in heads]
    assert padded == sorted(padded) and sorted(order) == list(range(300))


@pytest.mark.parametrize("window", [2, 3, 5])
def test_repeated_windows_match_counting(window):
    rng = np.random.default_rng(window)
    pieces = [rng.integers(1, 4, int(n)) for n in rng.integers(window, 2 * window + 1, 50)]
    text = np.concatenate([np.append(p, 0) for p in pieces])
    length = np.array([len(p) for p in pieces])
    start = np.cumsum(length + 1) - length - 1
    found = repeated_windows(FMIndex(text, 2 * window), text, start, length, window)
    plain = text.tolist()
    for runs, s, n in zip(found, start.tolist(), length.tolist()):
        got = {w for a, b in runs for w in range(a, b + 1)}
        assert got == {w for w in range(n - window + 1) if occurrences(plain, plain[s + w:s + w + window]) > 1}
