"""Places gathered by value: there and back, and how much memory that takes."""

import tracemalloc

import numpy as np
import pytest

from wavesift.llm import places


@pytest.mark.parametrize("n, kinds", [(0, 0), (1, 1), (300, 7), (40_000, 3), (300_000, 9_000), (2_200_000, 2)])
def test_there_and_back(n, kinds):
    codes = np.random.default_rng(n).integers(0, max(kinds, 1), n)
    codes[:kinds] = np.arange(kinds)
    if n > 2_000_000:
        codes[1:-1] = 0  # a gap of four bytes
        codes[-1] = 1
        codes[0] = 1
    assert (places.scattered(*places.gathered(codes, kinds), n) == codes).all()
    assert (places.scattered(*places.restored(places.stored(*places.gathered(codes, kinds))), n) == codes).all()


def test_a_place_missing_or_taken_twice_is_an_error():
    data, starts = places.gathered(np.array([0, 1, 0, 1]), 2)
    for n in (3, 5):
        with pytest.raises(ValueError):
            places.scattered(data, starts, n)


def test_memory_for_a_place():
    """Bytes that live at once while there are a million places."""
    n = 1_000_000
    codes = np.random.default_rng(3).integers(0, 20_000, n)
    codes[:20_000] = np.arange(20_000)
    tracemalloc.start()
    try:
        held = places.gathered(codes, 20_000)
        assert tracemalloc.get_traced_memory()[1] < 45 * n
        tracemalloc.reset_peak()
        places.scattered(*held, n)
        assert tracemalloc.get_traced_memory()[1] - held[0].nbytes < 55 * n
    finally:
        tracemalloc.stop()
