"""Phrases that repeat: the longest first, found without trying every size on the whole text."""

import time

import numpy as np

from lectern.operators.titles import longest_repeat


def plain(numbers):
    for size in range(len(numbers) // 2, 0, -1):
        for at in range(len(numbers) - 2 * size + 1):
            if (numbers[at : at + size] == numbers[at + size : at + 2 * size]).all():
                return at, size
    return None


def test_longest_repeat_equals_trying_every_size():
    random = np.random.default_rng(3)
    for kinds in (1, 2, 3, 8, 40):
        for n in [*range(0, 40), 97, 150]:
            numbers = random.integers(0, kinds, n)
            assert longest_repeat(numbers) == plain(numbers)
            doubled = np.concatenate([random.integers(0, 9, 5), numbers, numbers, random.integers(0, 9, 3)])
            assert longest_repeat(doubled) == plain(doubled)


def test_a_long_text_is_searched_in_little_time():
    numbers = np.random.default_rng(4).integers(0, 2000, 60_000)
    begin = time.process_time()
    assert longest_repeat(np.concatenate([numbers, numbers])) == (0, 60_000)
    longest_repeat(numbers)
    assert time.process_time() - begin < 2  # every size in turn: 60,000 passes over the text
