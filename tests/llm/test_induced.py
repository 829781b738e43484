"""Induced sorting against plain sorting of suffixes."""

import random

import numpy as np
import pytest

from skysift.llm import induced


def plain(text):
    text = [int(x) for x in text]
    order = sorted(range(len(text)), key=lambda i: text[i:])
    low = [0]
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        low.append(min(n, induced.CAP))
    return order, low


def cases():
    draw = random.Random(11)
    for n in range(1, 9):
        for _ in range(40):
            yield [draw.randint(0, 2) for _ in range(n)]
    for top in (1, 2, 5, 200):
        for _ in range(15):
            text = [draw.randint(0, top) for _ in range(draw.randint(10, 300))]
            yield text + text[: draw.randint(0, len(text))]
    yield [7] * 400
    yield [7] * 200 + [3] + [7] * 199
    yield [1, 2] * 150


@pytest.mark.parametrize("memory", [1 << 20, 16])
def test_order_and_prefixes(memory, tmp_path):
    for text in cases():
        pieces = list(induced.suffixes(np.array(text, np.uint8), memory, str(tmp_path)))
        order = np.concatenate([p for p, _ in pieces]).tolist()
        low = np.concatenate([q for _, q in pieces]).tolist()
        want, lows = plain(text)
        assert order == want, text
        assert low == lows, (text, low, lows)
    assert memory > 16 or list(tmp_path.iterdir())
