"""Words of texts as numbers, with values kept for each distinct word, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordValues:
    """Maps words to rows of values that ``of`` gives for a list of new words; forgets all beyond ``most`` words."""

    def __init__(self, of: Callable[[list[str]], np.ndarray], most: int = 400_000):
        self.of, self.most = of, most
        self.number: dict[str, int] = {}
        self.values: np.ndarray | None = None

    def look_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text the rows of its words."""
        new = list(set().union(*texts) - self.number.keys())
        if len(self.number) + len(new) > self.most:
            self.number.clear()
            self.values = None
            new = list(set().union(*texts))
        if new:
            rows = self.of(new)
            start = len(self.number)
            self.number.update(zip(new, range(start, start + len(new)), strict=True))
            if self.values is None or start + len(new) > len(self.values):
                grown = np.zeros((max(1024, 2 * (start + len(new))), rows.shape[1]), rows.dtype)
                if self.values is not None:
                    grown[:start] = self.values[:start]
                self.values = grown
            self.values[start : start + len(new)] = rows
        if self.values is None:
            return [np.zeros((0, self.of([]).shape[1])) for _ in texts]
        get = self.number.__getitem__
        return [self.values[np.fromiter(map(get, t), np.int64, len(t))] for t in texts]
