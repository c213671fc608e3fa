"""Tag trees: quadtrees of minima whose values are told bit by bit, up to a threshold."""

from __future__ import annotations

from collections.abc import Callable


class TagTree:
    """The same walk codes and decodes: ``code`` writes the bit that it is given, or reads one."""

    def __init__(self, width: int, height: int):
        self.sizes = [(max(width, 1), max(height, 1))]
        while self.sizes[-1] != (1, 1):
            w, h = self.sizes[-1]
            self.sizes.append(((w + 1) // 2, (h + 1) // 2))
        cells = [w * h for w, h in self.sizes]
        self.value: list[list[int | None]] = [[None] * n for n in cells]
        self.low = [[0] * n for n in cells]
        self.told = [[False] * n for n in cells]

    def fill(self, leaves: list[int]) -> TagTree:
        """Sets all leaves; every node gets the smallest value below it."""
        self.value[0] = list(leaves)
        for level in range(1, len(self.sizes)):
            (w, h), (pw, _) = self.sizes[level - 1], self.sizes[level]
            above: list[int | None] = [None] * len(self.value[level])
            for y in range(h):
                for x in range(w):
                    at, v = (y // 2) * pw + x // 2, self.value[level - 1][y * w + x]
                    above[at] = v if above[at] is None else min(above[at], v)
            self.value[level] = above
        return self

    def code(self, x: int, y: int, threshold: int, code: Callable[[int], int]) -> bool:
        """Tells whether the leaf's value is below the threshold."""
        low = 0
        for level in range(len(self.sizes) - 1, -1, -1):
            at = (y >> level) * self.sizes[level][0] + (x >> level)
            low = max(low, self.low[level][at])
            while low < threshold and not self.told[level][at]:
                value = self.value[level][at]
                if code(int(value is not None and value <= low)):
                    self.value[level][at], self.told[level][at] = low, True
                else:
                    low += 1
            self.low[level][at] = low
            if self.told[level][at]:
                low = max(low, self.value[level][at])
                self.low[level][at] = low
        leaf = y * self.sizes[0][0] + x
        return self.told[0][leaf] and self.value[0][leaf] < threshold

    def exact(self, x: int, y: int, code: Callable[[int], int], most: int = 74) -> int:
        """Tells the leaf's value itself."""
        for threshold in range(1, most + 1):
            if self.code(x, y, threshold, code):
                return self.value[0][y * self.sizes[0][0] + x]
        raise ValueError("a tag tree's value is out of range")
