"""Small models made by rule, the same for Spark and SQL."""

from __future__ import annotations

WEIGHTS = [((i * 37) % 23 - 11) / 5 for i in range(14)]
INTERCEPT = -0.75
#: An 8 x 14 projection.
MATRIX = [[((r * 13 + c * 7) % 11 - 5) / 10 for c in range(14)] for r in range(8)]
#: Means and a symmetric matrix in the eight projected dimensions.
MEANS = [[((s * 5 + r * 3) % 7 - 3) / 4 for r in range(8)] for s in range(2)]
INVERSE = [[1.5 if r == c else ((r + c) % 3 - 1) / 8 for c in range(8)] for r in range(8)]
LSH_TABLES, LSH_HASHES, LSH_WIDTH = 8, 4, 12.0
PROJECTIONS = [[([((t * 131 + h * 31 + i * 17) % 41 - 20) / 2.5 for i in range(14)], ((t * 7 + h * 3) % 8) / 2) for h in range(LSH_HASHES)] for t in range(LSH_TABLES)]
THRESHOLDS = [i / 10 for i in range(1, 10)]
BANDS = [0.05, 0.1, 0.2, 0.3, 0.4]


def full_tree(tree: int, depth: int = 3) -> list[tuple[int, int, int, float, int, int, float]]:
    """A complete tree: features, thresholds and leaf values by rule; sixteenths are exact as floats."""
    nodes = []
    for node in range(2 ** (depth + 1) - 1):
        if node < 2**depth - 1:
            nodes.append((tree, node, (node * 5 + tree * 3) % 14, ((node * 29 + tree * 11) % 14 + 1) / 16, 2 * node + 1, 2 * node + 2, 0.0))
        else:
            nodes.append((tree, node, -1, 0.0, -1, -1, ((node * 7 + tree * 5) % 17) / 16))
    return nodes


TREE = full_tree(0)
FOREST = [n for t in range(5) for n in full_tree(t)]
