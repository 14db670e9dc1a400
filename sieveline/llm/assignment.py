"""Assignment of the rows of a table of worths to its columns, so that their sum is greatest."""

from __future__ import annotations

from collections.abc import Sequence


def assign(worth: Sequence[Sequence[float]]) -> list[int]:
    """The column of each row; no more rows than columns. The Hungarian method, so the work grows with the cube of the size.

    A worth of 0 means that the two do not fit: the sum is greatest among the assignments with the fewest of these.
    """
    most = [max(range(len(row)), key=row.__getitem__) for row in worth]
    if len(set(most)) == len(most):
        return most  # every row has its best
    n, m = len(worth), len(worth[0])
    forbidden = 1.0 + n * max(map(max, worth))  # dearer than all that can be won
    cost = [[-w if w else forbidden for w in row] for row in worth]
    by_row, by_column = [0.0] * n, [0.0] * m
    holder = [-1] * m
    for row in range(n):
        # The shortest way from the row to a free column, by costs less the prices paid so far.
        far, through, done = [float("inf")] * m, [-1] * m, [False] * m
        at, column, length = row, -1, 0.0
        while True:
            for j in range(m):
                if not done[j] and (to := length + cost[at][j] - by_row[at] - by_column[j]) < far[j]:
                    far[j], through[j] = to, column
            column = min((j for j in range(m) if not done[j]), key=far.__getitem__)
            length = far[column]
            done[column] = True
            if holder[column] < 0:
                break
            at = holder[column]
        by_row[row] += length
        for j in range(m):
            if done[j] and j != column:
                by_row[holder[j]] += length - far[j]
                by_column[j] -= length - far[j]
        while column >= 0:
            before = through[column]
            holder[column] = holder[before] if before >= 0 else row
            column = before
    out = [-1] * n
    for j, i in enumerate(holder):
        if i >= 0:
            out[i] = j
    return out
