"""Lazy enumeration of the assignments of columns to roles, best score first.

One document has some twenty columns and at most nine roles, yet the number of assignments is a
factorial of the ambiguous ones. They are produced one by one by best-first search over prefixes (roles are
decided in order): a prefix is ranked by the best score that any completion reaches, an exact bound from an
assignment problem over the open roles, so no prefix is opened in vain and the next assignment costs
polynomial time. Ties go by the printed mapping, which grows with its prefix.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

IMPOSSIBLE = -10 ** 6


def best_total(options: Sequence[Mapping[int, int]], required: Sequence[bool]) -> int | None:
    """The greatest total when each row takes a distinct column; optional rows may take none.

    Shortest augmenting paths over rows; a column of its own, worth nothing, lets a row stay without.
    """
    columns = sorted({k for o in options for k in o})
    place = {k: j for j, k in enumerate(columns, 1)}
    n, m = len(options), len(columns) + len(options)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i, (o, must) in enumerate(zip(options, required), 1):
        for j in range(1, m + 1):
            cost[i][j] = -IMPOSSIBLE
        for k, points in o.items():
            cost[i][place[k]] = -points
        if not must:
            cost[i][len(columns) + i] = 0
    u, v, owner = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used, back = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while True:
            used[j0], row, delta, j1 = True, owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    reduced = cost[row][j] - u[row] - v[j]
                    if reduced < least[j]:
                        least[j], back[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    total = -sum(cost[owner[j]][j] for j in range(1, m + 1) if owner[j])
    return total if total > IMPOSSIBLE // 2 else None


def assignments(roles: Sequence[tuple[str, bool]], options: Mapping[str, Mapping[int, int]]) -> Iterator[tuple[int, str, dict[str, int]]]:
    """``(points, printed mapping, role -> column)`` of every assignment, best first.

    ``roles`` are (name, required) in claiming order; ``options`` are the points of each column a role may take.
    """
    of = [options.get(name, {}) for name, _ in roles]
    must = [required for _, required in roles]

    def bound(i: int, taken: frozenset[int]) -> int | None:
        rest = [{k: p for k, p in o.items() if k not in taken} for o in of[i:]]
        return best_total(rest, must[i:]) if rest else 0

    first = bound(0, frozenset())
    # (-best total, printed prefix, roles decided, points so far, columns)
    heap = [] if first is None else [(-first, "", 0, 0, ())]
    while heap:
        key, text, i, points, chosen = heapq.heappop(heap)
        if i == len(roles):
            yield points, text, dict(chosen)
            continue
        name, required = roles[i]
        taken = frozenset(k for _, k in chosen)
        for k, p in of[i].items():
            if k not in taken:
                rest = bound(i + 1, taken | {k})
                if rest is not None:
                    printed = f"{text},{name}={k}" if text else f"{name}={k}"
                    heapq.heappush(heap, (-(points + p + rest), printed, i + 1, points + p, chosen + ((name, k),)))
        if not required:
            rest = bound(i + 1, taken)
            if rest is not None:
                heapq.heappush(heap, (-(points + rest), text, i + 1, points, chosen))
