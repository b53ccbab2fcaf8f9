"""Suffix arrays by linear grouping construction (Baier, 2016).

First the suffixes are grouped by their Lyndon prefixes: groups are taken in descending
order, each member finds its previous smaller suffix by following pointers of finished
ones, and those predecessors move into new groups just above their old ones. Then the
groups' order is emitted in one ascending pass; nothing is renamed or recursed into.
"""

from __future__ import annotations


def group_suffixes(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Group of each suffix, size of each group in ascending order and previous-smaller pointers."""
    n = len(text)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        members.setdefault(c, []).append(i)
    ranked = sorted(members)
    lists = [members[c] for c in ranked]
    group = [0] * n
    for g, own in enumerate(lists):
        for i in own:
            group[i] = g
    below = list(range(-1, len(lists) - 1))  # the next lower group
    above = [g + 1 for g in range(len(lists))]
    above[-1] = -1
    size = [len(own) for own in lists]
    prev = [-1] * n
    done = [False] * n
    g = len(lists) - 1
    while g >= 0:
        own = [i for i in lists[g] if group[i] == g]
        own.sort()
        lists[g] = own
        counts: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            done[i] = True
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if counts:
            split: dict[tuple[int, int], list[int]] = {}
            for p, k in counts.items():
                split.setdefault((k, group[p]), []).append(p)
            for k, old in sorted(split, reverse=True) if len(split) > 1 else split:
                moved = split[k, old]
                if len(moved) == size[old]:
                    continue
                new = len(lists)
                lists.append(moved)
                size.append(len(moved))
                size[old] -= len(moved)
                for p in moved:
                    group[p] = new
                top = above[old]
                below.append(old)
                above.append(top)
                above[old] = new
                if top >= 0:
                    below[top] = new
        g = below[g]
    order, g = [], 0
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        order.append(g)
        g = above[g]
    rank = [0] * len(lists)
    for r, g in enumerate(order):
        rank[g] = r
    return [rank[g] for g in group], [size[g] for g in order], prev


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order; a suffix sorts before those it begins."""
    n = len(text)
    if not n:
        return []
    group, sizes, prev = group_suffixes(text)
    nxt, total = [], 0
    for s in sizes:
        nxt.append(total)
        total += s
    out = [0] * n
    placed = [False] * n
    j = n - 1
    while j >= 0 and not placed[j]:
        g = group[j]
        out[nxt[g]] = j
        nxt[g] += 1
        placed[j] = True
        j = prev[j]
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[nxt[g]] = j
            nxt[g] += 1
            placed[j] = True
            j = prev[j]
    return out
