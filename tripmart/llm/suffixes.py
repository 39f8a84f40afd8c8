"""Suffix arrays by grouping suffixes on their longest Lyndon prefix."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of `text` in ascending order (a suffix that begins another one is the smaller).

    Linear but for two comparison sorts: of the symbols, and of each group's members once. Suffixes are grouped by
    a prefix that grows until it is their longest Lyndon prefix. Groups are taken in descending order; the prefix of the group in hand is final. For each of its suffixes the nearest earlier suffix that
    lies in a smaller group is found along pointers over larger ones; that one's prefix goes on with the group's prefix,
    once for each of the suffixes that point to it in a row. So its old group is split by that number, more repeats after
    fewer. What remains is the order within groups: a suffix is its Lyndon prefix and then the next smaller suffix, so
    going through the array from the smallest up, each suffix places those that it follows, each at the next free
    place of its group. No group is sorted or renamed again.
    """
    n = len(text) + 1
    if n == 1:
        return []
    group, size, members, place, smaller = _first_groups(text, n)
    stop = n
    while stop > 0:
        start = group[members[stop - 1]]
        repeats: dict[int, int] = {}
        own = sorted(members[start:stop])
        for i in own:
            p = i - 1
            while p >= 0 and group[p] > start:
                p = smaller[p]
            if p >= 0 and group[p] == start:
                p = smaller[p]  # in a row of equal prefixes all point before the row
            smaller[i] = p
            if p >= 0:
                repeats[p] = repeats.get(p, 0) + 1
        if repeats:
            _split(repeats, group, size, members, place)
        stop = start
    return _emit(n, group, smaller)


def _first_groups(text: list[int], n: int):
    """Groups by the first symbol; behind the text stands an end that is smaller than any symbol.

    `group[i]` is where the group of suffix i begins in `members`, `place[i]` where i stands there.
    """
    order = sorted(range(n - 1), key=text.__getitem__)
    members = [n - 1, *order]
    group, size, place = [0] * n, [0] * n, [0] * n
    start = 0
    for at, i in enumerate(members):
        if at <= 1 or text[i] != text[members[at - 1]]:
            start = at
        group[i] = start
        size[start] += 1
        place[i] = at
    return group, size, members, place, [-1] * n


def _split(repeats: dict[int, int], group: list[int], size: list[int], members: list[int], place: list[int]) -> None:
    """Move those with most repeats to the end of their groups, as new groups; then those with fewer before them."""
    by_count: dict[int, list[int]] = {}
    for p, k in repeats.items():
        by_count.setdefault(k, []).append(p)
    for k in sorted(by_count, reverse=True):
        touched = set()
        for p in by_count[k]:
            g = group[p]
            touched.add(g)
            last = g + size[g] - 1
            size[g] -= 1
            at, other = place[p], members[last]
            members[at], members[last] = other, p
            place[other], place[p] = at, last
        begins = {g: g + size[g] for g in touched}
        for begin in begins.values():
            size[begin] = 0
        for p in by_count[k]:
            begin = begins[group[p]]
            group[p] = begin
            size[begin] += 1


def _emit(n: int, group: list[int], smaller: list[int]) -> list[int]:
    free, out, placed = list(range(n)), [0] * n, [False] * n
    # the end of the text is the smallest suffix
    out[0], placed[n - 1] = n - 1, True
    for at in range(n):
        i = out[at] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = True
            i = smaller[i]
    return out[1:]
