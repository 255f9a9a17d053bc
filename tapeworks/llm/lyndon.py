"""Suffix arrays by grouping suffixes on their Lyndon prefixes, in linear time and without recursion."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; a suffix that is a prefix of another comes first.

    First, suffixes are grouped by their Lyndon prefix, groups in its order. Groups start as the suffixes of each letter
    and are visited from the last to the first. Every member i of a visited group points to the nearest position left of
    it in a lower group; the pointed positions then leave their groups for new ones just above, those with more pointers
    higher, as their prefix goes on with that many copies of the visited group's prefix.

    Second, the order is emitted: whenever a suffix gets its place, the position before it and the positions on that
    one's chain of pointers are next in their groups, until one that has its place.
    """
    n = len(text)
    group = list(text)
    members: dict[int, list[int]] = {}
    for i, letter in enumerate(group):
        members.setdefault(letter, []).append(i)
    letters = sorted(members)
    names = {letter: k for k, letter in enumerate(letters)}
    lists = [members[letter] for letter in letters]
    group = [names[letter] for letter in group]
    below = list(range(-1, len(lists) - 1))  # the group under each
    above = [*range(1, len(lists)), -1]
    pointer = [-1] * n
    done = bytearray(n)
    sizes = [len(x) for x in lists]
    at = len(lists) - 1
    while at >= 0:
        here = [i for i in lists[at] if group[i] == at] if len(lists[at]) != sizes[at] else lists[at]
        lists[at] = here
        hits: dict[int, int] = {}
        here.sort()
        for i in here:
            done[i] = 1
        for i in here:
            j = i - 1
            while j >= 0 and done[j]:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            ranked: dict[tuple[int, int], list[int]] = {}
            for j, count in hits.items():
                key = (count, group[j])
                if key in ranked:
                    ranked[key].append(j)
                else:
                    ranked[key] = [j]
            for key in sorted(ranked, key=lambda k: -k[0]):
                old, moved = key[1], ranked[key]
                if len(moved) == sizes[old]:
                    continue  # the whole group moves: it stays as it is
                new = len(lists)
                lists.append(moved)
                sizes.append(len(moved))
                sizes[old] -= len(moved)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
                for j in moved:
                    group[j] = new
        at = below[at]
    heads, place = [0] * len(lists), 0
    at = names[letters[0]] if letters else -1
    while at >= 0:
        heads[at] = place
        place += sizes[at]
        at = above[at]
    order = [-1] * n
    placed = bytearray(n)

    def chain(j: int) -> None:
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            order[heads[g]] = j
            heads[g] += 1
            j = pointer[j]

    chain(n - 1)  # what follows the last position is empty and comes before all
    for i in range(n):
        chain(order[i] - 1)
    return order
