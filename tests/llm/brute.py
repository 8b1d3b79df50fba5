"""Plain versions of the operators' results, for small tables."""

from __future__ import annotations

import re


def components(names, links):
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in names}


def chars(line, k=8):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def kept_lines(docs, least=0.8):
    """Texts (by id) after line dedup; ``docs`` are (id, text) with different ids."""
    places = [
        (doc, pos, line.strip(" "))
        for doc, text in sorted(docs, key=lambda d: d[0])
        for pos, line in enumerate((text or "").split("\n"))
        if line.strip(" ")
    ]
    lines = list(dict.fromkeys(p[2] for p in places))
    sets = [chars(line) for line in lines]
    links = []
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        count = {}
        for x in s:
            for j in by[x]:
                if j > i:
                    count[j] = count.get(j, 0) + 1
        links += [(i, j) for j, c in count.items() if c >= least * (len(s) + len(sets[j]) - c) - 1e-9]
    of = components(range(len(lines)), links)
    number = {line: of[i] for i, line in enumerate(lines)}
    seen, gone = set(), set()
    for doc, pos, line in places:
        if number[line] in seen:
            gone.add((doc, pos))
        seen.add(number[line])
    return {
        doc: text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in gone)
        for doc, text in docs
    }


def words(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def word_shingles(text, k):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def linked_components(docs, k=4, percent=85):
    """(id, size, component) of (id, text) rows with different ids."""
    sets = {d: word_shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    of = components(ids, links)
    return {(d, len(sets[d]), of[d]) for d in ids}
