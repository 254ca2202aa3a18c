"""Brute-force versions of what the operators do, for small tables."""

import numpy as np
import xxhash


def simhash(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash_components(rows, width=3):
    prints = {i: simhash(t, width) for i, t in rows}
    ids, values = sorted(prints), np.array([prints[i] for i in sorted(prints)], dtype=np.uint64)
    links = []
    for i in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3)
        links += [(ids[i], ids[i + 1 + int(j)]) for j in near]
    return prints, components(links, ids)


def line_dedup(rows, min_docs=10):
    """(kept, n_lines, n_dropped) per row."""
    white = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(white).translate(lower)
    seen = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                seen.setdefault(key(line), set()).add(i)
    out = []
    for _, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(seen.get(key(line), ())) < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def leaks(rows, items, width=5, threshold=0.8):
    """{(id, item): similarity} over all windows of the item's size."""
    found = {}
    for item, text in items:
        want = (text or "").lower().split()
        if not want:
            continue
        k, n = min(width, len(want)), len(want)
        want = [tuple(want[i : i + k]) for i in range(n - k + 1)]
        for i, doc in rows:
            words = (doc or "").lower().split()
            have = [tuple(words[p : p + k]) for p in range(len(words) - k + 1)]
            for p in range(len(have)):
                window = have[p : p + n - k + 1]
                shared = sum(min(window.count(x), want.count(x)) for x in set(window))
                similarity = shared / (len(window) + len(want) - shared)
                if similarity >= threshold:
                    found[i, item] = max(similarity, found.get((i, item), 0))
    return found
