"""Plain versions to compare with."""

from collections import defaultdict

from check import compare, connect


def components(rows):
    """doc_id -> (shingles, smallest reachable doc_id, kept), from all pairs that share a shingle."""
    sets, holders = {}, defaultdict(list)
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
        for s in sets[doc_id]:
            holders[s].append(doc_id)
    common = defaultdict(int)
    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] += 1
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def oracle(df, sf_dir, sql):
    return compare(df, connect(sf_dir), sql)
