"""Plain versions of the operators, over lists of (doc_id, text), for small inputs."""

import hashlib
import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def lowered(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(text)]


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = lowered(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    edges = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                edges.append((a, b))
    found = components(ids, edges)
    return {i: (len(sets[i]), found[i]) for i in ids}


def repeats(rows, n):
    split = {i: words(t) for i, t in rows}
    first = {}
    for i in sorted(split):
        for p in range(len(split[i]) - n + 1):
            first.setdefault(tuple(split[i][p : p + n]), (i, p))
    out = {}
    for i, w in split.items():
        gone = set()
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] != (i, p):
                gone.update(range(p, p + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n, vocabulary=60, longest=120):
    """Documents with copies, near copies, shared passages, and odd ones."""
    r = random.Random(seed)
    bag = [f"{'wW'[i % 2]}{i}é" if i % 7 == 0 else f"w{i}" for i in range(vocabulary)]
    passage = [r.choice(bag) for _ in range(35)]
    texts = ["", " ", None, "one", "a b c", "\x0b\x0c lead and trail \t\n", "x" * 5000]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.4 or len(texts) < 12:
            texts.append(" ".join(r.choice(bag) for _ in range(r.randint(0, longest))))
        elif kind < 0.6:
            texts.append(r.choice(texts))
        elif kind < 0.85:
            w = (r.choice(texts) or "z").split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(bag)
            texts.append(r.choice([" ", "\n", "  "]).join(w))
        else:
            w = [r.choice(bag) for _ in range(r.randint(0, 40))]
            at = r.randint(0, len(w))
            texts.append(" ".join(w[:at] + passage[r.randint(0, 10) :] + w[at:]))
    ids = list(range(n))
    r.shuffle(ids)
    return list(zip(ids, texts))
