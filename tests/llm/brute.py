"""Plain definitions, for small inputs only."""

import random
import re

GAP = re.compile("[\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in GAP.split(text or "") if w]


def shingle_set(text, n):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def roots(nodes, links):
    """Smallest node that links lead to."""
    near = {n: {n} for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def near_copies(seed, groups=12, copies=6, size=60, edits=3, vocabulary=400):
    """Texts in groups of edited copies, with exact copies among them."""
    rng = random.Random(seed)
    pool = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(vocabulary)]
    out = []
    for _ in range(groups):
        base = [rng.choice(pool) for _ in range(size)]
        out.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(pool)
            out.append("\t".join(own) + "\n")
    rng.shuffle(out)
    return out


def rows(texts):
    return [(i, t, "en" if i % 3 else "fr", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
