"""Plain single-machine versions of the operators, for small inputs."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return tuple(SPACED.findall((text or "").translate(LOWER)))


def shingles(text):
    w = words(text)
    return frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_components(docs):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def one_word_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def dedup_lines(docs):
    """{doc_id: text} after comparing every line with all earlier ones."""
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        kept = []
        for line in (text or "").split("\n"):
            w = words(line)
            gone = w and (w in seen or len(w) >= 5 and any(len(s) >= 5 and one_word_apart(w, s) for s in seen))
            if w:
                seen.add(w)
            if not gone:
                kept.append(line)
        out[d] = None if text is None else "\n".join(kept)
    return out


def contaminated(docs, items):
    """{doc_id: (n_words, n_hit, n_items, items_sha256)}."""
    windows = []
    for item, text in items:
        w = tuple(WORD.findall((text or "").translate(LOWER)))
        n = min(10, len(w))
        windows += [(item, w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = {}
    for d, text in docs:
        w = tuple(WORD.findall((text or "").translate(LOWER)))
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def source_targets(sizes):
    """{source: target} by resharing until none is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] >= 2 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 2 * sizes[s] for s in above}
