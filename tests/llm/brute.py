"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = "[\x20\x09-\x0d]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    size = min(size, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_groups(docs, size, percent):
    """doc_id -> (set size, least doc_id reachable), for distinct doc_ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeated_passages(docs, min_words=50):
    """doc_ids whose texts hold a passage of as many words that a smaller doc_id has."""
    seen, found = set(), set()
    for i, t in sorted(docs):
        data = (t or "").encode()
        w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        own = {data[w[k][0] : w[k + min_words - 1][1]] for k in range(len(w) - min_words + 1)}
        if own & seen:
            found.add(i)
        seen |= own
    return found


def deduped_lines(docs):
    keys = defaultdict(set)
    key_of = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 20:
                keys[key_of(line)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(keys[key_of(x)]) < 3 or i == max(keys[key_of(x)])]
        text = "\n".join(kept)
        out[i] = (len(lines), len(lines) - len(kept), text, hashlib.sha256(text.encode()).hexdigest())
    return out


def contaminated(docs, items, size=5, threshold=0.8):
    """(doc_id, item_id) -> best similarity of a window as long as the item."""
    def weights(w):
        n = min(size, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    found, words = {}, {k: WORD.findall(lower(t)) for k, t in items}
    for i, t in docs:
        w = WORD.findall(lower(t))
        grams = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in {min(size, len(x)) for x in words.values() if x}}
        for k, item in words.items():
            if not item or len(item) > len(w):
                continue
            own = weights(item)
            if not own.keys() & grams[min(size, len(item))]:
                continue
            best = 0
            for at in range(len(w) - len(item) + 1):
                other = weights(w[at : at + len(item)])
                shared = (own & other).total()
                best = max(best, shared / (own.total() + other.total() - shared))
            if best >= threshold - 1e-9:
                found[i, k] = best
    return found


def quality(docs, min_docs=20, max_percent=1, min_kept=30):
    """doc_id -> (the five numbers, base_failed, kept), for rows of doc_id, source, text."""
    held, texts = defaultdict(set), defaultdict(set)
    line_words = {}
    key_of = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for _, host, t in docs:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                held[host, key_of(line)].add(t)
                texts[host].add(t)
                line_words[key_of(line)] = len(WORD.findall(line))
    out = {}
    for i, host, t in docs:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(windows)
        repeat = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        own = {key_of(x) for x in lines}
        often = {k for k in own if len(held[host, k]) >= min_docs and 100 * len(held[host, k]) > max_percent * len(texts[host])}
        total, gone = sum(line_words[k] for k in own), sum(line_words[k] for k in often)
        kept = not failed and 100 * (total - gone) >= min_kept * total
        out[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), failed, kept)
    return out


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}
