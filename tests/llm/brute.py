"""Plain Python versions of the corpus operators, for small fixtures."""

import itertools
import math
import re

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near_duplicates(rows, k, percent=80):
    """{doc_id: (n_shingles, component)} of (doc_id, text) with different ids."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(docs, items, window=10):
    """{doc_id: (n_words, n_hit, sorted item ids)}."""
    windows = {}
    for i, text in items:
        w = bench_words(text)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = {}
    for d, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (key := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[key]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def best_pieces(text, scores, unknown):
    """The best score of all segmentations by plain dynamic programming, without an automaton."""
    best = [0.0] + [float("-inf")] * len(text)
    singles = {p for p in scores if len(p) == 1}
    for end in range(1, len(text) + 1):
        for start in range(end):
            if text[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[text[start:end]])
        if text[end - 1] not in singles:
            best[end] = max(best[end], best[end - 1] + unknown)
    return best[-1]


def greedy_count(word, initial, inner):
    """Longest-match-first pieces one by one; -1 if a word can't be made up."""
    at, n, own = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), None)
        if end is None:
            return -1
        at, n, own = end, n + 1, inner
    return n


def attention_score(model, bag):
    """A bag's score, passage by passage."""
    w, b, v, u, a, c, c0 = model.params
    hidden, energy = [], []
    for x in (bag - model.mean) / model.scale:
        h = [math.tanh(sum(x[i] * w[i, j] for i in range(len(x))) + b[j]) for j in range(len(b))]
        gate = [math.tanh(sum(h[i] * v[i, j] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * u[i, j] for i in range(len(h))))) for j in range(len(a))]
        hidden.append(h)
        energy.append(math.exp(sum(g * y for g, y in zip(gate, a, strict=True))))
    z = [sum(e * h[j] for e, h in zip(energy, hidden, strict=True)) / sum(energy) for j in range(len(b))]
    return 1 / (1 + math.exp(-sum(x * y for x, y in zip(z, c, strict=True)) - c0[0]))


def kd_shards(points, dims, shards, tie, row, value_tilt, group_tilt):
    """Shard numbers of points (dicts with size, the dimensions, tie and row) by a tree grown in plain Python."""
    whole = sum(p["size"] for p in points)
    span = lambda own, d: max(p[d] for p in own) - min(p[d] for p in own)
    wide = {d: max(1, span(points, d)) for d in dims}
    out = {}

    def split(own, first, n):
        if n == 1 or not own:
            out.update({id(p): first for p in own})
            return
        target = sum(p["size"] for p in own) * (n // 2) / n
        left, tied = [], own
        for name in (max(dims, key=lambda d: span(own, d) / wide[d]), tie, row):
            done = 0
            for value in sorted({p[name] for p in tied}):
                at = sum(p["size"] for p in tied if p[name] == value)
                if done + at > target:
                    break
                done += at
            else:
                done -= at
            left += [p for p in tied if p[name] < value]
            tied = [p for p in tied if p[name] == value]
            tilt = min(abs(done + at - target), abs(done - target))
            if name == row or tilt <= whole / shards * (group_tilt if name == tie else value_tilt):
                left += tied if abs(done + at - target) <= abs(done - target) else []
                break
            target -= done
        went = {id(p) for p in left}
        split(left, first, n // 2)
        split([p for p in own if id(p) not in went], first + n // 2, n - n // 2)

    split(points, 0, shards)
    return [out[id(p)] for p in points]
