"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def repeats(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    owner = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            owner[k] = min(owner.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if owner[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    pairs = []
    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in lists[g] if j > i)
        pairs += [(i, j) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
    root = groups(len(rows), pairs)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def periodic_runs(words, least=12):
    """(start, length, smallest period) of all runs, by start and then period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            e = i
            while e + p < len(words) and words[e] == words[e + p]:
                e += 1
            if e + p - i >= max(least, 2 * p):
                found.setdefault((i, e + p), p)
            i = e + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def resampled(rows, target, buckets=10_000, share=10, least=20, seed=2024, longest=1):
    """[(doc_id, n_features, weight, score)], and the (score, doc_id) of the drawn rows, best first."""

    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(f for text in texts for f in features(text)) for texts in ([x for _, x in rows], target))
    of_s, of_t = sum(s.values()), sum(t.values())
    out = []
    for d, text in rows:
        f = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (of_s + buckets) / ((s[b] + 1) * (of_t + buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted(((-score, d is None, d, n) for d, n, _, score in out if n >= least), key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))
    return out, [(-r[0], r[2]) for r in fit[: len(fit) * share // 100]]


LATIN = {c: c.lower() for c in "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"}
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def tokens(text, units):
    """(lower-cased word, kind) of each token; kinds: 0 plain, 1 number, 2 name, 3 unit."""
    words = list(re.finditer("[^\x20\x09-\x0d]+", text))
    out, begins = [], True
    for i, m in enumerate(words):
        begins = begins or i == 0 or "\n" in text[words[i - 1].end() : m.start()]
        word = m[0].strip(MARKS)
        if word:
            lower = "".join(LATIN.get(c, c.translate(LOWER)) for c in word)
            capitals = sum(a != b for a, b in zip(word, lower))
            kind = 1 if re.fullmatch("[0-9][0-9.,:/]*", word) else 0
            if not kind and out and out[-1][1] == 1 and lower in units:
                kind = 3
            elif not kind and not begins and word[0] != lower[0] and capitals == 1 and len(word.encode()) > 1:
                kind = 2
            out.append((lower, kind))
        begins = not word or m[0][-1] in ".!?:"
    return out


def windows(seq, n, by_template):
    """(position, what is compared) of all windows of n tokens."""
    for i in range(len(seq) - n + 1):
        part = seq[i : i + n]
        if not by_template:
            yield i, tuple(w for w, _ in part)
            continue
        plain = sum(k == 0 for _, k in part)
        typed = tuple(("w", w) if k == 0 else ("k", k) for w, k in part)
        if 2 * plain >= n:
            yield i, typed
        if part[0][1] in (2, 3) and 2 * (plain + 1) >= n:
            yield i, (("w", part[0][0]), *typed[1:])


def contaminated(docs, items, units, window=13, least=8):
    """{(row, item): (windows, tokens, changed slots)}."""
    texts = [(item, tokens(t, units)) for item, t in dict.fromkeys(items) if item is not None and t is not None]
    found = {}
    for row, text in enumerate(docs):
        seq = tokens(text or "", units)
        own = {}
        for item, other in texts:
            n = min(window, len(other))
            diagonals = {}
            for by_template in (False, True) if n >= least else (False,) if n else ():
                own.setdefault((n, by_template), defaultdict(list))
                if not own[n, by_template]:
                    for i, w in windows(seq, n, by_template):
                        own[n, by_template][w].append(i)
                for j, w in windows(other, n, by_template):
                    for i in own[n, by_template].get(w, ()):
                        diagonals.setdefault(i - j, set()).add(i)
            templated = {j for j, _ in windows(other, n, True)} if n >= least else set()
            for d, at in diagonals.items():
                slots = {p + d: (k, w) for p, (w, k) in enumerate(other) if k}
                judged = {i for i in at if i - d in templated}

                def clash(i):
                    pairs = {(slots[p], seq[p][0]) for p in range(i, i + n) if p in slots}
                    return len({a for a, _ in pairs}) < len(pairs) or len({(a[0], b) for a, b in pairs}) < len(pairs)

                lost = {p for i in judged if clash(i) for p in range(i, i + n)}
                same = lambda i: all(slots[p][1] == seq[p][0] for p in range(i, i + n) if p in slots)
                kept = {i for i in judged if lost.isdisjoint(range(i, i + n)) or same(i)}
                changed = {p for i in kept for p in range(i, i + n) if p in slots and slots[p][1] != seq[p][0]}
                total = found.setdefault((row, item), [0, set(), 0])
                every = kept | (at - judged)
                total[0] += len(every)
                total[1] |= {p for i in every for p in range(i, i + n)}
                total[2] += len(changed)
    return {k: (n, len(p), c) for k, (n, p, c) in found.items() if n}
