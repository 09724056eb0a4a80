"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(rows, percent=75):
    """doc_id -> (set size, component); rows: (doc_id, text)."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in where[g] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def without_repeats(texts, length=200):
    """(kept bytes, removed, runs) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out.append((kept, sum(hit), len(re.findall(rb"\x01+", bytes(hit)))))
    return out


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def hits(text, items, width=10):
    """(words, hit words, item ids) of a text; items: (id, text)."""
    w = item_words(text)
    hit, found = set(), set()
    for item, t in items:
        x = item_words(t)
        m = min(width, len(x))
        windows = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if x else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(item)
    return len(w), len(hit), found


def targets(sizes, weights=(5, 2, 1), share=1.5, repeat=2):
    """source -> target by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > repeat * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = repeat * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def mix(rows):
    """doc_id -> taken; rows: (doc_id, source, text), ids distinct. Cells of the hash are taken in order while they bring the sum nearer."""
    rows = [(d, s, len(words(t)), hashlib.md5(f"{d}|{hashlib.md5(t.encode()).hexdigest() if t is not None else ''}|mix".encode()).hexdigest()) for d, s, t in rows]
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    goal, out = targets(sizes), {}
    for source in sizes:
        whole = min(int(goal[source] // sizes[source]), 1) if sizes[source] else 0
        budget, cells = goal[source] - whole * sizes[source], defaultdict(list)
        for d, s, n, h in rows:
            if s == source:
                cells[int(h[:15], 16) >> 36].append((d, n))
        below = 0
        for cell in sorted(cells):
            own = sum(n for _, n in cells[cell])
            yes = below + own / 2 <= budget and below < budget or below + own <= budget
            for d, n in cells[cell]:
                out[d] = n * (whole + bool(yes))
            below += own
    return out


def stream(text):
    """Bytes that the language model codes: words with one space between them, then one end byte."""
    return (" ".join(words(text)) + "\n").encode()


def ppm(rows, order=7):
    """doc_id -> (tokens, known, total, base, score); rows: (doc_id, text, train). Contexts run over the whole text, end bytes stand before it."""
    tokens = lambda t: [*words(t), "\n"]
    count = Counter(w for _, t, train in rows if train for w in tokens(t))
    total, distinct = sum(count.values()), len(count)

    def coded(t):
        b = b"\n" * order + stream(t)
        return [(b[i - order : i], b[i]) for i in range(order, len(b))]

    trie = [defaultdict(Counter) for _ in range(order + 1)]
    for _, t, train in rows:
        for ctx, s in coded(t) if train else ():
            for o in range(order + 1):
                trie[o][ctx[order - o :]][s] += 1

    def cost(ctx, s):
        gone, out = set(), 0.0
        for o in range(order, -1, -1):
            seen = trie[o].get(ctx[order - o :])
            if not seen:
                continue
            live = {k: v for k, v in seen.items() if k not in gone}
            n = sum(live.values())
            if s in live:
                return out + math.log10((2 * live[s] - 1) / (2 * n))
            if n:
                out += math.log10(len(live) / (2 * n))
            gone |= set(seen)
        return out - math.log10(max(1, 256 - len(gone)))

    return {d: (len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens(t)), sum(cost(*x) for x in coded(t))) for d, t, _ in rows}


def grams(text, order, bits):
    """Hash buckets of the character n-grams of a text, lower-cased in Latin, Greek and Cyrillic."""
    low = [ord(c) + 32 * (0x41 <= ord(c) <= 0x5A or (0xC0 <= ord(c) <= 0xDE and ord(c) != 0xD7) or 0x391 <= ord(c) <= 0x3A9 or 0x410 <= ord(c) <= 0x42F) for c in text]
    out = []
    for i in range(len(low) - order + 1):
        h = order * 0x9E3779B1 % 2**32
        for c in low[i : i + order]:
            h = (h ^ c) * 0x85EBCA6B % 2**32
            h ^= h >> 15
        out.append((h * 0xC2B2AE35 % 2**32) >> (32 - bits))
    return out


def languages(rows, orders=(1, 2, 3), bits=15, alpha=0.5):
    """(language, posterior) of each row by multinomial naive Bayes; rows: (text, lang, train)."""
    count, total, prior = defaultdict(Counter), Counter(), Counter()
    for text, lang, train in rows:
        if train and text is not None and lang is not None:
            prior[lang] += 1
            for o in orders:
                count[lang].update(grams(text, o, bits))
    for lang in prior:
        total[lang] = sum(count[lang].values()) + alpha * 2**bits
    out = []
    for text, _, _ in rows:
        if not any(unicodedata.category(c)[0] == "L" for c in text or "") or not prior:
            out.append(("und", 0.0))
            continue
        own = Counter(g for o in orders for g in grams(text, o, bits))
        log = {lang: math.log(prior[lang] / sum(prior.values())) + sum(n * math.log((count[lang][g] + alpha) / total[lang]) for g, n in own.items()) for lang in sorted(prior)}
        best = max(log, key=lambda x: (log[x], -sorted(prior).index(x)))
        out.append((best, 1 / sum(math.exp(v - log[best]) for v in log.values())))
    return out


def statistics(text):
    """Statistics of a text that the quality rules ask for."""
    t = text or ""
    n, lines, found = len(t), t.split("\n"), re.split(r"[\x20\x09-\x0D]+", t)
    share = lambda chars: sum(c in chars for c in t) / n if n else 0.0
    return {
        "chars": float(n), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"), "symbols": share("#$%&*|!@^~<>{}[]=+_\\/"), "bars": share("|"), "stops": share(".,;:?"),
        "lines": float(len(lines)), "fresh_lines": len(set(lines)) / len(lines), "words": float(len(found)), "fresh_words": len(set(found)) / len(found), "word_length": n / len(found),
    }


def quality(text, model):
    """Score of a text by the rules of an ensemble."""
    x = statistics(text)
    total = model.bias + sum(w for r, w in zip(model.rules, model.weights, strict=True) if all((x[k] <= t) if low else (x[k] > t) for k, low, t in r.parts))
    return 1 / (1 + math.exp(-total))
