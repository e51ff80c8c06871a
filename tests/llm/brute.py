"""Plain Python versions of the operators' contracts, and rows that are hard on them."""

import collections
import hashlib
import random
import re

import numpy as np

WORDS = [f"w{i}" for i in range(300)] + ["é", "the", "of"]


def removed(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted({(k, t or "") for k, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def near(rows, k):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    holders = collections.defaultdict(list)
    for key, s in sets.items():
        for x in s:
            holders[x].append(key)
    up = {key: key for key in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = {key: (key is not None, key or 0) for key in sets}
    for key, s in sets.items():
        for other, n in collections.Counter(o for x in s for o in holders[x] if order[o] < order[key]).items():
            if 100 * n >= 80 * (len(s) + len(sets[other]) - n):
                a, b = sorted((root(key), root(other)), key=order.get)
                up[b] = a
    return {key: (len(sets[key]), root(key)) for key in sets}


def leaks(docs, items):
    words = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").lower())
    number = collections.defaultdict(lambda: len(number))
    coded = [(item, np.array([number[w] for w in words(t)])) for item, t in items]
    out = {}
    for key, text in docs:
        d, bad = np.array([number[w] for w in words(text)]), set()
        for item, b in coded:
            n = min(13, len(b))
            need = n - n * 2 // 13
            if n and len(d) >= n:
                same = d[:, None] == b[None, :]
                found = sum(same[t : len(d) - n + 1 + t, t : len(b) - n + 1 + t].astype(int) for t in range(n))
                if (found >= need).any():
                    bad.add(item)
        out[key] = sorted(bad)
    return out


def stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def passages(seed=1, n=120):
    """Documents that share passages, some far, some within themselves; a null, an empty, a long and a periodic one; a repeated row."""
    rnd = random.Random(seed)
    shared = [" ".join(rnd.choices(WORDS, k=60)) for _ in range(5)]
    rows = [(i, " ".join([*rnd.choices(WORDS, k=rnd.randint(0, 30)), rnd.choice(shared), *rnd.choices(WORDS, k=rnd.randint(0, 40)), rnd.choice(shared)[5:]])) for i in range(n)]
    return rows + [(1000, "a" * 3000), (1001, "ab" * 700), (1002, None), (1003, ""), (1004, "ab" * 100 + "q"), (7000, rows[3][1]), (7001, rows[3][1] + "z"), rows[9], (8000, "short")]


def near_copies(seed=5, n=250):
    """Texts of many sizes with a share of their words replaced."""
    rnd = random.Random(seed)
    base = [rnd.choices(WORDS, k=rnd.choice([3, 8, 30, 100, 200])) for _ in range(8)]
    rows = []
    for i in range(n):
        share = rnd.random() * 0.2
        w = [x if rnd.random() > share else rnd.choice(WORDS) for x in rnd.choice(base)]
        rows.append((i, " ".join(w) if rnd.random() < 0.7 else "  " + "\n".join(w).upper().replace("É", "é")))
    return rows + [(900, None), (901, ""), (902, "  "), (903, "one"), (904, "ONE"), (905, "É a"), (906, "é a"), rows[7], (None, rows[8][1])]
