"""Plain versions of the operators' results, one document at a time."""

import collections
import re
import zlib

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, pattern=SPACED):
    return pattern.findall(lower(text))


# ------------------------------------------------------------ near-duplicates
def near(docs, k, percent=80):
    """id -> (n_shingles, component_id)"""
    sets = {}
    for i, text in docs:
        w = words(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    holders, shared = collections.defaultdict(list), collections.Counter()
    for i in sorted(sets):
        for s in sets[i]:
            shared.update((other, i) for other in holders[s])
            holders[s].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


# ------------------------------------------------------------ benchmark windows
def contamination(docs, items, window=13):
    """id -> (n_words, n_hit, sorted item ids)"""
    kinds = collections.defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            kinds[tuple(w[j : j + n])].add(str(item))
    sizes = {len(k) for k in kinds}
    out = {}
    for i, text in docs:
        w, hit, found = words(text, ALNUM), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if items_here := kinds.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= items_here
        out[i] = (len(w), len(hit), sorted(found))
    return out


# ------------------------------------------------------------ quality
def quality(text):
    text = text or ""
    w = SPACED.findall(text)
    grams = collections.defaultdict(list)
    for j in range(len(w) - 4):
        grams[tuple(w[j : j + 5])].append(j)
    repeated = {j + d for places in grams.values() if len(places) > 1 for j in places for d in range(5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    dup = len(lines) - len(set(lines))
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(repeated)}
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    kept = not (failed or 10 * out["n_symbols"] > len(w) or 10 * dup > 3 * len(lines))
    return out | {"base_failed": failed, "kept": kept}


# ------------------------------------------------------------ secrets
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


# ------------------------------------------------------------ byte strings
def kept_bytes(docs, size=50):
    """id -> (n_bytes, removed places)"""
    first = {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        for k in range(len(b) - size + 1):
            first.setdefault(b[k : k + size], i)
    out = {}
    for i, text in docs:
        b = (text or "").encode()
        out[i] = (len(b), {k + d for k in range(len(b) - size + 1) if first[b[k : k + size]] < i for d in range(size)})
    return out


# ------------------------------------------------------------ sentences
def sentences(text):
    out, current, found = [], [], list(SPACED.finditer(text or ""))
    for j, m in enumerate(found):
        current.append(m)
        w = m[0]
        for _ in range(3):
            w = w[:-1] if len(w) > 1 and w[-1] in "\"')]" else w
        after = found[j + 1].start() if j + 1 < len(found) else len(text)
        if w[-1] in ".!?;:," or "\n" in text[m.end() : after] or j + 1 == len(found):
            out.append(current)
            current = []
    return out


def kept_sentences(docs, at_least=3, n_words=20):
    """id -> (n_sentences, removed sentences, kept text)"""
    split = {i: sentences(text) for i, text in docs}
    places = collections.defaultdict(list)
    for i in sorted(split):
        s = split[i]
        for a in range(len(s)):
            b = a + at_least
            while b <= len(s) and sum(map(len, s[a:b])) < n_words:
                b += 1
            if b <= len(s):
                places[tuple(lower(m[0]) for x in s[a:b] for m in x)].append((i, a, b))
    gone = collections.defaultdict(set)
    for found in places.values():
        for i, a, b in found[1:]:
            gone[i].update(range(a, b))
    out = {}
    for i, text in docs:
        edges = [x[0].start() for x in split[i]] + [len(text or "")]
        kept = (text or "")[: edges[0]] + "".join(text[edges[j] : edges[j + 1]] for j in range(len(split[i])) if j not in gone[i])
        out[i] = (len(split[i]), gone[i], kept)
    return out


# ------------------------------------------------------------ periodic runs
def runs(w, least=6, times=4):
    """(start, length, period) of runs, by start, then period: each period on its own, powers of a shorter one left out"""
    out = []
    for q in range(1, len(w) // times + 1):
        equal = "".join("=" if a == b else "." for a, b in zip(w, w[q:]))
        for m in re.finditer("=+", equal):
            start, length = m.start(), m.end() - m.start() + q
            stretch = w[start : start + length]
            if length >= max(least, times * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    """(words after the repeated tail, runs, kept words)"""
    w = SPACED.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = runs(w)
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return w, found, [x for i, x in enumerate(w) if i not in gone]
