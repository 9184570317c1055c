"""Plain, slow versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

BIG = 2**63 - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass")).hexdigest()


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def url_parts(url, rules):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = lower(host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max((r.rule for r in fit), key=len, default=None)


def pii_base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in m[0] if x.isdigit()]
        odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 16 <= len(d) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def repeats(docs, size=50):
    """docs: [(id, text)] -> [(id, n_bytes, n_removed, n_spans, kept sha)] in the given order."""
    key = lambda i: BIG if i is None else i
    raw = [(t or "").encode() for _, t in docs]
    least = {}
    for (i, _), b in zip(docs, raw):
        for p in range(len(b) - size + 1):
            s = b[p:p + size]
            least[s] = min(least.get(s, BIG + 1), key(i))
    out = []
    for (i, _), b in zip(docs, raw):
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if least[b[p:p + size]] < key(i):
                gone[p:p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def lines(docs, least=10):
    key = lambda i: BIG if i is None else i
    keyed = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(keyed(x)) >= least:
                where[keyed(x)].add(key(i))
    out = []
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if len(where.get(keyed(x), ())) < 2 or min(where[keyed(x)]) == key(i)]
        out.append((i, len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """{source: size} -> {source: target}."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())) * share, set(names), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * unit > most * sizes[s]}
        if not over:
            return out | {s: float(w[s] * unit) for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= over
    return out


def shingles(text, n):
    words = WORD.findall(lower(text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def near(docs, n=2, percent=80):
    """[(id, text)] -> [(id, set size, component)]."""
    sets = [shingles(t, n) for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    top[find(a)] = find(b)
    group = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        group[find(k)].append(BIG if i is None else i)
    return [(i, len(sets[k]), min(group[find(k)])) for k, (i, _) in enumerate(docs)]


def tokens(docs, tok, end=2):
    out, start = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def secrets(text):
    text = text or ""
    name = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
                    for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(m.start(), 0, m.end(), "assign")
           for m in re.finditer(rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, a, z) for a, _, z, k in sorted(out)]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    wins = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if wins[tuple(words[i:i + 3])] > 1 for k in range(3)}
    rows = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(rows) - len(set(rows)), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def importance(docs, target, percent=10, buckets=10_000, seed=2024):
    """docs: [(id, text)], target: [text] -> [(id, n_features, weight, score, rank)]."""
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = (Counter(bucket(w) for x in texts for w in found(x)) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
                 for b in map(bucket, found(text))]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(sha(f"{seed}:{'null' if i is None else i}")[:8], 16)
        rows.append((i, len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): k for k, r in enumerate(fit[:percent * len(fit) // 100], 1)}
    return [(*r, rank.get(id(r))) for r in rows]


def collocations(docs, min_count=10, percent=50, top=2000):
    """docs: [(lang, text)] -> [(lang, rank, phrase, a, l, r, n, score)]."""
    f = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update((lang or "und", *w[i:i + k]) for i in range(len(w) - k + 1))
    n = Counter()
    for (lang, *w), a in f.items():
        n[lang] += a * (len(w) == 1)
    cands = {g: a for g, a in f.items() if len(g) > 2 and a >= min_count}
    out = defaultdict(list)
    for (lang, *w), a in cands.items():
        longer = [b for (x, *v), b in cands.items() if x == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= percent * a for b in longer):
            continue
        cut = min((1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-cut[0], -a, " ".join(w).encode(), f[lang, *w[:cut[1]]], f[lang, *w[cut[1]:]]))
    return [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items()
            for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]


def passages(docs, size=13):
    """docs: [(id, text)] -> [(id, n_words, n_removed, kept sha)]."""
    key = lambda i: BIG if i is None else i
    words = [WORD.findall(t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words):
        for p in range(len(w) - size + 1):
            g = tuple(w[p:p + size])
            least[g] = min(least.get(g, BIG + 1), key(i))
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for p in range(len(w) - size + 1):
            if least[tuple(w[p:p + size])] < key(i):
                gone.update(range(p, p + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out
