"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re

_LOW = {c: c + 32 for c in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def low(s):
    return (s or "").translate(_LOW)


def blanks(s):
    return (s or "").encode().split()


def substring(rows, n=50):
    first = {}
    for d, t in rows:
        w = blanks(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = blanks(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def lines(rows, chars=20, docs=3):
    white = " \t\n\v\f\r"
    key = lambda x: low(x.strip(white))
    held = {}
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= chars:
                    held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        stay = [x for x in every if not (d is not None and len(held.get(key(x), ())) >= docs and d != max(held[key(x)]))]
        out.append((d, len(every), len(every) - len(stay), sha("\n".join(stay))))
    return out


def near(rows, k=2, percent=80):
    sets = []
    for _, t in rows:
        w = low(t).encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    top[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if d is not None else None, d is None or least[find(i)] == d) for i, (d, _) in enumerate(rows)]


def contaminated(rows, items, n=13, share=20):
    wins = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for d, t in rows:
        w = ALNUM.findall(low(t))
        hit, ids = set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if f := wins.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    ids |= f
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit) and share * len(hit) >= len(w)))
    return out


def spark_hash(*texts, seed=42):
    """The 64-bit hash Spark gives a string, or an array of strings, as an unsigned number."""
    import xxhash

    for t in texts:
        seed = xxhash.xxh64(t.encode(), seed=seed).intdigest()
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def winnowed(text, k=4, w=9):
    """(place, hash) of the kept grams: in every window of w grams the one of least 32 leading bits, the rightmost of equals."""
    units = re.findall(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]{1,8}[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+", text or "")
    grams = [spark_hash(*units[i : i + k]) for i in range(max(1, len(units) - k + 1))] if units else []
    kept = set()
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        window = range(i, min(i + w, len(grams)))
        least = min(grams[j] >> 32 for j in window)
        kept.add(max(j for j in window if grams[j] >> 32 == least))
    return [(j + 1, grams[j]) for j in sorted(kept)]


def fingerprints(rows):
    """(doc_id, n_chars, sha of the edited text, both fingerprints, both likenesses) of each row."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, signed(spark_hash(rows[i][1] or ""))), reverse=True)
    write = lambda f: " ".join(f"{a:X}:{h:X}" for a, h in f)

    def alike(a, b):
        a, b = {h for _, h in a}, {h for _, h in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    out = []
    for n, i in enumerate(order):
        d, t = rows[i][0], rows[i][1] or ""
        other = rows[order[(n + 1) % len(order)]][1] or ""
        m = len(t) // 3
        edited_ = t[: len(t) - m] + other[:m]
        f, e = winnowed(t), winnowed(edited_)
        out.append((d, len(t), sha(edited_), write(f), write(e), alike(f, e), alike(f, winnowed(other))))
    return out


def audit(rows, labels):
    """(part, order, step, seven counts) by going through the filters document by document."""
    from itertools import permutations

    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = blanks(t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t])
        docs.append((lang or "", {f for f, x in zip("ABCDE", fails) if x}, any(d is not None and i == d and q == 1 for i, q, _ in labels), any(d is not None and i == d and x == 1 for i, _, x in labels)))
    out, every = {}, {}
    for part in {x[0] for x in docs}:
        mine = [x[1:] for x in docs if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, stay = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                counts = [len(stay), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                out[part, order, step] = counts
                every[part, f] = every.get((part, f), 0) + len(gone)
                left = stay
    return [(*k, *v, every[k[0], k[1][k[2] - 1]]) for k, v in out.items()]


def aligned(rows, encode_a, encode_b):
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum); encoders give (id, bytes) of each token."""
    from collections import Counter

    found = []
    for d, t in rows:
        a, b = (encode_a(" " + t), encode_b(t)) if t else ([], [])
        want = (" " + (t or "")).encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a, b = [], []
        ends = []
        for tokens in (a, b):
            at, e = 0, []
            for _, x in tokens:
                at += len(x)
                e.append(at)
            ends.append(e)
        shared = set(ends[0]) & set(ends[1])
        groups, sides, links = [], ([], []), []
        for e, side, i in sorted([(e, 0, i) for (i, _), e in zip(a, ends[0])] + [(e, 1, i) for (i, _), e in zip(b, ends[1])], key=lambda x: x[:2]):
            sides[side].append(i)
            if side and e in shared:
                groups.append("|".join(",".join(map(str, x)) for x in sides))
                links.append((sides[0][-1], i))
                sides = ([], [])
        found.append((d, len(a), len(b), len(groups), links, ";".join(groups)))
    n = Counter(x for f in found for x in f[4])
    best = {}
    for (_, j), k in n.items():
        best[j] = max(best.get(j, 0), k)
    return [(d, a, b, g, len(k), s, sum(n[x] == best[x[1]] for x in k), sum(n[x] for x in k)) for d, a, b, g, k, s in found]


def simhashes(rows, k=3, radius=2):
    """(doc_id, fingerprint, component_id)."""
    import xxhash

    points = []
    for _, t in rows:
        w = low(t).encode().split()
        s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        points.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    top = components(points, radius)
    least = {}
    for t, (d, _) in zip(top, rows):
        if d is not None:
            least[t] = min(least.get(t, d), d)
    return [(d, f"{p:016x}", least.get(t)) for (d, _), p, t in zip(rows, points, top)]


def components(points, radius=2):
    """For each of the numbers the first one that links of at most `radius` differing bits reach."""
    top = list(range(len(points)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, p in enumerate(points):
        for j in range(i):
            if (p ^ points[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]
