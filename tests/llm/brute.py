"""Plain Python twins of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from tessera.llm import toxicity

WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text):
    return WORDS.findall((text or "").lower().encode())


def grams(text, n):
    w = words(text)
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else [])


def near(docs, n, threshold):
    """{(a, b): jaccard}, equal sets as stars, for (id, text)."""
    sets = defaultdict(set)
    for i, t in docs:
        if i is not None and words(t):
            sets[frozenset(grams(t, n))].add(i)
    out = {}

    def put(a, b, j):
        if a != b:
            out[min(a, b), max(a, b)] = max(j, out.get((min(a, b), max(a, b)), 0))

    keys = list(sets)
    for s in keys:
        for i in sets[s]:
            put(min(sets[s]), i, 1.0)
    for x in range(len(keys)):
        for y in range(x):
            both = len(keys[x] & keys[y])
            j = both / (len(keys[x]) + len(keys[y]) - both)
            if j >= threshold - 1e-12:
                put(min(sets[keys[x]]), min(sets[keys[y]]), j)
    return out


def classes(docs, n, threshold):
    """{id: (class, links)} of (id, text)."""
    sets = [(i, frozenset(grams(t, n))) for i, t in dict.fromkeys(docs) if i is not None]
    sets = list(dict.fromkeys((i, s) for i, s in sets if s))
    links, pairs = Counter(), []
    for x, (i, s) in enumerate(sets):
        for j, r in sets[:x]:
            if i == j and s != r or len(s & r) / len(s | r) >= threshold - 1e-12:
                pairs.append((i, j))
                if len(s & r) / len(s | r) >= threshold - 1e-12:
                    links.update([i, j])
    root = groups(pairs)
    return {i: (root.get(i, i), links[i]) for i, _ in docs if i is not None}


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def contaminated(docs, items, n, theta):
    """Rows (doc_id, item_id, containment, matched, size, start), the best of each pair, of (id, text)."""
    out = {}
    for item, text in items:
        if item is None or not words(text):
            continue
        listed = grams(text, n)
        want = set(listed)
        need = max(1, math.ceil(round(theta * len(want), 9)))
        for doc, body in docs:
            g = grams(body, n)
            at = [k for k, x in enumerate(g) if x in want]
            best, start = 0, 0
            for k in at:
                inside = [p for p in at if k - len(listed) < p <= k]
                if len({g[p] for p in inside}) > best:
                    best, start = len({g[p] for p in inside}), inside[0]
            if best >= need:
                row = (best / len(want), -start, len(want), best)
                out[doc, item] = max(out.get((doc, item), row), row)
    return {(d, i, round(r[0], 9), r[3], r[2], -r[1]) for (d, i), r in out.items()}


def pack(docs, capacity, seed):
    """Rows (doc_id, piece, first, units, window, from) of one packer, with every objective computed in full."""
    order = sorted(((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i is None, i or 0, n) for i, n in docs))
    levels, opened, out = defaultdict(list), 0, []
    for _, void, i, n in order:
        i, at, piece = None if void else i, 0, 0
        if not n:
            out.append((i, 0, 0, 0, None, None))
        while at < n:
            size = min(capacity, n - at)
            best = (0, 0)
            if size < capacity:
                scores = []
                for h in [0, *(h for h in levels if levels[h] and h + size <= capacity)]:
                    count = Counter({k: len(v) for k, v in levels.items()})
                    count[h] -= h > 0
                    if h + size < capacity:
                        count[h + size] += 1
                    scores.append((sum(v * v for v in count.values()), -h))
                best = min(scores)
            h = -best[1]
            if h:
                window = levels[h].pop()
            else:
                window, opened = opened, opened + 1
            out.append((i, piece, at, size, window, h))
            if h + size < capacity:
                levels[h + size].append(window)
            at, piece = at + size, piece + 1
    return out


def toxic(text, grammar):
    """The transducers run side by side over every clause."""
    worst = 0.0
    for clause in re.split(r"[.!?;:\n]", (text or "").lower().replace("’", "'")):
        states, score = [0] * 5, 0.0
        for word in toxicity.TOKEN.findall(clause):
            symbol, lexical = toxicity.symbol_of(word), 0.0
            if symbol in (toxicity.OTHER, toxicity.INS):
                lexical = grammar.weight(word)
                symbol = toxicity.INS if lexical else symbol
            steps = [f(q, symbol) for (f, _), q in zip(toxicity.PARTS, states)]
            score += lexical * math.prod(s[1] for s in steps) + sum(s[2] for s in steps) * math.prod(s[3] for s in steps)
            states = [s[0] for s in steps]
        worst = max(worst, score)
    return round(worst, 6)


KINDS = {**{c: 0 for c in [*range(33), 127]}, **{c: 1 for c in [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]}}


def fold(values):
    """The 64-bit finaliser of the hashes, on plain integers."""
    m = (1 << 64) - 1
    h = values & m
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & m
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D & m
    return h ^ h >> 33


def quality(text, model, threshold):
    """(probability, keep): tokens, pooling, network and temperature, value by value."""
    data, base, rows, shapes, last = text.encode(), 0x9E3779B97F4A7C15 | 1, [], [], None
    for run in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20\x7f]+", data):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in run)
        bucket = fold(sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(low))) % len(model["vectors"])
        ups, digits = sum(65 <= c <= 90 for c in run), sum(48 <= c <= 57 for c in run)
        if KINDS.get(run[0], 2) == 2:
            shape = 1 if len(run) > 1 else 2
        else:
            shape = 3 if digits else 4 if ups > 1 and 2 * ups > len(run) else 5 if ups > 1 else 6 if ups else 7 if len(run) > 14 else 0
        shape = 8 if bucket == last else shape
        rows.append(model["vectors"][bucket])
        shapes.append(model["shapes"][shape])
        last = bucket
    n = len(rows)
    if not n:
        return None, True
    mean = [sum(float(v[j]) for v in part) / n for part in (rows, shapes) for j in range(len(part[0]))]
    share = n / (n + 10)
    z = [((a * share + g * (1 - share)) - m) / s for a, g, m, s in zip(mean, model["good"], model["mean"], model["std"])]
    hidden = [max(0.0, sum(a * w for a, w in zip(z, model["w1"][:, j])) + model["b1"][j]) for j in range(len(model["b1"]))]
    logit = (sum(a * w for a, w in zip(hidden, model["w2"])) + model["b2"][0]) / model["temperature"]
    p = 1 / (1 + math.exp(-max(-60, min(60, logit))))
    return p, p >= threshold


def stems(toxic, clean):
    """The induction, each count made anew from the documents."""
    starts = lambda w: {w[:k] for k in range(toxicity.SHORTEST, min(len(w), toxicity.LONGEST) + 1)}
    toxic = [d for d in toxic if not d & set(toxicity.INSULT)]
    seen = set().union(*clean)
    holds = lambda p, d: any(p in starts(w) for w in d)
    every = {p for d in toxic for w in d - seen for p in starts(w)}
    where = {p: {i for i, d in enumerate(toxic) if holds(p, d - seen)} for p in every}
    where = {p: s for p, s in where.items() if len(s) >= toxicity.SUPPORT}
    wrong = {p: sum(holds(p, d) for d in clean) for p in where}
    left, out = set(range(len(toxic))), {}
    open_ = {p for p in where if wrong[p] <= 0.01 * len(where[p]) and p not in toxicity.SYMBOLS}
    while open_:
        best = max(open_, key=lambda p: (len(where[p] & left), len(p), p))
        if len(where[best] & left) < toxicity.SUPPORT:
            break
        out[best] = round(max(0.0, min(2.0, math.log2((len(where[best]) + 0.5) / (wrong[best] + 0.5)) / 2)), 6)
        left -= where[best]
        open_ = {p for p in open_ - {best} if len(where[p] & left) >= toxicity.SUPPORT}
    least = [min(d, key=lambda w: zlib.crc32(w.encode()), default="") for d in toxic]
    apart = {p: len({least[i] for i in s}) for p, s in where.items() if not wrong[p] and len(s) >= toxicity.FREQUENT and p not in toxicity.SYMBOLS}
    for p in sorted(apart, key=lambda p: (-apart[p], -len(p), p)):
        if apart[p] >= toxicity.FREQUENT and not any(p.startswith(q) or q.startswith(p) for q in out):
            out[max((q for q in apart if q.startswith(p) and apart[q] >= 0.8 * apart[p]), key=lambda q: (len(q), q))] = 1.0
    return out


def coverage(text):
    text = (text or "").lower()
    spans = [(m.start(), m.end()) for m in re.finditer(r"[0-9a-z\x80-\U0010ffff]+", text)]
    w, out = [text[a:b] for a, b in spans], {}
    for n in (2, 3, 4):
        where = defaultdict(list)
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].append(k)
        rank = [(len(v), spans[v[0] + n - 1][1] - spans[v[0]][0]) for v in where.values() if len(v) > 1]
        top = max(rank, default=(0, 0))
        out[f"top_{n}"] = min(1.0, top[0] * top[1] / max(1, len(text)))
    for n in range(5, 11):
        many, inside = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)), set()
        for k in range(len(w) - n + 1):
            if many[tuple(w[k : k + n])] > 1:
                inside.update(range(spans[k][0], spans[k + n - 1][1]))
        out[f"dup_{n}"] = len(inside) / max(1, len(text))
    lines = [x for x in text.split("\n") if re.search(r"[0-9a-z\x80-\U0010ffff]", x)]
    many = Counter(lines)
    out["dup_lines"] = sum(len(x) for x in lines if many[x] > 1) / max(1, len(text))
    return out


def tree_bits(texts, first=3, grow=4, share=16):
    """Code length in bits of each text under the context tree of all of them, and the greatest depth of its contexts."""
    data = [(t or "").encode() for t in texts]
    spots = [(d, k) for d in data for k in range(len(d))]
    ctx = lambda d, k, n: d[max(0, k - n) : k].rjust(n, b"\0")
    least = max(1, math.ceil(grow * math.sqrt(len(spots))))
    longer, live, depth = set(), spots, first
    while live:  # contexts that are extended, depth by depth
        seen, ahead = Counter(ctx(d, k, depth) for d, k in live), defaultdict(Counter)
        for d, k in live:
            ahead[ctx(d, k, depth)][ctx(d, k, depth + 1)[0]] += 1
        new = {c for c, n in seen.items() if n >= least and n - max(ahead[c].values()) >= max(least, n / share)}
        longer |= new
        live = [(d, k) for d, k in live if ctx(d, k, depth) in new]
        depth += 1

    def path(d, k):
        out = [ctx(d, k, n) for n in range(first + 1)]
        while out[-1] in longer:
            out.append(ctx(d, k, len(out)))
        return out

    def each(d):
        for k in range(len(d)):
            node, contexts = 1, path(d, k)
            for j in range(7, -1, -1):
                bit = d[k] >> j & 1
                yield [(c, node) for c in contexts], bit
                node = 2 * node + bit

    counts, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    for d in data:
        for way, bit in each(d):
            for a, b in zip(way, way[1:]):
                kids[a].add(b)
            for key in way:
                counts[key][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted, own = {}, {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        pe = kt(*counts[key])
        if not kids[key]:
            weighted[key], own[key] = pe, 1.0
        else:
            below = sum(weighted[x] for x in kids[key])
            top = max(pe, below)
            weighted[key] = math.log(0.5) + top + math.log(math.exp(pe - top) + math.exp(below - top))
            own[key] = math.exp(pe + math.log(0.5) - weighted[key])
    out = []
    for d in data:
        total = 0.0
        for way, bit in each(d):
            p, rest = 0.0, 1.0
            for key in way:
                p, rest = p + rest * own[key] * (counts[key][bit] + 0.5) / (sum(counts[key]) + 1), rest * (1 - own[key])
            total -= math.log2(p)
        out.append(total)
    return out, max((len(way[-1][0]) for d in data for way, _ in each(d)), default=0)
