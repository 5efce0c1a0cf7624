"""Plain Python statements of what the operators return, and small tables with every odd case."""

import hashlib
import random
import re
import zlib

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def passage(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ép", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randint(0, 40)) for _ in range(n))


def documents(n=60, seed=7):
    """(doc_id, text): copies, near copies, shared passages, repeats within, empty, null, white space, very long."""
    rng = random.Random(seed)
    base, shared = passage(rng, 120), passage(rng, 45)
    rows = [(i, passage(rng, rng.randint(1, 150))) for i in range(n)]
    rows += [(n + i, base) for i in range(5)]
    for i in range(12):
        w = base.split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((n + 10 + i, " ".join(w)))
    rows += [(n + 30 + i, passage(rng, 20) + "\n" + shared + "\t" + passage(rng, 30)) for i in range(6)]
    rows += [(n + 50, shared + " " + shared), (n + 51, ""), (n + 52, None), (n + 53, " \n\t "), (n + 54, "two words"), (n + 55, "Two WORDS"), (n + 56, "x " * 3000), (n + 57, passage(rng, 9000)), (n + 58, "a\x0bb\x0cc\x1cd e"), (n + 59, "中文 字符 😀 é é <|endoftext|> tail")]
    rng.shuffle(rows)
    return rows


#: Names that operators use inside, as columns of the input.
CLASHES = ["key", "dup", "node", "part", "runs", "bucket", "spans", "base", "score", "kept", "column", "__key", "rank"]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, ["en", "fr", None][(i or 0) % 3], f"src{(i or 0) % 4}" if i is None or i % 5 else None) for i, t in rows], "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    for c in CLASHES if extra else []:
        df = df.withColumn(c, F.lit(c))
    return df


def shingles(text, n=5):
    w = [lower(x) for x in words(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    top = list(range(len(sets)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                top[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return {i: (len(s), least[find(a)] if s else i) for a, (i, s) in enumerate(sets)}


def repeats(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone[p : p + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
KINDS = (("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def secrets(text):
    found = sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(g)) >= least)
    return [(a, b, name) for a, _, b, name in found]


BARE = re.compile("[A-Za-z0-9+/_-]{20,}")


def redacted(rows):
    """{doc_id: text} of (doc_id, text, source, lang) with secrets replaced: the base spans, and bare words of letters and
    digits that fewer than three sources and four pairs of source and language have, apart from base spans."""
    spans, owners, places = {}, {}, {}
    for i, text, source, lang in rows:
        base = [(a, b, None) for a, b, _ in secrets(text)]
        bare = [(m.start(), m.end(), m[0]) for m in BARE.finditer(text or "") if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, b, _ in base)]
        spans[i] = base + bare
        values = [m.group(g) for _, p, g, least in KINDS for m in p.finditer(text or "") if len(m.group(g)) >= least] + [v for _, _, v in bare]
        for v in values:
            owners.setdefault(v, set()).add(source or "")
            places.setdefault(v, set()).add((source or "", "/".join(x for x in (source, lang) if x is not None)))
    out = {}
    for i, text, _, _ in rows:
        own = sorted((a, b) for a, b, v in spans[i] if v is None or len(owners[v]) < 3 and len(places[v]) < 4)
        done, at = "", 0
        for a, b in own:
            if a >= at:
                done += text[at:a] + "[REDACTED]"
            at = max(at, b)
        out[i] = done + text[at:] if own else text
    return out


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def quality_rules(doc_id, text):
    """Every figure and verdict of one document."""
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]

    def covered(n):
        seen = {}
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p : p + n]), []).append(p)
        return {q for places in seen.values() if len(places) > 1 for p in places for q in range(p, p + n)}

    chars, line_chars, repeat = sum(map(len, w)), sum(map(len, lines)), len(covered(3))
    dup, dup_chars, symbols = len(lines) - len(set(lines)), line_chars - sum(map(len, set(lines))), sum(c in "#*$%&|<>" for c in text or "")
    cover = {n: sum(len(w[q]) for q in covered(n)) for n in (5, 10, 20)}
    failed = len(w) < 50 or repeat / len(w) > 0.5
    bad = failed or dup * 2 > len(lines) or dup_chars * 10 > line_chars * 3 or symbols * 4 > len(w) or any(cover[n] * 20 > chars * x for n, x in ((5, 7), (10, 6), (20, 5)))
    return {
        "doc_id": doc_id, "n_words": len(w), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed, "kept": not bad, "n_lines": len(lines),
        "dup_line_chars": dup_chars, "line_chars": line_chars, "cover_5_chars": cover[5], "cover_10_chars": cover[10], "cover_20_chars": cover[20],
    }


BITS = 2**64 - 1


def mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & BITS
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & BITS
    return h ^ (h >> 31)


def rolled(values):
    out = 0
    for v in values:
        out = (out * 0x9E3779B97F4A7C15 + v) & BITS
    return out


def syncmers(text, k=20, s=8):
    """(place, hash) of the closed syncmers of a text."""
    value = [mix(ord(c) + 0x9E3779B97F4A7C15 & BITS) for c in text]
    inner = [mix(rolled(value[p : p + s])) for p in range(len(text) - s + 1)]
    found = []
    for p in range(len(text) - k + 1):
        own = inner[p : p + k - s + 1]
        if min(own) in (own[0], own[-1]):
            found.append((p, mix(rolled(value[p : p + k]))))
    if text and not found:
        found.append((0, mix(int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little"))))
    return found


def fingerprint(text):
    """(digest, {bin: (hash, place)}) of a text."""
    bins = {}
    for place, h in syncmers(text):
        bins[h >> 58] = min(bins.get(h >> 58, (h, place)), (h, place))
    return hashlib.blake2b(text.encode(), digest_size=2).hexdigest() if text else "", {b: (h >> 16 & 0xFFFF, place) for b, (h, place) in bins.items()}


def written(text):
    digest, bins = fingerprint(text)
    return digest + "".join(f"{bins[b][0]:04x}{bins[b][1]:06x}" if b in bins else "-" * 10 for b in range(64)) if text else ""


def alike(a, b):
    (x, p), (y, q) = fingerprint(a), fingerprint(b)
    pairs = sorted((p[i][1], q[i][1]) for i in p if i in q and p[i][0] == q[i][0])
    best = []
    for i, (_, v) in enumerate(pairs):
        best.append(1 + max((best[j] for j in range(i) if pairs[j][1] < v), default=0))
    return (max(best, default=0) + (x == y)) / (len({*p, *q}) + 1)
