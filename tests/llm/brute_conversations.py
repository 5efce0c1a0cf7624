"""Plain Python statements of what the operators on conversations return."""

import hashlib
import itertools
import re
import zlib

BLANKS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text):
    return zlib.crc32(text.encode())


def in_order(rows):
    """(turn, role, text) by turn, those without one first."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def damaged(rows):
    """{conv_id: turns in order} of (conv_id, turn, role, text)."""
    out = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {c: in_order(v) for c, v in out.items()}


def faults(turns):
    found, seen = [], set()
    for _, role, text in turns:
        body = text.strip(BLANKS)
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(turns, found):
    """(cost, audit, repaired) by trying all edits, with up to two insertions at every place."""
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        initials = "".join(r[:1] for r, _ in out)
        if any(len(r) < 1 for r, _ in out) or not re.fullmatch("s?(ua)*u?", initials):
            return
        if i == len(turns):
            for more in inserts:
                if re.fullmatch("(s?(ua)+)?", initials + "".join(r[0] for r in more)):
                    end = (cost + 5 * len(more), audit + "I" * len(more), out + [(r, "") for r in more])
                    if best is None or end[:2] < best[:2]:
                        best = end
            return
        _, role, text = turns[i]
        for more in inserts:
            c, a, o = cost + 5 * len(more), audit + "I" * len(more), out + [(r, "") for r in more]
            go(i + 1, c + 2, a + "D", o)
            if found[i] not in ("blank", "duplicate"):
                extra = 5 * (found[i] == "truncated")
                go(i + 1, c + extra, a + "K", o + [(role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, c + 1 + extra, a + "R", o + [(r, text)])

    go(0, 0, "", [])
    return best


def repairs(rows):
    out = {}
    for c, turns in damaged(rows).items():
        found = faults(turns)
        cost, audit, kept = cheapest(turns, found)
        numbers = [t for t, _, _ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out[c] = {"gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, **{k: found.count(k) for k in ("blank", "duplicate", "truncated")},
                  "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": sha("\n".join(f"{r}:{t}" for r, t in kept))}
    return out


def rebuilt(rows):
    """{conv_id: [(role, text)]}."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    own = {c: [x[1:] for x in in_order(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = crc(str(c)) % 9
        out[c] = own.get(c - c % 5, [])[:h] + v[h:]
    return out


def trie(conversations):
    """{(smallest member, depth): row} of {conv_id: turns}, node by node."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids.get(p, []))
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(p)))))) for p, m in members.items())
