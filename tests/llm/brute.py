"""Plain versions of the operators, for small inputs."""

import hashlib
import re


def removed_repeats(rows):
    """doc_id -> bytes, removed bytes, spans, hash of the rest: windows of 50 bytes that a smaller document has."""
    first, out = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            if first.setdefault(w, d) < d:
                covered[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = len(re.findall(rb"\x01+", bytes(covered)))
        out[d] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    """doc_id -> set size and smallest document reachable by links."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def exact_keepers(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    keep = {}
    for members in groups.values():
        for _, d in members:
            keep[d] = (min(members)[1], len(members))
    return keep


def repeat_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def spans(text):
    """Base spans of personal data."""
    t, out = text or "", []

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(d := re.sub(r"\D", "", v)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub(r"\D", "", v)) <= 15),
    )
    for kind, p, ok in kinds:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m[0])]
    return out
