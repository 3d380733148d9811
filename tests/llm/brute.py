"""Plain statements of what the operators compute, for small inputs."""

import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    w = SPACED.findall(low(text))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def similar(a, b):
    k = len(a & b)
    return 100 * k >= 80 * (len(a) + len(b) - k)


def components(rows):
    """(id, shingles, smallest id reached) per row, ids distinct."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and similar(a, b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def without_lines(rows):
    seen, out = [], {}
    for i, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            s = shingles(line)
            if not s or not any(similar(s, other) for other in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = "\n".join(kept)
    return out


def contamination(rows, items, window=10):
    windows = {}
    for i, text in items:
        w = ALNUM.findall(low(text))
        for a in [tuple(w)] if 0 < len(w) < window else [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]:
            windows.setdefault(a, set()).add(i)
    out = []
    for i, text in rows:
        w = ALNUM.findall(low(text))
        hit, found = [0] * len(w), set()
        for size in {len(a) for a in windows}:
            for k in range(len(w) - size + 1):
                if (w_items := windows.get(tuple(w[k : k + size]))) is not None:
                    hit[k : k + size] = [1] * size
                    found |= w_items
        out.append((i, len(w), sum(hit), sorted(map(str, found))))
    return out


def spans(text):
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


__all__ = ["components", "contamination", "low", "shingles", "similar", "spans", "without_lines"]
