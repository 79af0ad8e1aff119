"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def repeats(rows, window):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, t in data:
        for i in range(len(t) - window + 1):
            w = t[i:i + window]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d, t in data:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((d, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if 0 < len(w) < width:
        return {tuple(w)}
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def groups(rows, width, percent):
    """doc_id -> (n_shingles, component_id) by all pairs; ids are distinct."""
    sets = {d: shingles(t, width) for d, t in rows}
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d]) for d in sets}


def contamination(rows, items, window=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            for k in range(max(1, len(v) - window + 1) if v else 0):
                part = v[k:k + window]
                for at in range(len(w) - len(part) + 1):
                    if w[at:at + len(part)] == part:
                        found.add(str(i))
                        hit.update(range(at, at + len(part)))
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def judged(rows, rules):
    """(page_id, host, path, rule, verdict)."""
    out = []
    for p, u in rows:
        host = path = ""
        if u is not None and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
            host, path = m[1].translate(LOWER), m[2]
        fits = [(len(h) + len(x), h + x, v) for h, x, v in rules if (host == h or host.endswith("." + h)) and path.startswith(x)]
        best = max(fits) if fits else (0, None, "allow")
        out.append((p, host, path, best[1], best[2]))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


ANCHORS = set("the a of and to in is that der die und das ist zu den mit le la les de et des un que el los y en".split())


def signatures(text, gap=16, share=4):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content, k, out = [w for w in words if w not in ANCHORS], 0, set()
    for i, w in enumerate(words):
        common = w in ANCHORS
        if not common:
            k += 1
        lonely = not common and not ANCHORS & set(words[max(0, i - gap):i]) and xxhash.xxh64_intdigest(w.encode(), 42) % share == 0
        if (common or lonely) and k + 2 <= len(content):
            out.add((content[k], content[k + 1]))
    return out or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0
