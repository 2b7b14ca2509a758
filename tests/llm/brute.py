"""Plain Python versions of the operators' contracts."""

import hashlib
import re
from collections import Counter

import xxhash


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rules(text):
    w, text = words(text), text or ""
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_reachable(rows, near):
    """{index: smallest id} for rows of (id, value), linked where near(value, value)."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items, window=10):
    w, hit, found = bench_words(text), set(), set()
    for item, other in items:
        o = bench_words(other)
        n = min(window, len(o))
        grams = {tuple(o[i : i + n]) for i in range(len(o) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                found.add(item)
                hit |= set(range(i, i + n))
    return len(w), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit)


def line_dedup(rows, order, width=3):
    """Rows of (doc_id, text) in the order given by `order` (indices): (lines, removed, text) for each."""
    seen, out = set(), {}
    for i in order:
        text = rows[i][1]
        if text is None:
            out[i] = (0, 0, None)
            continue
        lines = text.split("\n")
        place = [k for k, x in enumerate(lines) if words(x)]
        gone = set()
        mine = []
        for k in range(len(place) - width + 1):
            window = tuple(lines[p] for p in place[k : k + width])
            if window in seen or window in mine:
                gone |= set(place[k : k + width])
            mine.append(window)
        seen |= set(mine)
        out[i] = (len(place), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return [out[i] for i in range(len(rows))]


def substring_dedup(texts, length=35):
    all_words = [words(x) for x in texts]
    many = Counter(tuple(w[i : i + length]) for w in all_words for i in range(len(w) - length + 1))
    out = []
    for w in all_words:
        gone = {i + k for i in range(len(w) - length + 1) if many[tuple(w[i : i + length])] > 1 for k in range(length)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def shingle_set(text, width=5):
    w = words((text or "").lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0
