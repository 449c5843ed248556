"""Plain Python versions of the operators, for small inputs."""

import collections
import math
import re
import zlib

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text, size=4):
    words = WORDS.findall(lower(text))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    if words and not shingles:
        shingles = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows, radius=4):
    """{(doc_id, text): least doc_id reachable} over rows with ids."""
    prints = [(d, simhash(t)) for d, t in rows]
    label = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= radius and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def repeats(texts, length):
    """Mask of removed bytes for every text."""
    bodies = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    masks = []
    for b in bodies:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                mask[i : i + length] = True
        masks.append(mask)
    return bodies, masks


def word_statistics(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base_scores(rows):
    """(n_tokens, n_known, train tokens, base score) of every row."""
    tokens = [WORDS.findall(lower(t)) + [None] for _, t in rows]
    counts = collections.Counter(x for (d, _), own in zip(rows, tokens) if not held_out(d) for x in own)
    n, v = sum(counts.values()), len(counts)
    return [
        (len(own), sum(counts[x] > 0 for x in own), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own))
        for own in tokens
    ]


def recurring(rows, depth, min_docs, share):
    """{doc_id: (lines with words, dropped, text)} for rows with different ids."""
    lines = []
    for d, t in rows:
        for at, line in enumerate((t or "").split("\n")):
            words = ["<*>" if re.search("[0-9]", w) else w for w in WORDS.findall(line)]
            if words:
                lines.append((d, at, words, (len(words), *words[:depth])))
    docs = collections.defaultdict(set)
    for d, _, _, leaf in lines:
        docs[leaf].add(d)
    lines = [x for x in lines if len(docs[x[3]]) >= min_docs]
    seen = collections.Counter((leaf, i, w) for _, _, words, leaf in lines for i, w in enumerate(words) if w != "<*>")
    found = collections.defaultdict(list)
    for d, at, words, leaf in lines:
        kept = tuple(w if seen[leaf, i, w] >= min_docs else "<*>" for i, w in enumerate(words))
        if sum(w != "<*>" for w in kept) >= share * len(kept):
            found[leaf, kept].append((d, at))
    drop = set()
    for places in found.values():
        if len({d for d, _ in places}) >= min_docs:
            drop |= set(places) - {min(places)}
    out = {}
    for d, t in rows:
        parts = (t or "").split("\n")
        gone = {at for e, at in drop if e == d}
        filled = sum(bool(WORDS.search(x)) for x in parts)
        out[d] = (filled, len(gone), "\n".join(x for i, x in enumerate(parts) if i not in gone))
    return out


def top_k(vectors, queries, k, scale=64):
    """(query, rank, id, score) rows over (id, vector) pairs."""
    usable = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for q, x in usable:
        if queries(q):
            scored = sorted(
                (-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q and len(x) == len(y)
            )
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out
