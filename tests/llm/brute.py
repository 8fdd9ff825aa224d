"""Plain one-machine versions of the text operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def fingerprint(text, size=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in SPACE.split(text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, radius=2):
    """Smallest id reachable over prints within the radius; ids may be None."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(ids)):
        members[find(i)].append(ids[i])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return [least[find(i)] for i in range(len(ids))]


def exact(rows):
    """(id, keep_id, size, sha) sorted, and how many rows stay, of (id, text) rows."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub("", text or "")].append((doc_id, text or ""))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(m[0], keep, len(members), sha) for m in members]
    return sorted(out, key=repr), len(groups)


def cosines(vectors, ids, query, count=5):
    """The best (id, cosine) of all rows but the query's own."""
    v = np.asarray(vectors, float)
    q = v[ids.index(query)]
    score = (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))
    order = sorted((-s, i) for s, i in zip(score, ids) if i != query)
    return [(i, -s) for s, i in order[:count]]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
