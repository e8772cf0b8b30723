"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re
import zlib

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text, k):
    w = WORD.findall((text or "").encode().translate(_LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(sets, num, den):
    """For each position the least position linked with it, by comparing all pairs."""
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [s for _, _, s in sorted(found)]


def media(text):
    b = (text or "").encode()
    p = b + b" " * (-len(b) % 192 if b else 192)
    return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


MASK = (1 << 64) - 1


def mix64(h):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * factor) & MASK
    return h ^ (h >> 31)


def hash64(data, extra):
    h = sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(data))
    return mix64((h + extra) & MASK)


def term_hashes(text):
    """Hashes of the words (runs of letters) of a text and of the first 4, 5 and 6 bytes of longer ones, with repeats."""
    out = []
    for w in re.findall(rb"[a-z\x80-\xff]+", text.encode().translate(_LOWER)):
        out.append(hash64(w, len(w)))
        out += [hash64(w[:k], k << 20) for k in (4, 5, 6) if len(w) > k]
    return out


def trigrams(text, dim):
    """Counts of hashed letter trigrams: lower case, runs of other characters as one space, a space at either end."""
    low, kept = (text or "").lower(), []
    if not any(map(str.isalpha, low)):
        return {}
    for c in " " + low + " ":
        if c.isalpha():
            kept.append(ord(c))
        elif not kept or kept[-1] != 32:
            kept.append(32)
    out = {}
    m32 = (1 << 32) - 1
    for a, b, c in zip(kept, kept[1:], kept[2:], strict=False):
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & m32
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & m32
        g = h >> (32 - (dim.bit_length() - 1))
        out[g] = out.get(g, 0) + 1
    return out
