"""Plain Python versions of the operators, for comparison on small inputs."""

import hashlib
import re

import xxhash


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def base_spans(text):
    text, found = text or "", []
    pattern = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for m in re.finditer(pattern, text, re.A | re.I):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, "assign", m.end(), m[2]))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            found.append((m.start(), 1, "access", m.end(), m[0]))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 16:
            found.append((m.start(), 2, "hex", m.end(), m[0]))
    return sorted(found)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e, _ in spans)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
