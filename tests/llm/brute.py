"""Plain Python versions of the operators, written from their definitions."""

import hashlib
import re

import numpy as np
import xxhash

EMPTY = hashlib.sha256(b"").hexdigest()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bare_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    words = words_of(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    marks = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), marks, dup, len(covered)


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))


def secret_spans(text):
    text = text or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return spans + [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_spans(text):
    text = text or ""

    def digits(s):
        return re.sub(r"[^0-9]", "", s)

    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    ip = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    spans = [(m.start(), 0, "email", m.end()) for m in re.finditer(email, text)]
    spans += [(m.start(), 1, "ip", m.end()) for m in re.finditer(ip, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0])):
            spans.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            spans.append((m.start(), 3, "phone", m.end()))
    return spans


def fingerprint(text):
    words = words_of(low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, prints):
    """Smallest key reachable from each row over links of 3 or fewer bits."""
    prints, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= 3):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(prints))]


def decontaminated(docs, items):
    """{row: (n_words, n_hit, n_items, items_sha256, contaminated)} for rows (key, text)."""
    windows = {}
    for item, text in items:
        words = bare_words(text)
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    out = {}
    for key, text in docs:
        words, hit, found = bare_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= {str(x) for x in windows[w] if x is not None}
        bad = len(hit) > 0 and 20 * len(hit) >= len(words)
        out[key, text] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bad)
    return out


def repeats_removed(docs):
    """{row: (n_words, n_removed, kept_sha256)} for rows (key, text); a null key is the largest."""
    first = {}

    def rank(key):
        return float("inf") if key is None else key

    for key, text in docs:
        words = words_of(text)
        for i in range(len(words) - 12):
            w = tuple(words[i : i + 13])
            first[w] = min(first.get(w, rank(key)), rank(key))
    out = {}
    for key, text in docs:
        words, gone = words_of(text), set()
        for i in range(len(words) - 12):
            if first[tuple(words[i : i + 13])] < rank(key):
                gone |= set(range(i, i + 13))
        out[key, text] = (len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out
