"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import regex


def words(text):
    return (text or "").encode().split()


def quality(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_dup = len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), n_dup, len(covered), failed


def passages(rows, window=50):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        cut = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                cut[i : i + window] = [True] * window
        out.append((d, len(w), sum(cut), hashlib.sha256(b" ".join(x for x, c in zip(w, cut, strict=True) if not c)).hexdigest()))
    return sorted(out)


def substrings(rows, window=100):
    """rows in the order of their ids, each id once."""
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if b[i : i + window] in seen:
                cut[i : i + window] = True
            seen.add(b[i : i + window])
        runs = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        out.append((d, len(b), int(cut.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~cut].tobytes()).hexdigest()))
    return out


def shingles(text, k=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def jaccard_components(rows, k=3, percent=90):
    sets = {d: shingles(t, k) for d, t in rows}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = collections.Counter(e for x in s for e in holders[x] if e < d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, s in sets.items())


def plain_words(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def contained(rows, items, percent=80):
    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out, words_of = [], {d: plain_words(t) for d, t in rows}
    sets = {(d, k): grams(w, k) for d, w in words_of.items() for k in range(1, 6)}
    for item, text in items:
        w = plain_words(text)
        if not w:
            continue
        k = min(5, len(w))
        wanted = grams(w, k)
        for d in words_of:
            n = len(wanted & sets[d, k])
            if n and 100 * n >= percent * len(wanted):
                out.append((d, item, n, len(wanted)))
    return sorted(out)


def water(budget, children):
    """children: {name: (capacity, weight)}; filled step by step."""
    got = dict.fromkeys(children, 0.0)
    open_ = {k for k, (c, w) in children.items() if w > 0 and c > 0}
    left = min(budget, sum(c for c, w in children.values() if w > 0))
    while open_ and left > 1e-9:
        total = sum(children[k][1] for k in open_)
        step = min([left / total] + [(children[k][0] - got[k]) / children[k][1] for k in open_])
        for k in open_:
            got[k] += step * children[k][1]
        left -= step * total
        open_ = {k for k in open_ if children[k][0] - got[k] > 1e-9}
    return {k: int(v + 1e-6) for k, v in got.items()}


def entities(text, alternatives, initials, particles):
    """(begin, end, kind, units) of every entity of a text, tried place by place; units are (kind, word) of a name."""
    after_one = [(kind, regex.compile(p.replace(r"(?:(?<![\p{L}\p{N}])|\G)", ""))) for kind, p in alternatives]
    else_where = [(kind, regex.compile(p.replace(r"|\G)", ")"))) for kind, p in alternatives]
    found, at, last = [], 0, 0
    while at < len(text):
        for kind, p in after_one if at == last else else_where:
            m = p.match(text, at)
            if m:
                found.append((at, m.end(), kind))
                last = at = m.end()
                break
        else:
            at += 1
    out, names = [], {}
    for b, e, kind in found:
        if kind not in ("woman", "man"):
            out.append((b, e, {"hex": "secret", "ipv6": "ip"}.get(kind, kind), [({"ipv6": "ip"}.get(kind, kind), text[b:e])]))
            continue
        units, parts = [], regex.split(r"[ \u00a0]", text[b:e])
        for i, part in enumerate(x for x in parts):
            for w in part.split("-"):
                k = "initials" if regex.fullmatch(initials, w) else "particle" if regex.fullmatch(particles, w) else "family" if i == len(parts) - 1 else f"given {kind}"
                units.append((k, w))
                if k[0] in "fg":
                    names.setdefault(w, k)
        out.append((b, e, kind, units))
    if names:
        word = regex.compile(r"(?<![\p{L}\p{M}\p{N}\'’])(?:" + "|".join(sorted(names, reverse=True)) + r")(?![\p{L}\p{M}\p{N}])")
        edges = [0, *[x for b, e, *_ in out for x in (b, e)], len(text)]
        for b, e in zip(edges[::2], edges[1::2], strict=True):
            out += [(b + m.start(), b + m.end(), "name", [(names[m[0]], m[0])]) for m in word.finditer(text[b:e])]
    return sorted(out)
