"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def substrings(docs, window):
    """{(id, text): (n_words, n_removed, sha)} of distinct (id, text) pairs."""
    low = -(1 << 63)
    order = sorted({(low if i is None else i, hashlib.md5((t or "").encode()).digest(), i, t or "") for i, t in docs}, key=lambda x: x[:2])
    seen, out = set(), {}
    for _, _, i, text in order:
        w = WORD.findall(text)
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(x)
        out[i, text] = len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())
    return out


def suffixes(docs, length):
    texts = {(i, t or "") for i, t in docs}
    count = Counter(b[k : k + length] for _, t in texts for b in [t.encode()] for k in range(len(b) - length + 1))
    out = {}
    for i, t in texts:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out[i, t] = len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), sha(bytes(x for x, g in zip(b, gone) if not g))
    return out


def shingle_set(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def near(docs):
    """{(id, set): (class_id, n_links)} of distinct (id, set) pairs."""
    low = -(1 << 63)
    rows = sorted({(low if i is None else i, shingle_set(t)) for i, t in docs}, key=lambda x: x[0])
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    name = lambda i: None if i == low else i
    return {(name(i), s): (name(rows[find(k)][0]), links[k]) for k, (i, s) in enumerate(rows)}


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def lines(docs, min_docs, lead=3, constant=0.8, similar=0.6, most=0.5):
    """{(id, text): kept text} of distinct (id, text) pairs."""
    mask = lambda t: "<*>" if re.search("[0-9]", t) else t
    keyed = {(i, t or "") for i, t in docs}
    leaf_docs, found = defaultdict(set), []
    for d in keyed:
        for at, line in enumerate(d[1].split("\n")):
            tokens = tuple(mask(t) for t in WORD.findall(line))
            if len(tokens) > lead or any(t != "<*>" for t in tokens):
                leaf = len(tokens), tokens[:lead]
                leaf_docs[leaf].add(d)
                found.append((d, at, leaf, tokens))
    found = [x for x in found if len(leaf_docs[x[2]]) >= min_docs]
    spots = defaultdict(Counter)
    for _, _, leaf, tokens in found:
        for i, t in enumerate(tokens):
            spots[leaf, i][t] += 1

    def top(c):
        n, t = max((n, t.encode()) for t, n in c.items())
        return t.decode() if n >= constant * sum(c.values()) else "<*>"

    def equal(tokens, template):
        return sum(a == b != "<*>" for a, b in zip(tokens, template))

    def near(tokens, template):
        rest = equal(tokens[lead:], template[lead:])
        return (rest >= similar * (len(tokens) - lead) or (tokens == template and rest > 0)) and equal(tokens, template) >= similar * len(tokens)

    main = {x: top(c) for x, c in spots.items()}
    main = {leaf: tuple(main[leaf, i] for i in range(leaf[0])) for leaf in {x[2] for x in found}}
    hits = defaultdict(list)
    for d, at, leaf, tokens in found:
        if len(tokens) <= lead or (equal(tokens, main[leaf]) >= similar * len(tokens) and equal(tokens[lead:], main[leaf][lead:]) > 0):
            hits[leaf, main[leaf]].append((d, at, len(tokens)))
    # further templates: what recurs at its position, of lines that are similar to it
    own, docs_of, lines_of = {}, defaultdict(set), Counter()
    for d, at, leaf, tokens in found:
        if len(tokens) > lead:
            p = tuple(t if i < lead or (t != "<*>" and spots[leaf, i][t] >= min_docs) else "<*>" for i, t in enumerate(tokens))
            if any(t != "<*>" for t in p[lead:]) and near(tokens, p):
                own[leaf, tokens] = p
                docs_of[leaf, p].add(d)
                lines_of[leaf, p] += 1
    further = defaultdict(list)
    for (leaf, p), n in lines_of.items():
        if n >= min_docs and len(docs_of[leaf, p]) >= min_docs:
            further[leaf].append(p)
    drop = defaultdict(dict)
    for (leaf, _), rows in hits.items():
        if len({d for d, _, _ in rows}) >= min_docs:
            for d, at, n in rows:
                drop[d][at] = n
    for d, at, leaf, tokens in found:
        if any(near(tokens, p) for p in further[leaf]):
            drop[d][at] = len(tokens)
    out = {}
    for d in keyed:
        whole = sum(drop[d].values()) > most * len(WORD.findall(d[1]))
        out[d] = d[1] if whole else "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in drop[d])
    return out


def shared_out(budget, children):
    """Budgets of children {name: (weight, cap)} by repeated division."""
    got, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        share = {n: (budget * w / total if total else 0.0) for n, (w, _) in open_.items()}
        full = [n for n, (_, cap) in open_.items() if cap <= share[n]]
        if not full:
            return got | share
        for n in full:
            got[n] = float(open_.pop(n)[1])
            budget -= got[n]
    return got
