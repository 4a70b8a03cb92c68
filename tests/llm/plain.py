"""Plain Python versions of the operators' rules, over rows in memory."""

import base64
import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, width=5):
    found = words(lowered(text))
    return {tuple(found[k:k + width]) for k in range(max(1, len(found) - width + 1))} if found else set()


def base_measures(text):
    found = words(text)
    triples = collections.Counter(tuple(found[k:k + 3]) for k in range(len(found) - 2))
    inside = {k + j for k in range(len(found) - 2) if triples[tuple(found[k:k + 3])] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return (len(found), sum(map(len, found)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(inside), len(found) < 50 or 100 * len(inside) > 50 * len(found))


def repeated_share(text, width):
    """Share of the characters that lie in n-grams seen before."""
    found, seen, inside = words(text), set(), set()
    for k in range(len(found) - width + 1):
        gram = tuple(found[k:k + width])
        if gram in seen:
            inside |= set(range(k, k + width))
        seen.add(gram)
    return sum(len(found[k]) for k in inside) / max(1, sum(map(len, found)))


def too_repetitive(text):
    found = words(text)
    seen, chars = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            chars += sum(map(len, words(line))) if line in seen else 0
            seen.add(line)
    total = sum(map(len, found))
    limits = {5: 0.15, 7: 0.13, 10: 0.10}
    return any(len(found) > n and repeated_share(text, n) > limit for n, limit in limits.items()) or total > 0 and chars / total > 0.2


def kept(text):
    return not (base_measures(text)[5] or too_repetitive(text) or sum(text.count(c) for c in "#*$%&|<>") > 0.1 * len(words(text)))


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


def near_copies(rows):
    """Components of (id, text) rows, all pairs compared."""
    sets = [(i, shingles(t)) for i, t in rows]
    links = []
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if i == j or x and y and 100 * len(x & y) >= 75 * len(x | y):
                links.append((i, j))
    return components([i for i, _ in rows], links)


def targets(sizes, weights=(1, 2, 3), repeats=3):
    """Round by round, as the rule says: share by weight, cut what is above, share again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, full = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set()
    while left > 1e-9 and len(full) < len(names):
        share = left / sum(weight[s] for s in names if s not in full)
        left = 0.0
        for s in [s for s in names if s not in full]:
            target[s] += share * weight[s]
        for s in [s for s in names if s not in full]:
            if target[s] >= repeats * sizes[s]:
                left += target[s] - repeats * sizes[s]
                target[s] = repeats * sizes[s]
                full.add(s)
    return target


def judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lowered(re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest).group()):]).group()
    fits = [(h.count("."), len(p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def near_vectors(vectors, least=0.95):
    """Links and components of (id, vector) rows, all pairs compared."""
    good = []
    for k, (_, v) in enumerate(vectors):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((k, np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))))
    links = [(a, b) for n, (a, x) in enumerate(good) for b, y in good[:n] if len(x) == len(y) and (x * y).sum() >= least]
    return links


def vector_codes(rows, largest, parts=4, entries=256, rounds=4):
    """Every part compared to every entry in every round; rows are (id, vector, label)."""
    good = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return []
    each = -(-max(len(v) for _, v, _ in good) // parts)
    most = largest(each * parts)

    def whole(v):
        return [int(max(-most, min(most, math.floor(1024 * float(np.float32(x)))))) for x in v] + [0] * (each * parts - len(v))

    good = sorted(((i, whole(v), label) for i, v, label in good), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = np.array([v for _, v, _ in good], dtype=np.int64).reshape(len(good), parts, each)
    books = [vectors[:entries, p].copy() for p in range(parts)]

    def nearest(p):
        distances = np.array([((vectors[:, p] - e) ** 2).sum(axis=1) for e in books[p]])
        return distances.argmin(axis=0), distances.min(axis=0)

    for _ in range(rounds):
        for p in range(parts):
            own = nearest(p)[0]
            for e in range(len(books[p])):
                if (own == e).any():
                    books[p][e] = vectors[own == e, p].sum(axis=0) // (own == e).sum()
    last = [nearest(p) for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    errors = sum(d for _, d in last)
    by_label = collections.Counter()
    for (_, _, label), e in zip(good, errors):
        by_label[label] += int(e)
    return [(i, "".join(f"{own[k]:02x}" for own, _ in last), int(errors[k]), by_label[label], sha) for k, (i, _, label) in enumerate(good)]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def ranked_search(docs, items, best=50):
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(scores, key=lambda s: s[:3])[:best])]
    return out


def chat_text(turns):
    def safe(x):
        return re.sub(r"([<\[])", r"\1\\", x or "")
    return "".join(f"<|im_start|>{safe(role)}<|im_sep|>{safe(text)}<|im_end|>" for role, text in turns)


def chats(rows):
    """Digests of conversations (conv, turn, role, text), from the rows themselves."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        # Turns of one number stand in any order that does not depend on their places: here by the digest the operator states.
        own.sort(key=lambda r: (r[1] is None, r[1] or 0, turn_digest(r[2], r[3])))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(chat_text(turns))))
    return out


def turn_digest(role, text):
    return hashlib.sha256(json.dumps({k: v for k, v in (("role", role), ("text", text)) if v is not None}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:24]


def reply_paths(rows, best):
    """(tree, formatted) of the best root-to-leaf paths, by walking down from every root."""
    out = []
    for tree in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == tree]
        names = {r[1] for r in own if r[1] is not None}
        below = collections.defaultdict(list)
        for r in own:
            below[r[2] if r[2] in names and r[2] != r[1] else None].append(r)
        paths = []

        def walk(path):
            last = path[-1]
            found = below[last[1]] if last[1] is not None else []
            if not found:
                paths.append(path)
            for r in found:
                walk([*path, r])

        for r in below[None]:
            walk([r])
        paths.sort(key=lambda p: (-sum(r[5] or 0 for r in p), -len(p), json.dumps(p[-1][1] if p[-1][1] is None else f"={p[-1][1]}")))
        out += [(tree, chat_text([(r[3], r[4]) for r in p])) for p in paths[:best]]
    return out


def most_runs(lengths: int, capacity: int) -> int:
    """A bound for the runs of a plan: 47,104 for 2,048 lengths.

    Filling a gap as far as it goes leaves less than half of it, so a run of gaps is filled at most as often as
    its gap has bits.  A length adds two runs at most, by opening or by splitting, and one fill besides.
    """
    return lengths * (2 * (capacity - 1).bit_length() + 1)


def plan_places(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank, n, sequence, each, offset) that place ``counts`` pieces of each length.

    The ``n`` pieces of the length from ``rank`` on go to the sequences from ``sequence`` on,
    ``each`` of them to one, from ``offset`` on.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = collections.defaultdict(list)   # gap: runs (first sequence, how many)
    opened = 0

    def fill(length: int, rank: int, gap: int, first: int, many: int, each: int) -> int:
        """Put ``each`` pieces into ``many`` sequences with this gap; the next rank."""
        if many and each:
            runs.append((length, rank, many * each, first, each, capacity - gap))
            if gap > each * length:
                gaps[gap - each * length].append((first, many))
        return rank + many * each

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        for gap in sorted(g for g in gaps if g >= length):
            each, waiting = gap // length, gaps.pop(gap)
            while rank < n and waiting:
                first, many = waiting.pop()
                whole = min(many, (n - rank) // each)
                rank = fill(length, rank, gap, first, whole, each)
                first, many = first + whole, many - whole
                if many and rank < n:                      # fewer pieces than one more sequence would take
                    rank = fill(length, rank, gap, first, 1, n - rank)
                    first, many = first + 1, many - 1
                if many:
                    waiting.append((first, many))
            if waiting:
                gaps[gap] = waiting
            if rank == n:
                break
        each = capacity // length
        whole = (n - rank) // each
        rank = fill(length, rank, capacity, opened, whole, each)
        opened += whole
        if rank < n:
            fill(length, rank, capacity, opened, 1, n - rank)
            opened += 1
    return runs
