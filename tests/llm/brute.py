"""Plain single-process versions of the contracts, to hold the queries against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def substring(docs, window=20):
    """docs: (doc_id, text) with distinct ids -> id: (n_words, n_removed, sha of the kept words)."""
    seen, out = {}, {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        ws = WORD.findall(text or "")
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            else:
                seen[key] = 1
        out[doc] = (len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone) if not g)))
    return out


def simhash(text, k=3):
    ws = WORD.findall((text or "").translate(_LOWER))
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, bits=2):
    """fps: id -> int; id -> smallest id reachable by links of at most ``bits``."""
    by = defaultdict(list)
    for i, f in fps.items():
        by[f].append(i)
    left, out = set(by), {}
    while left:
        front, group = [left.pop()], []
        while front:
            u = front.pop()
            group.append(u)
            near = [v for v in left if (u ^ v).bit_count() <= bits]
            left -= set(near)
            front += near
        ids = [i for f in group for i in by[f]]
        out.update(dict.fromkeys(ids, min(ids)))
    return out


def quality(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(ws) - 4):
        at[tuple(ws[i:i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(ws) < 10 or 100 * len(covered) > 20 * len(ws))


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(_LOWER)


def lines(docs, min_chars=40, min_docs=5):
    """docs: (doc_id, text) with distinct ids -> id: (n_lines, n_dropped, sha)."""
    held = defaultdict(set)
    for doc, text in docs:
        for x in (text or "").split("\n"):
            if len(line_key(x)) >= min_chars:
                held[line_key(x)].add(doc)
    out = {}
    for doc, text in docs:
        own = (text or "").split("\n")
        keep = [x for x in own if len(held.get(line_key(x), ())) < min_docs or max(held[line_key(x)]) == doc]
        out[doc] = (len(own), len(own) - len(keep), sha("\n".join(keep)))
    return out


def chat_cost(roles):
    """Least cost of a legal conversation by trying every choice (short lists)."""
    from pairwright.llm import chat

    def after(state, i):
        if i == len(roles):
            return chat.INSERT * len(chat.closing(state))
        best = float("inf")
        for to in (1, 2, 3):
            cost = 0 if to == roles[i] else chat.UNKNOWN if roles[i] == 0 else chat.RELABEL
            if to == state:
                best = min(best, cost + chat.MERGE + after(to, i + 1))
            for path in ((), (2,), (3,), (2, 3), (3, 2)):
                at, legal = state, True
                for r in (*path, to):
                    legal, at = legal and (at, r) in {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}, r
                if legal:
                    best = min(best, cost + chat.INSERT * len(path) + after(to, i + 1))
        return best
    return after(0, 0)


def packing_cost(hist, ups):
    return sum(n * (min(u for u in ups if u >= length) - length) for length, n in hist)


def pair_tally(values):
    return Counter(values)


def repeated_tail(doc_id, words: list[bytes]) -> list[bytes]:
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by definition: each period from 1 on, smallest ones first."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i + q - s
            if i > s and n >= max(6, 4 * q) and not any(words[s:s + n - r] == words[s + r:s + n] for r in range(1, q)):
                out.append((s, n, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(doc_id, text):
    ws = repeated_tail(doc_id, (text or "").encode().split())
    found = runs(ws)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))


def rebuilt(rows):
    """rows: (conv_id, turn, role, text) -> conv_id: list of (role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(t)] for c, t in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def prefix_trie(convs):
    """conv_id: turns -> {(conv_id, depth): the other columns of a node}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out, leaves, saved = {}, {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
        out[members[k][0], len(k)] = (members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], sha(",".join(map(str, ends[k]))))
    return out
