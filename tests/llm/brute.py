"""Plain single-machine versions of the operators, over lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACES = " \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def places(docs):
    """Distinct documents in the order that counts as earlier: doc_id, nulls last."""
    return sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))


def substring_dedup(docs, width=20):
    seen, out = set(), {}
    for doc, text in places(docs):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            if k in seen:
                gone[i:i + width] = [True] * width
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc, text] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def maximal_line_runs(docs, least=6):
    """Numbers of the lines to delete by document: of each line's longest match with an earlier place, all that have ``least`` words."""
    seqs = [[x.strip(SPACES) for x in (text or "").split("\n") if x.strip(SPACES)] for _, text in places(docs)]
    starts, out = defaultdict(list), {}
    for at, (doc, seq) in enumerate(zip(places(docs), seqs)):
        gone = set()
        for i, line in enumerate(seq):
            longest = 0
            for b, j in starts[line]:
                n = 0
                while i + n < len(seq) and j + n < len(seqs[b]) and seq[i + n] == seqs[b][j + n]:
                    n += 1
                longest = max(longest, n)
            if sum(len(words(x)) for x in seq[i:i + longest]) >= least:
                gone |= set(range(i, i + longest))
            starts[line].append((at, i))
        out[doc] = gone
    return out


def line_dedup(docs, least=6):
    """(lines, removed lines, new text) by document: without the lines of ``maximal_line_runs``; blank lines stay."""
    out = {}
    for (doc, text), gone in maximal_line_runs(docs, least).items():
        kept, n = [], 0
        for x in (text or "").split("\n"):
            if not x.strip(SPACES):
                kept.append(x)
                continue
            if n not in gone:
                kept.append(x)
            n += 1
        out[doc, text] = (n, len(gone), "\n".join(kept))
    return out


def fingerprint(text, n=4):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, radius=4):
    """[(doc_id, fingerprint, component_id)] in the order of ``docs``."""
    return _simhash(docs, radius)[0]


def simhash_groups(docs, radius=4):
    return _simhash(docs, radius)[1]


def _simhash(docs, radius):
    fps = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        least[find(i)].append(doc)
    out = [(doc, f"{fps[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (doc, _) in enumerate(docs)]
    return out, len(least)


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    chars, symbols, dup = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    odd = (4 * symbols > len(w) or not 2 * len(w) <= chars <= 20 * len(w) or 2 * text.count("!") > len(w)
           or len(lines) >= 4 and 2 * dup > len(lines) or 10 * sum(c.isupper() for c in text) > 6 * max(chars, 1))
    return (len(w), chars, symbols, dup, len(hit), failed, not failed and not odd)


def check_packing(docs, pieces, window=2048):
    """Every id of every document in exactly one piece, sequences gapless and without padding."""
    tok = tokenizer()
    ids = {(d, len(x)): x for d, x in ((d, tok.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in docs)}
    assert len(ids) == len({d for d in docs}), "texts that share id and length: not for this check"
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        whole = ids[p["doc_id"], p["doc_tokens"]]
        assert p["length"] > 0 and crc(whole[p["start"]:p["start"] + p["length"]]) == p["ids_crc32"]
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    times = Counter(docs)
    for (doc, text), n in times.items():
        size = len(tok.encode(text or "", add_special_tokens=False).ids) + 1
        cover = Counter(i for s, k in by_doc[doc, size] for i in range(s, s + k))
        assert cover == {i: n for i in range(size)}, (doc, n)
    for parts in by_sequence.values():
        end = 0
        for at, k in sorted(parts):
            assert at == end
            end += k
        assert end == window or end < window and end & (end - 1) == 0, end


def trie(rows, block=100, most=6):
    """Nodes (conv_id, depth, parent's conv_id, members, children, leaves, saved, hash of those that end) of (conv_id, turn, role, text) rows."""
    def place(t):
        raw = str(len(t[2].encode())).encode() + b":" + t[2].encode() + t[3].encode()
        return (*t[:2], hashlib.sha256(raw).digest()[:16])

    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            given[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=place)] for c, ts in given.items()}
    members, kids = defaultdict(list), Counter()
    new = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % most
        new[c] = own.get(c - int(math.fmod(c, block)), [])[:h] + own[c][h:]
        for d in range(len(new[c]) + 1):
            members[tuple(new[c][:d])].append(c)
    kids.update(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ms in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    return [(ms[0], len(p), members[p[:-1]][0] if p else None, len(ms), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in ms if len(new[c]) == len(p)).encode()).hexdigest()) for p, ms in members.items()]


def hard_negatives(rows):
    """(anchor, positive, rank, negative, their scores) of (vec_id, vector, label) rows."""
    use, out = [], []
    for v, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        use.append((v, (label + 1) % 10 if v is not None and v % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    for i, (v, label, x) in enumerate(use):
        if v is None or v % 50:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(x, y)), w is None, w or 0, other) for j, (w, other, y) in enumerate(use) if j != i)
        for p in [t for t in ranked if t[3] == label][:5]:
            near = [t for t in ranked if t[3] != label and -50 * p[0] <= -100 * t[0] <= -95 * p[0]][:3]
            out += [(v, None if p[1] else p[2], k, None if n[1] else n[2], -p[0], -n[0]) for k, n in enumerate(near, 1)]
    return out


def best_bins(items, capacity):
    """The least number of bins of ``capacity`` that hold ``items``, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[b] += items[i]
            go(i + 1, bins)
            bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def check_whole_packing(docs, pieces, capacity=4096):
    """Every id of every document in one piece, only longer ones cut, sequences gapless; returns (sequences, lengths)."""
    tok = tokenizer()
    want = Counter()
    for doc, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for i, at in enumerate(range(0, len(ids), capacity)):
            want[doc, i, at, len(ids[at:at + capacity]), crc(ids[at:at + capacity])] += 1
    assert want == Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        end = 0
        for at, k in sorted(parts):
            assert at == end
            end += k
        assert end <= capacity
    return len(by_sequence), [p["length"] for p in pieces]
