"""Plain Python versions of the operators, and odd rows for all of them."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import xxhash

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _id long, size string, tag string, t string, shard int, "
    "print string, word string, copies string, curve string, held string, _c0 string, _t string, _name string, n int"
)
WORDS = "the of and in on re tion ing er th st en que de la el der die und le les des une est".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def odd_rows(seed: int = 3) -> list[tuple]:
    """Nulls in every column, blank, short, long and repeated texts, equal ids, shared lines and near copies."""
    rng = random.Random(seed)
    base = [sentence(rng, 30) for _ in range(6)]
    line = "This very line is found in many of the documents here."
    rows = [
        (None, base[0], "en", "a"), (None, None, None, None), (1, None, "en", "b"), (2, "", "de", None), (3, " \n\t ", None, "b"),
        (4, "\n".join(sentence(rng, 40) for _ in range(900)), "fr", "a"), (5, base[1], "en", "c"), (5, base[1], "en", "c"),
        (6, base[1], "en", "c"), (7, base[1] + " Zuletzt.", "en", "c"), (8, "Élan", "fr", "d"), (9, "1 2 3 !?", "en", "d"),
        (10, base[2] + "\n" + line, "es", "a"), (11, base[3] + "\n  " + line.upper() + " \n" + base[4], "es", "a"),
        (12, line, "es", "a"), (13, line + "\n" + line, "es", "a"), (14, line + "\n" + base[5], "es", ""), (15, base[2] + base[5], "es", "a"),
        (5, base[4], "en", "c"), (2**62, base[0], "en", "e"), (-7, "a b", "en", "e"), (16, "x" * 5000, "en", "a"), (17, "x" * 4999, "en", "a"),
    ]
    extra = (1, "9", "b", "c", 3, "p", "w", "2", "k", "yes", "z", "tt", "nn", 4)
    return [(d, t, lang, s, None if t is None else len(t), *extra) for d, t, lang, s in rows]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def table(spark, folder: str, name: str) -> list:
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


def fold_of(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def lines_left(rows: list[tuple], min_chars: int = 40, min_docs: int = 5) -> list[tuple]:
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip("\t\n\x0b\x0c\r "))
    low = lambda d: -math.inf if d is None else d
    holders: dict[str, set] = {}
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(low(doc))
    result = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        stay = [x for x in parts if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == low(doc)]
        result.append((doc, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return result


def base_scores(rows: list[tuple]) -> list[tuple]:
    counts: Counter = Counter()
    for doc, text in rows:
        if fold_of(doc) % 7 != 2:
            counts.update(words(text) + [b""])
    total, kinds = sum(counts.values()), len(counts)
    result = []
    for doc, text in rows:
        tokens = words(text) + [b""]
        score = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        result.append((doc, fold_of(doc) % 7 == 2, len(tokens), sum(w in counts for w in tokens), total, score))
    return result


def targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        got = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and got[s] > 3 * sizes[s]}
        if not over:
            return got
        capped |= over


def fingerprint(text: str | None) -> int:
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes: list, links: list[tuple]) -> dict:
    """The least node reachable from each."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def repeats_cut(rows: list[tuple], length: int = 50) -> list[tuple]:
    low = lambda d: -math.inf if d is None else d
    first: dict[bytes, float] = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            first[piece] = min(first.get(piece, math.inf), low(doc))
    result = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < low(doc):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        result.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return result
