"""Plain versions of what the operators compute, and small tables to run them on."""

import collections
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENT = "doc_id long, text string, source string"


def table(spark, rows, schema=DOCUMENT):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """The same table with columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in ("row", "group", "key", "mark", "size", "n", "word", "term", "pos", "copies", "target", "shard", "slot",
                 "_block", "_v", "_rank", "path", "host", "rule", "score", "kept", "item", "line", "site", "_keep_text"):
        df = df.withColumn(name, F.lit("x"))
    return df


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def shingle_set(text):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def near_duplicates(docs):
    """doc_id -> (set size, smallest linked doc_id), comparing all pairs; ids are unique."""
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    a_root, b_root = sorted((find(a), find(b)))
                    root[b_root] = a_root
    return {d: (len(s), find(d)) for d, s in sets.items()}


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def contamination(docs, items):
    """doc_id -> (n_words, n_hit, sorted item ids as strings)."""
    windows = collections.defaultdict(set)
    for item, text in items:
        words = benchmark_words(text)
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[i:i + n])].add(str(item))
    lengths = {len(w) for w in windows}
    found = {}
    for d, text in docs:
        words, hit, names = benchmark_words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i:i + n]))
                if own:
                    hit.update(range(i, i + n))
                    names |= own
        found[d] = (len(words), len(hit), sorted(names))
    return found


def mix(docs, weights=(3, 1, 2), seed="mix-1", buckets=64):
    """doc_id -> copies, targets by resharing the excess again and again."""
    import hashlib

    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    groups = collections.defaultdict(list)
    for d, _, source in docs:
        groups[source].append(d)
    order = sorted(groups, key=lambda s: (s is None, s))
    total = {s: sum(size[d] for d in groups[s]) for s in order}
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * total[s]]
        if not full:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in full:
            target[s] = 2 * total[s]
            left -= target[s]
            open_.remove(s)
    copies = {}
    for s in order:
        rate = math.floor(target[s] / total[s] * (1 << 24) + 1e-6) if total[s] else 0
        key = "" if s is None else "=" + s
        at = int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:6], 16)

        def place(d):
            n = size[d].bit_length() or 1
            bucket = int(hashlib.md5(str(d).encode()).hexdigest()[:6], 16) % buckets
            return n * 8 + (size[d] >> max(n - 4, 0) & 7), bucket, size[d], d

        for d in sorted(groups[s], key=place):
            copies[d] = (at + rate >> 24) - (at >> 24)
            at += rate
    return copies, target, total, size
