"""Plain Python versions of the operators' contracts, and rows with every hard case."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SYLLABLES = ["the", "of", "an", "er", "tion", "é", "ß", "ing", "ou", "re", "st"]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 4))) for _ in range(n))


#: Names that operators use inside, as extra columns of their input.
CLASHES = ["score", "kept", "node", "chunk", "bucket", "key", "runs", "items", "n_words", "copies", "print", "row", "slot", "shard", "size", "blob", "toxic", "lang2", "label", "_hit0", "at", "_row", "_number", "_stays", "_once", "_clean", "_hit", "_mix_id", "_mix_print", "_mix_copies", "_mix_copy", "doc", "hit", "clean", "stays", "once", "number", "print2", "rows"]


def hard_rows():
    base, long = prose(1, 120), prose(2, 6_000)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = prose(3, 40)
    rows = [
        (1, base), (2, None), (3, ""), (4, base), (4, base), (None, prose(4, 30)), (5, long), (6, near), (7, " \n\t "), (8, "One"), (9, "One"), (10, "one two three"),
        (11, prose(5, 50) + "\n" + passage), (12, passage + " " + prose(6, 50)), (12, "other text under the same id " + prose(7, 30)), (None, base), (13, "same line\nsame line\n\nsame line\n"),
        (14, "😀 token=abcdef AKIA" + "Z" * 16 + " " + "0f" * 12 + ' secret: "short" passwd = token: x'), (15, "na " * 400), (16, long + " tail"),
    ]
    return rows


def hard_frame(spark, rows=None, extra=True):
    rows = hard_rows() if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, None if k % 5 == 0 else ["en", "fr"][k % 2], None if k % 7 == 0 else "s", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    frame = spark.createDataFrame(full, schema)
    return frame.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHES]) if extra else frame


def empty_frame(spark):
    return hard_frame(spark, []).limit(0)


def shingles(text, n=4):
    words = WORD.findall(low(text))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def components(rows, percent=85):
    """n_shingles, component and links of each row."""
    sets = [shingles(t) for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None, links[i]))
    return out


def backoff_scores(rows, order=3, alpha=0.4, unseen=0.5):
    texts = [WORD.findall(low(t)) for _, t in rows]
    own = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter({(): len(w)}) for n in range(order + 1)] for w in texts]
    total = [sum((o[n] for o in own), Counter()) for n in range(order + 1)]
    out = []
    for (doc_id, _), w, mine in zip(rows, texts, own, strict=True):
        score = 0.0
        for k in range(len(w)):
            n, factor = min(order, k + 1), 1.0
            while n > 1 and total[n][tuple(w[k - n + 1 : k + 1])] == mine[n][tuple(w[k - n + 1 : k + 1])]:
                n, factor = n - 1, factor * alpha
            gram = tuple(w[k - n + 1 : k + 1])
            count, history = total[n][gram] - mine[n][gram], total[n - 1][gram[:-1]] - mine[n - 1][gram[:-1]]
            score += math.log(factor * (count / history if n > 1 else max(count, unseen) / max(history, 1)))
        out.append((doc_id, len(w), score))
    return out


def removed_bytes(rows, length=50):
    last = 1 << 62
    data = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for j in range(len(b) - length + 1):
            key = b[j : j + length]
            first[key] = min(first.get(key, last + 1), i)
    out = []
    for (doc_id, _), (i, b) in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < i:
                gone[j : j + length] = b"\1" * length
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def benchmark_hits(rows, items, window=10):
    grams = defaultdict(set)
    for item_id, text in items:
        words = BENCH_WORD.findall(low(text))
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            grams[tuple(words[k : k + n])].add(item_id)
    sizes = {len(g) for g in grams}
    out = []
    for doc_id, text in rows:
        words = BENCH_WORD.findall(low(text))
        hit, found = [0] * len(words), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if owners := grams.get(tuple(words[k : k + n])):
                    found |= owners
                    hit[k : k + n] = [1] * n
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(words), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sum(hit) > 0))
    return out


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def base_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = [0] * len(words)
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            marked[i : i + 8] = [1] * 8
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, sum(marked)


def ordered(rows):
    return sorted(rows, key=repr)
