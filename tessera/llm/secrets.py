"""Secret scanning with a password guess-cost dynamic programme.

Three fixed patterns give the base spans. Values in other credential contexts
("pwd is", "login:", "bearer") are then judged by how many guesses an attacker
would need: the cheapest segmentation of the value into dictionary words, dates,
repeats, keyboard walks and brute-force stretches, found by dynamic programming
over its positions. The dictionary is counted over the corpus itself. Values that
would be guessed cheaply are placeholders or prose and are left alone.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import written

# Fixed patterns of the base kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so no shorter run can hide a longer one
_CONTEXT = re.compile(
    r"""(?<![a-z0-9])(?:pwd|pass(?:phrase|code|word|wd)?|secret|token|api_?key|access_?key|private_?key|credentials?|auth|bearer|login|pin)(?![a-z0-9])["']?\x20{0,3}(?:[:=]|\bis\b|=>|\x20)\x20{0,3}["']?(?=([^\s"'<>,;]{6}))""",
    re.IGNORECASE | re.ASCII,
)
_END = re.compile(r"""[\s"'<>,;]|\Z""", re.ASCII)
# Parts of the keys above in lower case; a text without any cannot match.
_KEYS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "auth", "bearer", "login", "pin")
#: A value in credential context counts as a secret from 10^GUESSES guesses on.
GUESSES = 9.0
#: The dictionary holds so many words of the corpus, the most frequent ones, of 3 to LONGEST letters.
WORDS, LONGEST = 20_000, 20
# Words that stand for a secret or are bad ones; they come before the corpus's words in the dictionary.
_ALWAYS = """password passwd passphrase pass secret token key login user admin root guest master welcome default changeme letmein test example
sample dummy placeholder redacted hidden unknown undefined required none null true false value string insert your here enter access
qwerty monkey dragon sunshine princess football""".split()
_LEET = str.maketrans("4@310$57!", "aaeiosstl"[:9])
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_SPOT = {c: (r, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_YEAR = re.compile(r"(?:19|20)\d\d")
_DATE = re.compile(r"\d{1,4}([-/._]?)\d{1,2}\1\d{1,4}")


def _near(a: str, b: str) -> bool:
    p, q = _SPOT.get(a), _SPOT.get(b)
    return p is not None and q is not None and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 and p != q


def dictionary(words: list[str]) -> dict[str, int]:
    """Ranks from 1 of the words that always count and then of ``words``, most frequent first."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*_ALWAYS, *words]))}


_SMALL = dictionary([])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[str] = Counter()
        for t in batch.column(0).to_pylist():
            seen.update(t.split())
        # Only tokens that are letters throughout: keys and passwords mostly are not.
        merged: Counter[str] = Counter()
        for w, n in seen.items():
            w = w.strip(".,;:!?\"'()").lower()
            if 3 <= len(w) <= LONGEST and w.isalpha():
                merged[w] += n
        yield pa.record_batch([pa.array(list(merged), pa.string()), pa.array(list(merged.values()), pa.int64())], names=["word", "n"])


def common_words(docs: DataFrame, size: int = WORDS) -> list[str]:
    """The ``size`` most frequent words of all texts, most frequent first, ties by the word."""
    counted = docs.where("text is not null").select(F.col("text").cast("string")).mapInArrow(_count, "word string, n long")
    counted = written(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Bins of counts, a thousand at most, tell from which count on there are enough words; only these are sorted.
    bin_ = F.floor(16 * F.log2("n")).cast("int")
    bins, enough, least = counted.groupBy(bin_.alias("bin")).agg(F.count("*").alias("c")).collect(), 0, 0
    for r in sorted(bins, reverse=True):
        enough, least = enough + r["c"], r["bin"]
        if enough >= size:
            break
    top = written(counted.where(bin_ >= least).orderBy(F.desc("n"), "word").limit(size), "top")
    return [r["word"] for r in top.orderBy(F.desc("n"), "word").collect()]  # ``size`` words at most


def guess_cost(value: str, ranks: dict[str, int] = _SMALL) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes; 0 for an empty value.

    Segments cost their own guesses and one more factor each for the choice
    and order of kinds, so that many short ones are not a bargain.
    """
    low, n = value.lower(), len(value)
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    alphabet = sum(size for size, has in ((26, any("a" <= c <= "z" for c in value)), (26, any("A" <= c <= "Z" for c in value)), (10, any("0" <= c <= "9" for c in value)), (33, any(not c.isalnum() for c in value))) if has) or 26
    # What one character of brute force takes, and what starting a segment takes.
    letter, start = math.log10(alphabet), math.log10(4)
    walk = [1] * n  # length of the keyboard walk that ends here
    same = [1] * n  # of the repeat of one character
    for i in range(1, n):
        if _near(low[i - 1], low[i]):
            walk[i] = walk[i - 1] + 1
        if low[i] == low[i - 1]:
            same[i] = same[i - 1] + 1
    brute = [0.0] + [math.inf] * n  # cheapest with a brute-force stretch that ends here
    held = np.zeros(n + 1)  # best, for long slices
    logs = np.log10(np.arange(1, n + 2))
    repeats = _repeats(low[:n])
    for e in range(1, n + 1):
        brute[e] = min(brute[e - 1] if e > 1 else math.inf, best[e - 1] + start) + letter
        cost = brute[e]
        for size in range(3, min(LONGEST, e) + 1):
            s = e - size
            for text, extra in ((low[s:e], 0.0), (plain[s:e], 0.5)):
                rank = ranks.get(text)
                if rank:
                    upper = 0.3 if value[s:e] != low[s:e] else 0.0
                    cost = min(cost, best[s] + start + math.log10(rank + 1) + extra + upper)
        # Sizes count down from the longest, as the slices of ``held`` count up.
        if (w := walk[e - 1]) >= 3:
            cost = min(cost, float((held[e - w : e - 2] + start + math.log10(160) + logs[2:w][::-1]).min()))
        if (w := same[e - 1]) >= 2:
            cost = min(cost, float((held[e - w : e - 1] + start + letter + logs[1:w][::-1]).min()))
        if e >= 4 and _YEAR.fullmatch(value, e - 4, e):
            cost = min(cost, best[e - 4] + start + math.log10(120))
        for size in (6, 8, 10):
            if e >= size and _DATE.fullmatch(value, e - size, e):
                cost = min(cost, best[e - size] + start + math.log10(120 * 366))
        # A stretch that repeats what stands right before it.
        for sizes in next(repeats):
            cost = min(cost, float(held[e - sizes].min()) + start + 0.3)
        best[e] = held[e] = cost
    return best[n]


def _repeats(low: str) -> Iterator[list[np.ndarray]]:
    """For each end e = 1, 2, ...: arrays of all sizes for which low[e - size : e] repeats what stands right before it.

    Lengths of agreement with the text ``size`` before are carried on from end
    to end. Sizes below 16 are all followed; larger ones agree in their last 16
    characters at least, so only earlier places of these are looked at.
    """
    n, k = len(low), 16
    runs = [0] * k
    long = n >= 2 * k
    if long:
        ids = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        for width in (1, 2, 4, 8):  # ids of equal stretches of twice the width
            ids = np.unique(ids[:-width] * (int(ids.max()) + 1) + ids[width:], return_inverse=True)[1].astype(np.int64)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        first = np.searchsorted(ids[order], ids)
        since, last = np.zeros(n, np.int64), np.full(n, -1)  # by size: where agreement began, and the last end with it
    for e in range(1, n + 1):
        found = []
        for size in range(1, min(k, e)):
            runs[size] = runs[size] + 1 if low[e - 1] == low[e - 1 - size] else 0
        small = [size for size in range(2, min(k, e)) if runs[size] >= size]
        if small:
            found.append(np.array(small))
        if long and e >= k and first[e - k] < rank[e - k]:
            i = e - k
            sizes = i - order[first[i] : rank[i]]
            sizes = sizes[sizes >= k]
            since[sizes[last[sizes] != e - 1]] = i
            last[sizes] = e
            sizes = sizes[e - since[sizes] >= sizes]
            if len(sizes):
                found.append(sizes)
        yield found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the three fixed patterns, by start, then kind as listed."""
    low = text.lower()
    spans = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(spans, key=lambda s: (s[0], order[s[2]]))


def guessed_spans(text: str, base: list[tuple[int, int, str]], guesses: float = GUESSES, ranks: dict[str, int] = _SMALL) -> list[tuple[int, int, str]]:
    """Values in credential context that take at least 10^guesses guesses and begin in no base span; whole, even if a base span lies further on in them."""
    low = text.lower()
    if not any(k in low for k in _KEYS):
        return []
    begins, ends = [b for b, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    found, at, stop = [], 0, -1
    while m := _CONTEXT.search(text, at):
        s = at = m.start(1)  # a rejected value may hold the next keyword
        if stop < s:
            stop = _END.search(text, s).start()
        value = text[s:stop].rstrip(".)]}!?:")
        e = s + len(value)
        separated = m.group(0)[: s - m.start()].rstrip("\"' ")[-1:] in ("=", ":", ">")
        # Without a separator the value must look unlike a word: two kinds of characters at least.
        kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value[1:]), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))
        before = bisect_right(begins, s)
        if len(value) < 6 or kinds < (2 if separated else 3) or (before and ends[before - 1] > s):
            continue
        if guess_cost(value, ranks) >= guesses:
            found.append((s, e, "guess"))
            at = stop
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan(guesses: float, ranks: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            bases, alls, costs = [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                more = guessed_spans(text, base, guesses, ranks)
                for c, kind in zip(counts, ("assign", "access", "hex", "guess"), strict=True):
                    c.append(sum(s[2] == kind for s in (more if kind == "guess" else base)))
                bases.append(joined(base))
                alls.append(joined(sorted(base + more, key=lambda s: (s[0], ("assign", "access", "hex", "guess").index(s[2])))))
                costs.append(max((guess_cost(text[s:e], ranks) for s, e, _ in base + more), default=None))
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()), pa.array(alls, pa.string()), pa.array(costs, pa.float64())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base", "spans", "top_log10_guesses"])

    return run


def scan_secrets(docs: DataFrame, guesses: float = GUESSES, words: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts by kind, base and all spans, and the hardest span's log10 guesses.

    Spans are kind:start:end in code points, end exclusive, comma-joined by
    start. Null and empty texts have none (top_log10_guesses null). Repeated
    rows repeat; other columns are ignored; an empty table gives no rows. Spans
    and their costs are of whole values, however long. ``words`` is the
    dictionary, most frequent first (default: ``common_words`` of ``docs``).
    """
    ranks = dictionary(common_words(docs) if words is None else words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(guesses, ranks), f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_guess long, base string, spans string, top_log10_guesses double")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """scan_secrets with base_sha256 in place of the base spans; nulls, repeated rows and empty tables as there."""
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_guess", "top_log10_guesses")
