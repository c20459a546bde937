"""Plain versions that the tests compare with."""

import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots(ids, pairs):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def brute(docs):
    """Pairs that share a shingle, counted; docs: id to text, or to several texts."""
    sets = [(i, shingles(t)) for i, t in docs]
    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    common = {}
    for own in by.values():
        for a, b in combinations(own, 2):
            common[a, b] = common.get((a, b), 0) + 1
    pairs = [(sets[a][0], sets[b][0]) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n)]
    return roots({i for i, _ in docs}, pairs), {k: len(s) for k, (_, s) in enumerate(sets)}


def placed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity or len(own) == 1


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def failed_rules(text):
    """The rules of the policy that a text fails, by plain string work."""
    n, chars, symbols, dup, repeat = measures(text)
    text = text or ""
    w = WORD.findall(text)
    letters = sum(c.isalpha() for c in text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    echo = sum(a == b for a, b in zip(w, w[1:]))
    shares = {
        "few_words": n < 20, "repeated_windows": 100 * repeat > 30 * n, "symbols": 100 * symbols > 10 * n, "few_letters": 100 * letters < 60 * chars,
        "word_length": not 2 * n <= chars <= 15 * n, "echoed_words": 100 * echo > 20 * n, "shouting": 100 * text.count("!") > 30 * n, "repeated_lines": 100 * dup > 60 * lines,
    }
    return [name for name, failed in shares.items() if failed]
