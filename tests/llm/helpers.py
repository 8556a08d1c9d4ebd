"""Small tables with everything awkward, and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, _note map<string,string>"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(seed=1, n=60):
    """Copies, near copies, nulls, empty, blank, very long, tied and non-ASCII rows; ``size`` and ``shard`` clash by name."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(5, 120)) for _ in range(n)]
    for i in range(0, n, 6):
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
        texts.append(texts[i])
    texts += [None, "", "   \n\t ", "one", "One", "two words", "TWO WORDS", "é ü x y", sentence(rng, 30_000), "a " * 50, "\x00 nul", "line\n\nline\nline"]
    rows = []
    for i, t in enumerate(texts):
        source = None if i % 11 == 3 else "hot" if i % 3 == 0 else f"s{i % 4}"
        rows.append((i, t, None if i % 9 == 2 else "en", source, None if i % 7 == 1 else len(t or ""), "clash", "clash", {"k": "v"}))
    rows.append(rows[5])
    return rows


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(nodes, linked):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
