"""A small corpus with copies, edits, shared passages and odd rows, and plain versions of what operators compute."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, sig string"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(rng, n):
    return ["".join(rng.choice(("ka", "lo", "mi", "ré", "tu", "sa", "ño", "be")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def edited(rng, text, times):
    w = text.split(" ")
    for _ in range(times):
        w[rng.randrange(len(w))] = "changed" + str(rng.randrange(1000))
    return " ".join(w)


def documents(seed=1, n=60):
    """Rows of SCHEMA: columns `key`, `h` and `sig` bear names that operators use inside."""
    rng = random.Random(seed)
    texts = []
    passage = " ".join(words(rng, 70))
    base = " ".join(words(rng, 120))
    for k in range(n):
        kind = k % 10
        text = "\n".join(" ".join(words(rng, rng.randint(5, 30))) for _ in range(rng.randint(1, 6)))
        if kind == 1:
            text = edited(rng, base, rng.randint(0, 3))
        elif kind == 2 and texts:
            text = texts[rng.randrange(len(texts))]
        elif kind == 3:
            text = text + " " + passage + " " + " ".join(words(rng, 8))
        elif kind == 4:
            text = " ".join(["ha"] * rng.randint(1, 90))
        elif kind == 5:
            text = " ".join(words(rng, rng.randint(1, 14)))
        texts.append(text)
    texts += ["", "   \n ", None, "One", "12 34", "a b c d e f g h i j k l m", "x" * 5000, "ab ba " * 40 + "\n" + "ab ba " * 40]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), "k", "h", "sig") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, base, "en", None, None, None, None, None)]


def plain(rows):
    """doc_id -> text of the rows that have an id."""
    return {r[0]: r[1] or "" for r in rows if r[0] is not None}


class Sets:
    """Union-find with the smallest member as root."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a
