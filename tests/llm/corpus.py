"""Small tables for the tests of the text operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def vocabulary(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def edited(rng, text, share, words):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in text.split(" "))


def near_copies(seed=1, n=60):
    """(doc_id, text): plain texts, copies, near copies, a shared passage, odd ones, a null, a repeated row."""
    rng = random.Random(seed)
    words = vocabulary(rng, 400)
    passage = sentence(rng, 45, words)
    texts = []
    for k in range(n):
        kind = k % 6
        if kind == 0 or len(texts) < 4:
            texts.append(sentence(rng, rng.choice([1, 3, 5, 20, 70, 150]), words))
        elif kind == 1:
            texts.append(rng.choice(texts))
        elif kind in (2, 3):
            texts.append(edited(rng, rng.choice(texts), rng.choice([0.01, 0.03, 0.08]), words))
        elif kind == 4:
            texts.append(passage + "\n" + sentence(rng, rng.choice([5, 15, 60]), words))
        else:
            texts.append(rng.choice(texts).upper())
    rows = list(enumerate(texts)) + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "A b  c"), (n + 4, "a B\tc")]
    return rows + [rows[2], rows[7]]
