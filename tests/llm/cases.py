"""Small hostile tables: nulls, blanks, long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words long, target double, h long"
VOCAB = [f"w{i}x" for i in range(400)]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(rng: random.Random, text: str, k: int) -> str:
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


def documents(seed: int = 1) -> list[tuple]:
    """Rows (doc_id, text, ...): originals, near and exact copies, a chain, nulls, blanks, short and long texts."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", "   ", "\t\n", "one", "One", "two words", "a b c", "A  b\nc", "a b c d"]
    base = [sentence(rng, rng.randint(20, 120)) for _ in range(30)]
    texts += base
    texts += [edited(rng, t, k) for t in base[:12] for k in (1, 1, 2, 3)]
    texts += [base[3]] * 9 + [base[4].upper()] * 3
    chain = base[20]
    for _ in range(8):
        chain = edited(rng, chain, 1)
        texts.append(chain)
    hot = sentence(rng, 100)
    texts += [edited(rng, hot, rng.randint(0, 7)) for _ in range(90)]  # scattered edits
    texts += [sentence(rng, 30) + " " + " ".join(VOCAB[:40]) for _ in range(60)]  # a passage in many texts
    texts += [sentence(rng, 20_000), "x" * 100_000]
    rows = [(1000 + 7 * i % 9973, t, None, None if i % 11 == 0 else f"s{i % 4}", None, 5, 1.5, 3) for i, t in enumerate(texts)]
    rows += [rows[15], rows[15], (None, base[5], None, "s1", None, 5, 1.5, 3), (None, None, None, None, None, None, None, None),
             (None, base[5], None, "s1", None, 5, 1.5, 3)]
    rng.shuffle(rows)
    return rows
