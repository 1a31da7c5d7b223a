"""Small corpora with copies, shared passages, nulls, ties and repeated rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocab: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocab)}" + rng.choice(["", "", "", ",", "é", "ß."]) for _ in range(n)]


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    passage = words(rng, 70)
    base = words(rng, 200)
    out = []
    for i in range(n):
        w = words(rng, rng.randrange(0, 300))
        kind = i % 7
        if kind == 1:
            w = base[:]
        elif kind == 2:
            w = base[:]
            for _ in range(2):
                w[rng.randrange(len(w))] = "zz"
        elif kind == 3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        elif kind == 4:
            w = passage + w + passage
        sep = rng.choice([" ", "  ", "\n", " \t"])
        out.append((i, sep.join(w), "en", f"src{i % 5}", None))
    out += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \n\t ", None, "s", 3)]
    out += [(n + 3, "é" * 150 + "a" * 300, "fr", None, 1), (n + 4, "ab" * 400, "fr", None, 1)]
    out += [(n + 5, " ".join(words(rng, 9000, 50)), "de", "long", 1)]
    rng.shuffle(out)
    return out


def frame(spark, data, schema: str = SCHEMA, parts: int = 5):
    return spark.createDataFrame(data, schema).repartition(parts)
