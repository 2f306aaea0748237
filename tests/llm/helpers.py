"""Small corpora for the brute-force tests."""

from __future__ import annotations

import random


def docs_of(spark, rows):
    """(doc_id, text) rows as a table of three partitions."""
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def sample_texts(seed: int, n: int = 60, words: int = 40):
    """Documents of short lines with copies, near copies, repeats and odd white space."""
    random.seed(seed)
    known, rows = [], []
    for i in range(n):
        lines = []
        for _ in range(random.randint(1, 5)):
            kind = random.random()
            if known and kind < 0.25:
                line = random.choice(known)
            elif known and kind < 0.6:
                line = random.choice(known).split(" ")
                line[random.randrange(len(line))] = f"W{random.randrange(words)}"
                line = " ".join(line)
            else:
                line = " ".join(f"w{int(random.paretovariate(0.7)) % words}" for _ in range(random.randint(1, 14)))
            known.append(line)
            lines.append(line if random.random() < 0.8 else f"  {line}\t ")
        rows.append((i, "\n".join(lines)))
    return rows
