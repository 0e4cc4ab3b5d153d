from __future__ import annotations

import numpy as np
import pytest

from vexalith.shipping import ship

ship()
SCHEMA = "id long, embedding array<float>, content string, category string, batch_no long, label long, a string, node int, h int"


def similar_docs(seed: int, n: int = 260, hot: int = 0):
    """Rows with copies, edits, reorderings, near vectors, bad vectors, nulls and clashing columns."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows: list[list] = []
    for i in range(n):
        kind = rng.integers(0, 10)
        if rows and kind < 5:
            base = rows[rng.integers(0, len(rows))]
            words = (base[1] or "alpha beta gamma delta epsilon zeta eta theta").split()
            vector = None if base[0] is None else np.array(base[0])
            if kind == 1:
                for _ in range(int(rng.integers(1, 9))):
                    words[rng.integers(0, len(words))] = vocabulary[rng.integers(0, 400)]
                vector = None
            if kind == 2:
                cut = int(rng.integers(0, len(words)))
                words = words[cut:] + words[:cut]
                vector = None if vector is None else vector * 2
            if kind == 3:
                words = [vocabulary[j] for j in rng.integers(0, 400, 20)]
                vector = None if vector is None else vector + rng.normal(0, 0.012, len(vector))
            text = " ".join(words)
        else:
            words = [vocabulary[j] for j in rng.integers(0, 400, int(rng.integers(8, 60)))]
            text, vector = " ".join(words), rng.normal(0, 1, 128)
        if vector is None:
            vector = rng.normal(0, 1, 128)
        rows.append([[float(x) for x in vector], text])
    for j in range(hot):
        words = [f"hot{k}" for k in range(30)]
        words[j % 30] = f"own{j}"
        rows.append([[float(x) for x in rng.normal(0, 1, 128)], " ".join(words)])
    bad = [None, [], [1.0] * 64, [0.0] * 128, [float("nan")] + [1.0] * 127, [None] + [1.0] * 127, [float("inf")] + [1.0] * 127, [1.0] * 129]
    for k, v in enumerate(bad):
        rows.append([v, [None, "", "   ", "a few words"][k % 4]])
    out = []
    for i, (v, t) in enumerate(rows):
        out.append((i * 3 + 1, v, t, ["x", None, " X", ""][i % 4], None if i < 3 else i // 60, i, "clash", 1, 2))
    return out


@pytest.fixture(scope="session")
def docs_rows():
    return similar_docs(5)
