"""The n-gram Jaccard join on groups of more sets than a block, against brute force."""

import numpy as np
import pytest

from weir.llm import jaccard


@pytest.mark.parametrize("seed", [0, 1])
def test_large_groups(spark, monkeypatch, seed):
    """Chains and stars of near copies, whose groups take several blocks and signatures more sets than are compared at once."""
    for name, value in {"BLOCK": 6, "MANY": 10, "FEW": 3}.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(3):
        own = [f"w{x}" for x in rng.integers(0, 10_000, 60)]
        made = [own]
        while len(made) < 70:
            x = list(made[rng.integers(len(made))] if seed else own)
            for _ in range(rng.integers(1, 3)):
                x[rng.integers(len(x))] = f"w{rng.integers(10_000)}"
            made.append(x)
        found += [" ".join(x) for x in made]
    ids = rng.permutation(len(found))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in found]
    root = list(range(len(found)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(found)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(found)):
        least[find(i)] = min(least.get(find(i), 1 << 60), int(ids[i]))
    docs = spark.createDataFrame([(int(k), t) for k, t in zip(ids, found, strict=True)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
    assert got == {int(ids[i]): least[find(i)] for i in range(len(found))}
