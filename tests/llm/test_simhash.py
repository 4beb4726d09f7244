from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from textwarden.llm import simhash as S
from textwarden.llm.components import connected, local_forest


def plain_fingerprint(text, words=4):
    tokens = [t for t in text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split() if t]
    shingles = [tokens[i : i + words] for i in range(max(len(tokens) - words + 1, 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows, distance):
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[find(f)] = min(doc_id, least.get(find(f), doc_id))
    return {f: least.get(find(f)) for f in fps}


def test_fingerprints():
    rng = random.Random(3)
    words = ["Plum", "plum", "é", "Ä", "tree\x0b", "日本", "a", "b", "c", "\x1c"]
    for n in (0, 1, 3, 4, 5, 9, 200):
        text = " ".join(rng.choice(words) for _ in range(n))
        assert S.fingerprint(text) == plain_fingerprint(text)


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 64, 5000, np.uint64), rng.integers(0, 1 << 64, 5000, np.uint64)
    counts = lambda x: np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 32, 2).sum(2)
    manhattan = np.abs(counts(a).astype(int) - counts(b)).sum(1)
    unary = np.bitwise_count(S.unary_counts_of(a) ^ S.unary_counts_of(b))
    assert (unary == manhattan).all() and (manhattan <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("distance, cell", [(4, 4096), (4, 3), (2, 4096), (0, 4096)])
def test_components_against_brute_force(spark, distance, cell):
    """Chains, a dense ball of points, and strangers; with small cells all is compared in block pairs."""
    rng = random.Random(distance)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for start in fps[:8]:
        for _ in range(12):
            start ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 5)))
            fps.append(start & (1 << 64) - 1)
    fps += [fps[0] ^ (1 << rng.randrange(64)) for _ in range(60)]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    links = S.near_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3), distance, cell)
    roots = {r.node: r.root for r in connected(links).collect()}
    want = plain_components([(f, f & (1 << 64) - 1) for f in signed], distance)
    groups = {}
    for f in signed:
        groups.setdefault(roots.get(f, f), set()).add(f)
    plain = {}
    for f in signed:
        plain.setdefault(want[f & (1 << 64) - 1], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_awkward_rows(awkward):
    rows = [(r.doc_id, S.fingerprint(r.text or "")) for r in awkward.collect()]
    want = plain_components(rows, 4)
    found = S.near_duplicates(awkward).collect()
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in found) == Counter((i, f, want[f]) for i, f in rows)


def test_empty_table(empty):
    assert S.near_duplicates(empty).count() == 0


def test_local_forest():
    a, b = local_forest(np.array([5, 7, 9, 1, 3]), np.array([7, 9, 5, 2, 3]))
    assert dict(zip(a.tolist(), b.tolist())) == {7: 5, 9: 5, 2: 1}


def test_long_chain_of_links(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (5, 5)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 1001: 1000, 1002: 1000}
