from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

from textwarden.llm.collocations import advance, collocations, double_array, pieces


def brute_force(rows, min_count, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in pieces(text):
            n[lang] += len(piece)
            for m in range(1, longest + 1):
                for i in range(len(piece) - m + 1):
                    f[lang][tuple(piece[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) >= 2 and a >= min_count}
        found = []
        for p, a in cands.items():
            if any(len(q) == len(p) + 1 and b >= a and (q[1:] == p or q[:-1] == p) for q, b in cands.items()):
                continue
            cut = min(((1000 * a * n[lang]) // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            k = cut[1]
            found.append((lang, " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], cut[0]))
        found.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], r + 1, *x[1:]) for r, x in enumerate(found[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_brute_force(spark, awkward):
    rows = [(r.lang, r.text) for r in awkward.collect()]
    rows += [("en", "New York is big. new york, NEW YORK city; the new york times\nnew  york\tcity")] * 3
    rows += [(None, "a b c d e f a b c d e f a b c")] * 4 + [("de", "x y x y x y")] * 2
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS rank", "'q' AS phrase")
    assert got(collocations(df, min_count=3, top=5)) == brute_force(rows, 3, top=5)
    assert got(collocations(df, min_count=2)) == brute_force(rows, 2)


def test_empty(empty):
    assert collocations(empty).collect() == []


def test_double_array_walks_exactly_the_paths():
    paths = [[0, 5, 6], [0, 5, 7], [1, 5, 6], [0, 9]]
    base, check, ends = double_array(paths)
    assert len(set(ends)) == 4
    for path, end in zip(paths, ends):
        s = np.zeros(1, dtype=np.int64)
        for c in path:
            s = advance(base, check, s, np.array([c]))
        assert s[0] == end
    s = np.zeros(1, dtype=np.int64)
    for c in [1, 5, 7]:
        s = advance(base, check, s, np.array([c]))
    assert s[0] == -1


def test_words_in_against_pieces():
    import pyarrow as pa

    from textwarden.llm.collocations import words_in

    texts = ["", "A b,C", " \t", "..", "x\x0by\x1cz É!", "end", "one  two\n\nthree", ""]
    for cut in (texts, texts[3:6], [""]):
        found, places, ends = words_in(pa.array(texts, pa.string()).slice(3, 3) if cut == texts[3:6] else pa.array(cut))
        written = [None] * int(ends[-1])
        for place, word in zip(places, found.to_pylist()):
            written[place] = word
        expected = [[x for piece in pieces(t) for x in (*piece, None)] for t in cut]
        assert written == [x for t in expected for x in t]
        assert ends.tolist() == np.cumsum([len(t) for t in expected]).tolist()


def test_large_trie_is_laid_out_in_time():
    import time

    rng = np.random.default_rng(3)
    paths = np.unique(np.column_stack([rng.integers(0, 4, 150_000), *rng.zipf(1.3, (2, 150_000)) % 30_000]), axis=0)
    began = time.monotonic()
    base, check, ends = double_array(paths.tolist())
    assert time.monotonic() - began < 15
    states = np.zeros(len(paths), np.int64)
    for codes in paths.T:
        states = advance(base, check, states, codes)
    assert states.tolist() == ends and len(set(ends)) == len(ends) and min(ends) > 0
