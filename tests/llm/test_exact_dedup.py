from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from textwarden.llm.exact_dedup import ContentTable, deduplicate, duplicate_classes, plan_buckets


def brute_force(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return groups


def check(found, rows):
    groups = brute_force(rows)
    assert len(found) == len(rows)
    for r in found:
        assert r.text_sha256 in {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    by_sha = defaultdict(list)
    for r in found:
        by_sha[r.text_sha256].append(r)
    for text, ids in groups.items():
        own = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in own)
        assert {(r.keep_id, r.group_size) for r in own} == {(max(known) if known else None, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [max(known) if known else None]


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    check(duplicate_classes(awkward).collect(), rows)
    stay = deduplicate(awkward)
    assert stay.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(
        str(r.doc_id) for r in duplicate_classes(awkward).filter("kept").collect()
    )
    assert all(r.spans == "own" and r.kept == "own" for r in stay.collect())
    assert {r.doc_id for r in stay.filter("text IS NULL").collect()} <= {0, 1, None}


def test_a_third_of_all_rows_in_one_group_and_tiny_buckets(spark):
    rng = random.Random(1)
    rows = [(i, "hot text" if i % 3 == 0 else f"text {rng.randrange(900)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(duplicate_classes(df, bucket_bytes=200).collect(), rows)
    kept = {r.doc_id for r in deduplicate(df, bucket_bytes=200).collect()}
    assert kept == {max(ids) for ids in brute_force(rows).values()}


def test_empty_table(empty):
    assert duplicate_classes(empty).count() == 0
    assert deduplicate(empty).columns == empty.columns and deduplicate(empty).count() == 0


def test_contents_decide_where_hashes_are_equal():
    table = ContentTable()
    numbers = [table.entry(5, str(i % 700).encode())[0] for i in range(2100)]
    assert numbers == [i % 700 for i in range(2100)]


def test_buckets_are_split_until_they_fit():
    sizes = {3: 10, 4: 1000, 9: 10, 250: 30}
    base, parts, n = plan_buckets(sizes, 100, bits=8)
    assert parts[4] == 10 and n == max(b + p for b, p in zip(base, parts))
    held = {}
    for value, size in sizes.items():
        if parts[value] == 1:
            held[base[value]] = held.get(base[value], 0) + size
    assert all(s <= 100 for s in held.values())
    assert plan_buckets({}, 100, bits=8)[2] == 1
