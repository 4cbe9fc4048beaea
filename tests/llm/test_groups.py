"""Exact and near groups, components and shards, next to plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from taleweave.llm import simhash
from taleweave.llm.components import components
from taleweave.llm.exact import exact_dedup, exact_groups, lengths
from taleweave.llm.queries import ORACLES, QUERIES
from taleweave.llm.sharding import differencing, shards

from .conftest import ROWS


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def same(rows):
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("name", ["op8_exact", "op9_mixing"])
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    ours = QUERIES[name](spark, sf)
    theirs = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({ORACLES[name]})").fetchall()
    assert same(ours.collect()) == Counter(theirs)


def test_exact_groups_of_odd_rows(odd, none):
    rows = exact_groups(odd, hash_all=True).collect()
    assert len(rows) == len(ROWS)
    groups = defaultdict(list)
    for r in ROWS:
        groups[lower(r[1])].append(r[0])
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by_hash[r.full_hash]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
    kept = Counter(r.full_hash for r in rows if r.kept)
    assert kept == Counter(dict.fromkeys(by_hash, 1))
    assert exact_groups(none).count() == 0


def test_exact_dedup_keeps_one_of_each_with_its_columns(odd, none):
    out = exact_dedup(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert Counter(lower(r.text) for r in rows) == Counter(dict.fromkeys({lower(r[1]) for r in ROWS}, 1))
    assert all(r["row"] == "x" and r["k0"] == "x" for r in rows)
    assert exact_dedup(none).count() == 0


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 4):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_are_the_plain_ones(documents):
    texts = [r.text for r in documents.limit(60).collect()] + [r[1] for r in ROWS]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain_print(t) for t in texts]


def test_simhash_query_matches_plain_links(spark, sf, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, sf).collect()}
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints)
    assert got == {i: (f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, roots, strict=True)}


def near_values(rng, centres, around):
    """Random values, and around each centre a cloud whose members are linked in chains."""
    out = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    for _ in range(centres):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(around):
            out.append(x ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))))
            if rng.random() < 0.1:
                x = out[-1]
    return sorted(set(out))


@pytest.mark.parametrize("limit", [50_000, 40])
def test_tries_find_all_links(spark, limit):
    """With a low limit the tries of the clouds are cut into node pairs below their block."""
    values = near_values(np.random.default_rng(1), 3, 300)
    signed = [int(x) for x in np.array(values, np.uint64).view(np.int64)]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit)
    roots = {r.node: r.root for r in components(links).collect()}
    assert links.count() <= 5 * len(values) * (1 if limit > 1000 else 163)
    expected = defaultdict(set)
    for x, k in zip(signed, plain_components(values), strict=True):
        expected[k].add(x)
    found = defaultdict(set)
    for x in signed:
        found[roots.get(x, x)].add(x)
    assert {frozenset(s) for s in found.values()} == {frozenset(s) for s in expected.values()}


def test_near_groups_of_odd_rows(odd, none):
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == len(ROWS)
    empty = {r.component_id for r in rows if r.fp == 0}
    assert empty == {3}  # null, empty and blank texts are linked
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    out = kept.collect()
    assert len(out) == len({r.root for r in rows})
    assert simhash.near_groups(none).count() == 0 and simhash.near_dedup(none).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1_000, 1_000 + i) for i in range(1, 300)]
    loop = [(5_000, 5_001), (5_001, 5_002), (5_002, 5_000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + loop, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1_000, 1_300), 1_000), **dict.fromkeys(range(5_000, 5_003), 5_000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_differencing_known_cases():
    part = differencing([8, 7, 6, 5, 4], 2)  # the textbook case: differencing ends at 16 and 14
    sums = Counter()
    for p, x in zip(part, [8, 7, 6, 5, 4], strict=True):
        sums[p] += x
    assert sorted(sums.values()) == [14, 16]
    assert differencing([], 4) == [] and sorted(differencing([3, 3], 4)) == [0, 1]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 10_000, 500).tolist()
    sums = np.bincount(differencing(sizes, 16), sizes, 16)
    assert sums.max() - sums.min() <= 5


def check_shards(rows, count):
    slots = defaultdict(list)
    homes = defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        homes[(r.text_crc32, r.size)].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in homes.values()) and set(slots) <= set(range(count))


def test_shards_of_documents(spark, sf, documents):
    rows = QUERIES["op4_differencing"](spark, sf).collect()
    check_shards(rows, 16)
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    mean = sum(sums.values()) / 16
    assert len(rows) == documents.count() and max(sums.values()) - min(sums.values()) <= 0.01 * mean


def test_shards_of_odd_rows_and_a_group_larger_than_a_shard(spark, odd, none):
    rows = shards(odd, 4).collect()
    assert len(rows) == len(ROWS)
    check_shards(rows, 4)
    many = spark.createDataFrame([(i, "copies " * 9 if i < 400 else f"text {i} " * (i % 7)) for i in range(900)], "doc_id long, text string")
    rows = shards(many, 8).collect()
    check_shards(rows, 8)
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    large = max(sums.values())
    others = sorted(sums.values())[:-1]
    assert large == 400 * 64 and max(others) - min(others) <= 16
    assert shards(none, 4).count() == 0


def test_first_pass_of_exact_dedup_hashes_no_text(documents):
    plan = lengths(documents)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange", 1) if "Exchange" in plan else ("", plan)
    assert "octet_length" in plan and not any(f in plan for f in ("sha", "md5", "xxhash64(", "ArrowEval", "substring"))


def test_texts_that_agree_at_first_are_told_apart(spark):
    """Equal lengths; equal lengths and beginnings; and equal but for letters' case."""
    same = "x" * 100
    texts = ["abc", "ABC", "abd", "abcd", same + "1", same + "2", same + "1", (same + "2").upper(), "Ünï", "ünï"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in exact_groups(docs).collect()}
    for i, t in enumerate(texts):
        own = [j for j, u in enumerate(texts) if lower(u) == lower(t)]
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (max(own), len(own), i == max(own))
    # told apart by their length, or by the hash of their beginning
    assert {i for i, r in rows.items() if r.full_hash is None} == {2, 3, 8, 9}
