"""Walks over candidate sets in blocks next to a plain loop."""

import functools
import hashlib
import random

import pytest

from taleweave.operators import ngram
from taleweave.operators.walk import Blocks

END = "</s>"


def plain_walk(sets, key, prompt, steps, penalty):
    at, said, seen = prompt[-1], [], set(prompt)
    for step in range(steps):
        rows = sets.get(at)
        if not rows:
            break
        low = {r.next: max(1, int((r.n / 1000) ** (1 / penalty) * 1000 + 0.5)) for r in rows}
        weights = [(r.next, low[r.next] if penalty != 1.0 and r.next in seen else r.n) for r in rows]
        total = sum(w for _, w in weights)
        u = int(hashlib.md5(f"690-{key}-{step}".encode()).hexdigest()[:13], 16) / (1 << 52)
        spot = min(int(u * total), total - 1)
        for at, w in weights:
            if spot < w:
                break
            spot -= w
        if at == END:
            break
        said.append(at)
        seen.add(at)
    return " ".join(said)


@pytest.mark.parametrize("penalty", [1.0, 1.2])
def test_blocks_walk_as_a_plain_loop(spark, monkeypatch, penalty):
    monkeypatch.setattr(ngram, "Blocks", functools.partial(Blocks, size=8))
    rng = random.Random(5)
    words = ["the"] * 6 + [f"w{i}" for i in range(14)]
    pairs = {("the", f"w{i}"): 200 for i in range(14)}
    for _ in range(60):
        pair = rng.choice(words), rng.choice([*words, END, "dead"])
        pairs[pair] = pairs.get(pair, 0) + rng.randrange(1, 5)
    counts = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "prev string, next string, n long")
    kept = ngram.candidate_set(counts, fine=penalty != 1.0)
    sets = {}
    for r in sorted(kept.collect(), key=lambda r: r.before):
        sets.setdefault(r.prev, []).append(r)
    prompts = [(f"k{i}", [rng.choice([*words, "never", END]) for _ in range(6)]) for i in range(40)] + [("u", ["the", "unknown"])]
    df = spark.createDataFrame(prompts, "id string, p array<string>")
    got = {r.id: r.text for r in ngram.generate(df, kept, "id", "p", END, 7, checkpoint_every=3, penalty=penalty).collect()}
    assert got == {key: plain_walk(sets, key, p, 7, penalty) for key, p in prompts}


def test_candidates_lie_in_few_rows(spark):
    """A step reads a row for each block, and a context with most of the weight is in several blocks."""
    rows = [("a", f"t{i}", 50 - i) for i in range(40)] + [(f"t{i}", "a", 1) for i in range(40)]
    kept = ngram.nucleus(spark.createDataFrame(rows, "prev string, next string, n long"), 1)
    sets = Blocks(kept, size=10)
    assert sets.blocks == 8 and sets.table.count() <= 8
    (a, spread), = sets.wide
    assert a == sets.number_of("a") and spread > 1
    assert {r.size for r in sets.table.collect()} != {0} and sum(r.size for r in sets.table.collect()) == 40 + 40 * spread


def test_tokens_count_for_each_prompt_of_a_key(spark):
    rows = [("x", "a", 64_000, 0, 100_000, 2), ("x", "b", 36_000, 64_000, 100_000, 2)]
    kept = spark.createDataFrame(rows, "prev string, next string, n long, before long, kept_total long, kept_count long")
    keys = spark.range(4000).selectExpr("case when id < 2000 then null else id div 2 end as id")
    prompts = keys.selectExpr("id", "array('a', 'x') as p")
    out = ngram.generate(prompts, kept, "id", "p", END, 1, penalty=1.2).collect()
    alone = sum(r.text == "b" for r in out if r.id is not None)
    assert len(out) == 4000 and len({r.text for r in out if r.id is None}) == 1
    low = 64 ** (1 / 1.2)
    assert alone / 2000 == pytest.approx(1 - low / (100 - 2 * (64 - low)), abs=0.05)
