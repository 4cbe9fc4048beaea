"""The token-group matrix, conversation repair and product codes next to SQL and plain versions."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taleweave.llm import codes, jaccard, repair
from taleweave.llm.components import components
from taleweave.llm.queries import ORACLES, QUERIES
from taleweave.session import hand_over
from tests.parity import compare, connect

from .conftest import ROWS


@pytest.mark.parametrize("name", ["op11_token_groups", "op12_repair", "op13_codes"])
def test_queries_match_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None


# ---- op11


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        out.append({" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    return out


def plain_roots(sets, least=90):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited_texts(rng, count):
    """Texts around bases, some of them sharing a long passage; one base has a large cloud of near copies."""
    passage = [f"p{i}" for i in range(60)]
    out = []
    while len(out) < count:
        base = [f"w{x}" for x in rng.integers(0, 4_000, rng.integers(6, 200))]
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        out.append(" ".join(base))
        for _ in range(rng.integers(0, 5) if len(out) > 150 else 150):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(1, 4)):
                copy[at] = f"x{rng.integers(0, 4_000)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("members", [128, 5])
def test_matrix_finds_all_links(spark, members):
    """With few members a group the large cloud is dealt to many groups, and links between groups are needed."""
    texts = edited_texts(np.random.default_rng(5), 700) + [r[1] for r in ROWS]
    sets = plain_sets(texts)
    roots = plain_roots(sets)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs, members=members).collect()}
    assert got == {i: (len(sets[i]), roots[i]) for i in range(len(texts))}
    assert max(Counter(roots).values()) > 60


@pytest.mark.parametrize("least", [90, 80])
def test_similar_sets_share_a_row_of_the_matrix(least):
    """Also sets so small that parts without tokens are frequent."""
    rng = np.random.default_rng(1)
    checked = 0
    for q in [*range(1, 40), 100, 333, 2_000] * 40:
        tokens = rng.integers(0, 1 << 63, q, dtype=np.uint64)
        other = tokens[rng.random(q) > rng.choice([0.02, 0.06, 0.1])]
        other = np.concatenate((other, rng.integers(0, 1 << 63, rng.integers(0, 1 + q // 12), dtype=np.uint64)))
        a, b = np.unique(tokens), np.unique(other)
        both = len(np.intersect1d(a, b))
        if not len(b) or len(a) == len(b) == both or 100 * both < least * (len(a) + len(b) - both):
            continue
        checked += 1
        rows, at = jaccard.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), least)
        assert len(np.intersect1d(rows[: at[1]], rows[at[1] :]))
    assert checked > 300


def test_a_group_opens_only_for_queries_within_the_bound():
    def texts(*sets):
        return [" ".join(map(str, x)) for x in sets]

    rows = pa.table({"node": [1, 2, 3], "text": texts(range(100), range(5, 105), range(500, 600))})
    group = jaccard._Group(rows, 1, 90)
    assert list(group.compare()) == [(1, 2)]
    asked = []
    group._like = lambda has, size, members, like=group._like: asked.append(size) or like(has, size, members)
    ask = pa.array(texts(range(2, 102), [*range(50), *range(500, 550)], range(900, 1_000), [*range(60), *range(900, 940)]))
    assert set(group.answer(np.array([7, 8, 9, 10]), *jaccard._sets(ask, 1))) == {(7, 1), (7, 2)}
    # the second query is within the bound of the union but like no member; the others never open the group
    assert len(asked) == 2


def test_near_copies_make_few_queries_and_links(spark, monkeypatch):
    """A cluster of near copies, many of which are not linked, in large groups and many small ones: a set asks no more groups
    than full ones would be, and links are told once for what is joined."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(600):
        copy = [f"w{i}" for i in range(148)]
        for at in rng.integers(0, 148, rng.integers(1, 9)):
            copy[at] = f"x{rng.integers(0, 1_000_000)}"
        texts.append(" ".join(copy))
    seen, links = {}, []

    def kept(df, name):
        seen[name] = hand_over(df, name)
        return seen[name]

    monkeypatch.setattr(jaccard, "hand_over", kept)
    monkeypatch.setattr(jaccard, "components", lambda df: links.append(df.count()) or components(df))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs, members=32).collect()}
    assert got == dict(enumerate(plain_roots(plain_sets(texts))))
    assert seen["queries"].count() < len(texts) ** 2 / 32
    assert links[-1] < 2 * len(texts)


def test_queries_are_told_one_link_with_what_is_joined():
    text = [" ".join(map(str, range(k, k + 100))) for k in (0, 1, 2, 3, 300)]
    rows = pa.record_batch(
        [
            pa.array(x, t)
            for x, t in (
                ([1] * 9, pa.int64()),
                ([0] * 9, pa.int32()),
                ([0] * 4 + [1] * 5, pa.int32()),
                ([*range(10, 19)], pa.int64()),
                # members joined to 10, one of them to 13; queries joined to each other, to 13, and to nothing
                ([10, 10, 10, 13, 14, 14, 13, 17, 18], pa.int64()),
                ([text[0], text[1], text[2], text[3], text[1], text[2], text[0], text[3], text[4]], pa.string()),
            )
        ],
        ["group", "copy", "asks", "node", "root", "text"],
    )
    got = [r for batch in jaccard._open(1, 90)(iter([rows.slice(0, 6), rows.slice(6)])) for r in batch.to_pylist()]
    # 14 meets both joined sets of the group; 15 and 16 are then joined with them
    assert [r["a"] for r in got] == [14, 14, 17]
    assert {r["b"] for r in got[:2]} & {10, 11, 12} and got[1]["b"] == 13


@pytest.mark.parametrize("most", [1 << 28, 1 << 15])
def test_wanted_texts_are_told_by_a_bitmap(spark, monkeypatch, most):
    """All wanted texts stay, few others do, also where the bitmap is as large as it may be."""
    monkeypatch.setattr(jaccard, "BITMAP", most)
    texts = spark.range(40_000).select(F.col("id").cast("string").alias("k0"), F.xxhash64("id").alias("k1"), F.lit("x").alias("text"))
    wanted = texts.filter("k1 % 16 = 0").select("k0", "k1").unionByName(spark.createDataFrame([("\0", 1)], "k0 string, k1 long"))
    likely = jaccard._likely(texts, wanted)
    n = wanted.count() - 1
    assert likely.columns == texts.columns
    assert likely.join(wanted, ["k0", "k1"]).count() == n
    assert likely.count() < n + 40_000 / (16 if most > 1 << 15 else 8)
    assert jaccard._likely(texts, wanted.limit(0)).count() == 0


def test_matrix_on_odd_rows(odd, none):
    rows = jaccard.jaccard_groups(odd).collect()
    sets = plain_sets([r[1] for r in ROWS])
    roots = plain_roots(sets)
    least = defaultdict(list)
    for (i, *_), k in zip(ROWS, roots, strict=True):
        least[k].append(i)
    want = Counter()
    for (i, *_), s, k in zip(ROWS, sets, roots, strict=True):
        known = [x for x in least[k] if x is not None]
        want[i, len(s), i if not s else min(known) if known else None] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == want
    assert jaccard.jaccard_groups(none).count() == 0


# ---- op12

GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+", "", text)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def plain_plan(rows):
    """Least (cost, audit) from left to right over the last role written: nothing, s, u or a."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                for x in after[state].replace("s", ""):
                    best[x] = min(best.get(x, (math.inf, "")), (cost + 2, audit + "I"))
        return best

    for (_, role, _), fault in zip(rows, faults(rows), strict=True):
        following = {}
        for state, (cost, audit) in inserted(best).items():
            moves = [(state, 3, "D")]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                moves += [(x, 2 + extra, "R") for x in after[state] if x != "s"]
                moves += [(x, extra, "K") for x in after[state] if role[:1] == x]
            for x, more, edit in moves:
                following[x] = min(following.get(x, (math.inf, "")), (cost + more, audit + edit))
        best = following
    best = inserted(best)
    return min(best[x] for x in ("", "a") if x in best)


def plain_lines(rows, audit):
    system = (len(audit) - audit.count("D")) % 2
    left, out = iter(rows), []
    for edit in audit:
        turn = ("user", "assistant")[(len(out) - system) % 2]
        if edit == "I":
            out.append((turn, ""))
            continue
        _, role, text = next(left)
        if edit != "D":
            out.append((role if edit == "K" else turn, text))
    assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in out)) and next(left, None) is None
    return out


def test_plain_plan_is_the_best_of_all():
    texts = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    for n in range(4):
        for roles in itertools.product("uast", repeat=n):
            rows = [(i, texts[r], f"text {i}" + ("." if i % 2 else "")) for i, r in enumerate(roles)]
            bad = faults(rows)
            best = (math.inf, "")
            for edits in itertools.product("KRD", repeat=n):
                for gaps in itertools.product(range(3), repeat=n + 1):
                    cost = 2 * sum(gaps) + sum({"K": 0, "R": 2, "D": 3}[e] + (e != "D" and f == "truncated") for e, f in zip(edits, bad, strict=True))
                    if cost > best[0] or cost > 3 * n:
                        continue
                    slots = [["ua"] * gaps[0]]
                    for role, e, g in zip(roles, edits, gaps[1:], strict=True):
                        slots.append([] if e == "D" else [role if e == "K" else "ua"])
                        slots.append(["ua"] * g)
                    flat = [x for s in slots for x in s]
                    if any(GRAMMAR.fullmatch("".join(p)) for p in itertools.product(*flat)):
                        audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:], strict=True))
                        best = min(best, (cost, audit))
            assert best == plain_plan(rows), rows


def test_parse_agrees_with_the_plain_plan_at_any_length():
    rng = np.random.default_rng(2)
    roles = ["user", "assistant", "system", "tool", "assistant", "user"]
    for n in [*range(1, 30), 60, 300]:
        rows = [(i, roles[rng.integers(6)], ["", "cut", "whole.", f"text {i}.", f"text {i}", f"own {i}!"][rng.integers(6)]) for i in range(n)]
        run = repair._Run(0)
        for (_, role, _), fault in zip(rows, faults(rows), strict=True):
            kind = max(0, repair.KINDS.find(role[0]))
            run.add(0 if fault in ("blank", "duplicate") else 1 + 2 * kind + (fault == "truncated"), kind, 1)
        _, _, _, _, illegal, costs, audits = run.row(0)
        cost, audit = min((costs[x], audits[x]) for x in repair.START if costs[x] is not None)
        assert (cost, audit) == plain_plan(rows)
        pairs = ["".join(r[0] for _, r, _ in rows[i : i + 2]) for i in range(n - 1)]
        assert illegal == sum(p not in ("su", "ua", "au") for p in pairs)
    run = repair._Run(0)
    run.add(4, 1, 100)
    cost, audit = run.row(0)[5][repair.E], run.row(0)[6][repair.E]
    assert (cost, audit) == (300, "D" * 100)


def check_repairs(out, lines, rows):
    """``rows`` are (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    got = {r.conv_id: r for r in out}
    assert len(out) == len(got) and set(got) == set(groups)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        cost, audit = plain_plan(own)
        r, bad = got[conv], Counter(faults(own))
        assert (r.cost, r.audit) == (cost, audit)
        assert (r.blank, r.duplicate, r.truncated) == (bad["blank"], bad["duplicate"], bad["truncated"])
        pairs = ["".join(x[1][:1] for x in own[i : i + 2]) for i in range(len(own) - 1)]
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        turns = [t for t, _, _ in own if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert [(x.role, x.text) for x in sorted(lines.get(conv, []), key=lambda x: x.position)] == plain_lines(own, audit)


ODD_TURNS = [
    (1, 0, "system", "Be kind."),
    (1, 1, "user", "Hi"),
    (1, 1, "user", "Hi"),
    (1, 3, "assistant", None),
    (1, None, "user", "No turn."),
    (2, None, None, None),
    (2, None, None, None),
    (3, 5, "assistant", "Only an answer."),
    (3, 5, "", "An empty role."),
    (3, 5, "User", "A capital letter."),
    (None, 1, "user", "No conversation?"),
    (None, 2, "assistant", "Yes\n  "),
    (None, 2, "assistant", "long " * 50_000 + "."),
    (4, -9, "user", " \t\n"),
    (5, 2**62, "user", "Far."),
    (5, -(2**62), "user", "apart"),
]


def test_repair_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, kind string, part string, c string, audit string, copies string"
    rows = spark.createDataFrame([(*r, *["x"] * 5) for r in ODD_TURNS], schema).repartition(3)
    found = repair.plans(rows)
    lines = defaultdict(list)
    for r in repair.repaired(rows).collect():
        lines[r.conv_id].append(r)
    check_repairs(found.collect(), lines, ODD_TURNS)
    none = rows.limit(0)
    assert repair.plans(none).count() == repair.repaired(none).count() == repair.repair_report(none).count() == 0
    report = repair.repair_report(rows).collect()
    assert Counter(r.conv_id for r in report) == Counter({r[0] for r in ODD_TURNS})


def test_long_conversations_are_parsed_over_several_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [(7, int(t), ["user", "assistant", "system"][rng.integers(3)], f"text {t % 900}" + ".?"[: t % 3]) for t in rng.permutation(1_500)]
    rows += [(c, t, ["user", "assistant"][t % 2], "Same text.") for c in range(6, 9) for t in range(2_000, 2_004)]
    rows += [(9, 0, "user", "Copied.")] * 60
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    lines = defaultdict(list)
    for r in repair.repaired(df).collect():
        lines[r.conv_id].append(r)
    check_repairs(repair.plans(df).collect(), lines, rows)


def test_damage_is_the_stated_one(spark):
    from zlib import crc32

    rows = spark.createDataFrame([(c, t, "assistant", "A. b? c!") for c in range(30) for t in range(4)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.copies) for r in repair.damaged(rows).collect())
    want = Counter()
    for r in rows.collect():
        fault = crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20
        if fault:
            text = {1: "", 2: re.sub("[.!?]", "", r[3] or " ")}.get(fault, r[3] or " ")
            want[r[0], r[1], "user" if fault == 4 else r[2] or " ", text, 2 if fault == 3 else 1] += 1
    assert got == want


# ---- op13


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label) and the codebooks, with Python's integers and plain distances."""
    whole = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not whole:
        return [], []
    width = max(1, -(-max(len(r[1]) for r in whole) // parts)) * parts
    m = width // parts

    def integer(x):
        return int(x) * 4096 if abs(x) >= 2.0**53 else math.floor(x * 4096)

    ints = [[integer(x) for x in r[1]] + [0] * (width - len(r[1])) for r in whole]
    first = sorted(range(len(whole)), key=lambda k: (whole[k][0] is None, whole[k][0] or 0, whole[k][1]))[:entries]
    books = [[ints[k][p * m : (p + 1) * m] for k in first] for p in range(parts)]

    def assign():
        out = []
        for v in ints:
            own = []
            for p in range(parts):
                x = v[p * m : (p + 1) * m]
                own.append(min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p])))
            out.append(own)
        return out

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [ints[k][p * m : (p + 1) * m] for k in range(len(ints)) if near[k][p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    near = assign()
    done = [(r[0], "".join(f"{e:02x}" for _, e in n), min(sum(d for d, _ in n), 2**63 - 1), r[2]) for r, n in zip(whole, near, strict=True)]
    return done, books


def check_codes(out, rows):
    done, books = plain_codes(rows)
    sums = Counter()
    for _, _, error, label in done:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    want = Counter((i, code, error, min(sums[label], 2**63 - 1), digest) for i, code, error, label in done)
    assert Counter(tuple(r) for r in out) == want


NAMES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(size=19).round(2)], int(i % 3)) for i in range(60)]
    rows += [(70 + i, [1.0, 2.0], None) for i in range(20)]  # short vectors, many copies, no label
    rows += [(3, [0.5] * 19, 1), (None, [0.25] * 19, 2), (90, [], 2), (91, None, 0), (92, [1.0, None], 0), (93, [math.nan], 0), (94, [math.inf], 1)]
    schema = "vec_id long, embedding array<double>, label int, code string, error string, of string, vector string"
    df = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], schema).repartition(3)
    check_codes(codes.compress(df).select(*NAMES).collect(), rows)
    large = rows + [(100, [1e300, -1e20] + [0.1] * 17, 5), (101, [3e18] * 19, 5)]
    df = spark.createDataFrame([(*r, *["x"] * 4) for r in large], schema).repartition(3)
    check_codes(codes.compress(df).select(*NAMES).collect(), large)
    assert codes.compress(df.limit(0)).count() == 0 and codes.compress(df.filter("vec_id = 91")).count() == 0


def test_transform_scales_distances_and_orders_by_sign_changes():
    for size in (1, 2, 4, 8, 32):
        h = codes.walsh_hadamard(np.eye(size, dtype=np.int64)).T
        assert (h @ h.T == size * np.eye(size)).all()
        assert [(np.diff(row) != 0).sum() for row in h] == list(range(size))
    rng = np.random.default_rng(0)
    x, entries = rng.integers(-50, 50, (200, 8)), rng.integers(-50, 50, (16, 8))
    entries[9] = entries[4]  # a tie goes to the lower index
    found, distance = codes.nearest(codes.walsh_hadamard(x), codes.walsh_hadamard(entries))
    plain = ((x[:, None] - entries[None]) ** 2).sum(-1)
    assert (found == plain.argmin(1)).all() and (distance == 8 * plain.min(1)).all()


def test_only_codebooks_reach_the_driver(spark):
    """Partial sums are made by the tasks: the exchange below the means has a row for each entry, not for each vector."""
    df = spark.range(10).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), F.array(*[F.col("id").cast("double")] * 8).alias("vector"))
    books = codes.train_codebooks(df, rounds=1)
    assert len(books.entries) == 8 and all(len(p) == 10 for p in books.entries)
