"""Fingerprints, packing, mixing and the pipeline next to plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from taleweave.llm import exact, fingerprint, mixing, packing, quality, simhash
from taleweave.llm.queries import QUERIES

from .conftest import ROWS


def edits(rows):
    """(doc_id, text, edited text, next text) by falling id, then text; rows without an id last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(text) // 3
        yield doc_id, text, text[: len(text) - m] + after[:m], after


def check_fingerprints(out, rows):
    want = Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in edits(rows))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    prints = {i: fingerprint.trees(pa.array([t])).prints[0] for i, t, _, _ in edits(rows)}
    by_text = defaultdict(set)
    for i, t, _, _ in edits(rows):
        by_text[t].add(prints[i]) if Counter(x[0] for x in rows)[i] == 1 else None
    assert all(len(s) <= 1 for s in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_fingerprint_query(spark, sf, documents):
    out = QUERIES["op3_merkle"](spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check_fingerprints(out, rows)
    texts = dict(rows)
    by_print = defaultdict(set)
    for r in out:
        by_print[r.fingerprint].add(texts[r.doc_id])
    assert len(by_print) == len(set(texts.values())) and all(len(s) == 1 for s in by_print.values())
    long = [r for r in out if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > 0.55
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.98


def test_fingerprints_of_odd_rows(odd, none):
    out = fingerprint.compare_with_edit(odd).collect()
    check_fingerprints(out, [r[:2] for r in ROWS])
    assert {r.near_next for r in out if r.doc_id == 7} == {1.0}  # the next text is its copy
    assert fingerprint.compare_with_edit(none).count() == 0


def test_single_document_is_followed_by_itself(spark):
    (row,) = fingerprint.compare_with_edit(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0


def test_branches_locate_edits():
    rng = np.random.default_rng(3)
    lines = [" ".join(f"word{rng.integers(500)}" for _ in range(20)) for _ in range(60)]
    changed = list(lines)
    changed[31] = "this line was written anew in the second text"
    a, b = fingerprint.trees(pa.array(["\n".join(lines), "\n".join(changed)])).prints
    assert fingerprint.differences(a, a) == []
    found = fingerprint.differences(a, b)
    # a long line may be several paragraphs: those named are the changed line's, one after the other
    places = [(i, j) for i, s in enumerate(b.split(":")[1].split("/")) for j in range(len(s.split("|")))]
    at = [places.index(f) for f in found]
    assert 1 <= len(found) <= 3 and at == list(range(at[0], at[0] + len(at)))
    assert 0.9 < fingerprint.print_likeness(a, b) < 1


def plain_tree_likeness(a, b):
    """Recursive: equal branches are set against each other, the children of the rest are compared together."""

    def leaves(node):
        return sum(map(leaves, node)) if isinstance(node, tuple) else 1

    def met(left, right):
        left, right, both = list(left), list(right), 0
        for node in list(left):
            if node in right:
                left.remove(node)
                right.remove(node)
                both += leaves(node)
        if left and right and isinstance(left[0], tuple):
            both += met([c for node in left for c in node], [c for node in right for c in node])
        return both

    def tree(x):
        return tuple(tuple(tuple(p[i : i + 16] for i in range(0, len(p), 16)) for p in s.split("|")) for s in x.split(":")[1].split("/"))

    x, y = tree(a), tree(b)
    return 1.0 if x == y else 2 * met(x, y) / (leaves(x) + leaves(y))


def test_likeness_is_that_of_a_plain_recursive_tree(documents):
    texts = [r.text for r in documents.orderBy("doc_id").limit(80).collect()] + ["", "", "a", "a b", "\n\n", "日本語" * 400]
    edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
    a, b = fingerprint.trees(pa.array(texts)), fingerprint.trees(pa.array(edited))
    n = len(texts)
    want = [plain_tree_likeness(x, y) for x, y in zip(a.prints, b.prints, strict=True)]
    assert np.allclose(fingerprint.likeness(a, b, range(n), range(n)), want)
    assert np.allclose([fingerprint.print_likeness(x, y) for x, y in zip(a.prints, b.prints, strict=True)], want)
    after = [plain_tree_likeness(x, y) for x, y in zip(a.prints, a.prints[1:], strict=False)]
    assert np.allclose(fingerprint.likeness(a, a, range(n - 1), range(1, n)), after)


def test_likeness_does_not_jump_with_length():
    rng = np.random.default_rng(0)
    values = {}
    for size in (60, 63, 64, 65, 66, 70, 200):
        own = []
        for _ in range(100):
            w = [f"w{x}" for x in rng.integers(0, 10**6, size)]
            v = list(w)
            v[size // 2] = "changed"
            a, b = fingerprint.trees(pa.array([" ".join(w), " ".join(v)])).prints
            own.append(fingerprint.print_likeness(a, b))
        values[size] = np.mean(own)
    assert all(0.9 < v < 1 for v in values.values())
    near = [values[k] for k in (60, 63, 64, 65, 66, 70)]
    assert max(near) - min(near) < 0.02
    apart = [[" ".join(f"w{x}" for x in rng.integers(0, 10**9, 64)) for _ in range(2)] for _ in range(200)]
    assert all(fingerprint.print_likeness(*fingerprint.trees(pa.array(p)).prints) == 0 for p in apart)


def test_texts_without_blanks_are_cut_as_well():
    rng = np.random.default_rng(1)
    text = "".join(chr(0x4E00 + x) for x in rng.integers(0, 3_000, 3_000))
    other = "".join(chr(0x4E00 + x) for x in rng.integers(0, 3_000, 3_000))
    a, b, c, d = fingerprint.trees(pa.array([text, text[:2_700] + other[:300], text[:2_000] + other[:1_000], "x" + text])).prints
    assert fingerprint.print_likeness(a, b) > 0.85 and 0.55 < fingerprint.print_likeness(a, c) < 0.75
    assert fingerprint.print_likeness(a, d) > 0.9  # cuts meet again after an insertion
    wide, blank = fingerprint.trees(pa.array(["a" * 100_000, " " * 100_000 + "x"])).prints
    assert min(len(wide), len(blank)) > 100_000 / fingerprint.PIECE_BYTES * 16


def test_prints_do_not_depend_on_neighbours(documents):
    texts = [r.text for r in documents.limit(50).collect()] + ["", "\n", " a", "a ", "a\n", "a"]
    together = fingerprint.trees(pa.array(texts)).prints
    assert together == [fingerprint.trees(pa.array([t])).prints[0] for t in texts]
    assert len(set(together[50:])) == 6


def check_pieces(pieces, texts):
    """``texts`` are (doc_id, text) rows; ids may repeat."""
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    ids = defaultdict(Counter)
    for doc_id, text in texts:
        ids[doc_id][tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    lengths = Counter()
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
        lengths[p.doc_id] += p.length
    assert {i: sum(len(x) * n for x, n in c.items()) for i, c in ids.items()} == dict(lengths)
    for doc_id, own in by_doc.items():
        for p in own:
            assert any(
                len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
                for x in ids[doc_id]
            )
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        total = sum(p.length for p in own)
        assert total <= 1024 and total & (total - 1) == 0


def test_packing_query(spark, sf, documents):
    pieces = QUERIES["op7_hilbert"](spark, sf).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in documents.collect()])
    for doc in defaultdict(list, {p.doc_id: None for p in pieces}):
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]


def test_packing_of_odd_rows(odd, none):
    check_pieces(packing.pack(odd).collect(), [r[:2] for r in ROWS])
    assert packing.pack(none).count() == 0


def test_ids_are_the_tokenizers(documents):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    odd = ["", " ", "a<|endoftext|>b", "日本語 😀‍🚀", " x y", "1234 56,7", "don't  WON'T\r\n\tx", "x" * 5_000, "\u0000"]
    for text in [r.text for r in documents.collect()] + odd:
        assert packing.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for bits in (1, 2, 3):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
        place = packing.hilbert(cells, bits)
        assert sorted(place) == list(range(side**3))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_documents_of_one_language_share_sequences(spark, sf, documents):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    sequences = defaultdict(Counter)
    for p in QUERIES["op7_hilbert"](spark, sf).collect():
        sequences[p.sequence_id][lang[p.doc_id]] += p.length
    main = sum(max(c.values()) for c in sequences.values()) / sum(sum(c.values()) for c in sequences.values())
    whole = Counter()
    for c in sequences.values():
        whole.update(c)
    assert main > 0.85 > max(whole.values()) / sum(whole.values())


def test_mixing_hits_its_weights(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit("same size").alias("text"), F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source")
    )
    out = Counter(r.source for r in mixing.mix(docs, {"hot": 1.0, "s6": 2.0, "s7": 1.0}).collect())
    assert set(out) == {"hot", "s6", "s7"}
    total = sum(out.values())
    assert abs(total - 30_000) < 900
    assert abs(out["hot"] / total - 0.25) < 0.02 and abs(out["s6"] / total - 0.5) < 0.02


def test_mixing_inverts_the_distribution(spark):
    rates = [0.0, 0.3, 1.0, 7.5, 900.0]
    rows = spark.createDataFrame([(r,) for r in rates], "rate double").select("rate", mixing.distribution(F.col("rate")).alias("d")).collect()
    rng = np.random.default_rng(0)
    for r in rows:
        draws = np.searchsorted(r.d, rng.random(20_000), side="right")
        assert abs(draws.mean() - r.rate) < 0.05 * max(1, r.rate**0.5) and abs(draws.var() - r.rate) <= 0.06 * max(r.rate, 1)
        assert r.rate == 0 or 1 - r.d[-1] < 1e-10


def test_mixing_of_odd_rows(odd, none):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    report = mixing.mix(odd, report=True).collect()
    copies = Counter(r.doc_id for r in out.collect())
    assert Counter(r.doc_id for r in report) == copies
    assert [r.shuffle_key for r in report] == sorted(r.shuffle_key for r in report)
    assert mixing.mix(none).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows of each stage, written and read again."""
    docs, rows = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        columns = docs.columns
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        rows[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    return rows


def test_pipeline_stages(stages, spark, sf, documents, labels):
    model = quality.train_quality(documents, labels)
    rows = documents.collect()
    scores = model.score(pa.array([r.text for r in rows]))
    kept = [r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]
    assert Counter(stages["quality"]) == Counter(kept)
    largest = {}
    for r in kept:
        t = r.text.encode().lower()
        largest[t] = max(largest.get(t, r), r, key=lambda x: x.doc_id)
    assert Counter(stages["exact dedup"]) == Counter(largest.values())
    rows = stages["exact dedup"]
    prints = simhash.fingerprints(pa.array([r.text for r in rows]))
    groups, left = 0, set(range(len(rows)))
    smallest = set()
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            k = todo.pop()
            group.add(k)
            close = {j for j in left if int(prints[k] ^ prints[j]).bit_count() <= 4}
            left -= close
            todo += close
        groups += 1
        smallest.add(min(rows[k].doc_id for k in group))
    assert {r.doc_id for r in stages["near dedup"]} == smallest and len(stages["near dedup"]) == groups
    assert {r.doc_id for r in stages["mixing"]} <= smallest
    check_pieces(stages["packing"], [(r.doc_id, r.text) for r in stages["mixing"]])


def test_run_is_the_last_stage(stages, spark, sf):
    names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"]
    out = corpus_pipeline.run(spark, sf).collect()
    assert sum(r.length for r in out) == sum(r.length for r in stages["packing"])
    assert {tuple(r[n] for n in names) for r in out} == {tuple(r[n] for n in names) for r in stages["packing"]}
    assert exact.PREFIX == 64
