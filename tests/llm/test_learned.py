"""Scores on held-out rows, and the numpy models next to plain ones."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taleweave.llm import extraction, pii, quality, toxicity
from taleweave.llm.common import Adam, Sample, word_hashes
from taleweave.llm.dom import parse
from taleweave.llm.queries import QUERIES

from .conftest import ROWS


def auc(scores, y):
    order = np.argsort(scores)
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    ones = y == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / ones.sum() / (~ones).sum()


def held_out_rows(spark, sf, name, label):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = QUERIES[name](spark, sf).join(labels, "doc_id").toPandas()
    own = [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]
    assert rows.held_out.tolist() == own and rows.score.between(0, 1).all()
    return rows[rows.held_out]


@pytest.mark.parametrize("sf01", ["/root/testdata/sf0.01"])
def test_quality_on_held_out_rows(spark, sf01):
    rows = held_out_rows(spark, sf01, "op1_quality", "quality")
    assert auc(rows.score.values, rows.y.values) > 0.97
    assert ((rows.score >= 0.3).astype(int) == rows.predicted).all()
    assert rows[rows.y == 1].predicted.mean() > 0.97  # clean documents stay


@pytest.mark.parametrize("sf01", ["/root/testdata/sf0.1"])
def test_toxicity_on_held_out_rows(spark, sf01):
    rows = held_out_rows(spark, sf01, "op2_toxicity", "toxic")
    assert auc(rows.score.values, rows.y.values) > 0.95
    assert (rows[rows.y == 0].predicted == 0).mean() > 0.97


def test_scores_of_odd_rows(spark, odd, none, labels, no_labels, documents):
    models = [
        (quality.quality_score(quality.train_quality(documents, labels))),
        (toxicity.toxicity_score(toxicity.train_toxicity(documents, labels))),
        (quality.quality_score(quality.train_quality(none, no_labels))),
        (toxicity.toxicity_score(toxicity.train_toxicity(none, no_labels))),
    ]
    for score in models:
        rows = odd.select("doc_id", "text", score.alias("s")).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.s <= 1 for r in rows)
        equal = {}
        for r in rows:
            equal.setdefault(r.text or "", set()).add(r.s)
        assert all(len(s) == 1 for s in equal.values())
        assert none.select(score.alias("s")).count() == 0


def test_forward_backward_is_the_sum_over_labellings():
    rng = np.random.default_rng(0)
    unary, begin, stay = rng.normal(size=9), np.array([0, 4, 4, 9]), np.array([0.7, -0.4])
    ahead, behind = quality.forward_backward(unary, begin, stay)
    for a, b in itertools.pairwise(begin):
        if a == b:
            continue
        weight = np.zeros((b - a, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            gain = sum(u for u, v in zip(unary[a:b], y, strict=True) if v)
            gain += sum(stay[p] for p, q in itertools.pairwise(y) if p == q)
            for t, v in enumerate(y):
                weight[t, v] += np.exp(gain)
        assert np.allclose((ahead + behind)[a:b], np.log(weight[:, 1] / weight[:, 0]))


def test_scores_do_not_depend_on_slices(documents, labels):
    texts = pa.array([r.text for r in documents.collect()] + ["", None, "x\n" * 5_000])
    net = quality.train_quality(documents, labels)
    alone = np.concatenate([net.score(texts.slice(i, 1)) for i in range(len(texts))])
    assert np.array_equal(net.score(texts), alone)
    net = toxicity.train_toxicity(documents, labels).value
    alone = np.concatenate([net.score(texts.slice(i, 1)) for i in range(len(texts))])
    assert np.array_equal(net.score(texts), alone)


def test_widest_filter_finds_its_words_wherever_they_stand():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for k in range(300):
        words = list(rng.choice(vocabulary, 400))
        y.append(k % 2)
        if k % 2:
            words.insert(int(rng.integers(400)), "rotten fish")
        texts.append(" ".join(words))
    net = toxicity.fit(Sample(pa.array(texts), np.array(y), np.ones(len(y))))
    long = " ".join(rng.choice(vocabulary, 100_000))
    scores = net.score(pa.array([long, f"{long} rotten fish", f"Rotten FISH {long}"]))
    assert scores[0] < 0.5 < scores[1] and scores[2] > 0.5


def test_word_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"one two one", np.uint8)
    a = word_hashes(data, np.array([0, 4, 8]), np.array([3, 7, 11]))[0]
    b = word_hashes(data[8:], np.array([0]), np.array([3]))[0]
    assert a[0] == a[2] == b[0] != a[1]


def test_tree_messages_are_the_sum_over_labellings():
    rng = np.random.default_rng(2)
    parent = np.array([-1, 0, 0, 1, 1, -1, 5])
    depth = np.array([0, 1, 1, 2, 2, 0, 1])
    none = np.zeros(0, np.int64)
    f = extraction.Forest(parent, depth, np.zeros(7, np.int64), none, none, np.array([0, 5, 7]))
    unary, ties = rng.normal(size=7), rng.normal(size=(7, 4))
    below, _, down = extraction.messages(f, unary, ties)
    weight = np.zeros((7, 2))
    for y in itertools.product((0, 1), repeat=7):
        gain = sum(u for u, v in zip(unary, y, strict=True) if v)
        gain += sum(ties[k][2 * y[p] + y[k]] for k, p in enumerate(parent) if p >= 0)
        for k, v in enumerate(y):
            weight[k, v] += np.exp(gain)
    assert np.allclose(below + down, np.log(weight[:, 1] / weight[:, 0]))


def test_parse_closes_elements_as_browsers_do():
    page = parse("<title>no</title><p>a<p>b &amp;\n c<ul><li>d<li>e<b>f</b>g</ul><script>'<p>x'</script>h<!-- <p>i -->j&nbsp;k")
    assert [t for _, t in page.blocks] == ["a", "b & c", "d", "efg", "hj k"]
    assert [page.tag[n] for n, _ in page.blocks] == ["p", "p", "li", "li", "body"]
    assert parse("").blocks == [] and parse("< <> <p").blocks == [(0, "< <>")]
    assert [t for _, t in parse("<div>" * 3_000 + "deep").blocks] == ["deep"]


@pytest.fixture(scope="module")
def extractor(spark, sf):
    return extraction.train_extraction(spark.read.parquet(f"{sf}/pages.parquet"))


def test_extraction_of_other_structures(extractor):
    sentence = "This is a sentence of the main text with a fair number of words in it."
    page = f"""<body><div id="header"><a href="/">Home</a> <a href="/x">News</a></div><div class="sidebar"><ul><li><a href="/a">One</a></li>
      <li><a href="/b">Two</a></li></ul></div><div class="cookie-notice"><p>We use cookies.</p></div><main><h1>A title</h1><p>{sentence}</p>
      <aside><a href="/r">Related</a></aside><p>{sentence}&lt;</p></main><section id="comments"><div class="comment"><p>First!</p></div></section>
      <form><label>Mail</label></form><footer>&copy; us</footer></body>"""
    assert extractor.texts([page]) == [f"A title\n{sentence}\n{sentence}<"]


def test_extraction_query_matches_articles(spark, sf):
    rows = QUERIES["op6_tree_model"](spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        page = parse(pages[r.page_id])
        inside = [False] * len(page.tag)
        for k, tag in enumerate(page.tag):
            inside[k] = tag == "article" or (page.parent[k] >= 0 and inside[page.parent[k]])
        assert r.text == "\n".join(t for n, t in page.blocks if inside[n]) and r.n_chars == len(r.text)


PROSE = [
    "The river rose over night and took the lower bridge with it, as it had done ten years before.",
    "Nobody was hurt. The mayor said on Monday that a new one would be built before the summer, at twice the height.",
    "Until then the ferry runs every half an hour, and school begins at nine.",
]
HEAD = "Bridge lost in the flood"
NAV = '<nav><a href="/a">Home</a> <a href="/b">Sport</a></nav>'
FOOT = '<footer>&copy; 2020 The paper. <a href="/c">Contact</a></footer>'
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in PROSE)
STRUCTURES = {
    "bare body": f"<body>{NAV}<h1>{HEAD}</h1>{PARAGRAPHS}{FOOT}</body>",
    "nameless divs": f"<body><div><div>{NAV}</div><div><div><h1>{HEAD}</h1>{PARAGRAPHS}</div></div>{FOOT}</div></body>",
    "table cell": f"<body>{NAV}<table><tr><td><h1>{HEAD}</h1>{PARAGRAPHS}</td></tr></table>{FOOT}</body>",
    "button in article": f"<body>{NAV}<article><h1>{HEAD}</h1><button>Share</button>{PARAGRAPHS}</article>{FOOT}</body>",
    "form in article": f"<body>{NAV}<article><h1>{HEAD}</h1>{PARAGRAPHS}<form><label>Your mail</label><p>Write to us every day of the week.</p></form></article>{FOOT}</body>",
    "comments": f'<body>{NAV}<main><h1>{HEAD}</h1>{PARAGRAPHS}</main><section id="reader-comments"><div class="comment">I saw it fall, it was terrible to watch.</div></section>{FOOT}</body>',
    "named div": f'<body>{NAV}<div class="post-body"><h1>{HEAD}</h1>{PARAGRAPHS}</div><div class="sidebar"><p>Also read this other piece of ours.</p></div>{FOOT}</body>',
}


@pytest.mark.parametrize("kind", sorted(STRUCTURES))
def test_main_text_of_structures_without_an_article_tag(extractor, kind):
    assert extractor.texts([STRUCTURES[kind]]) == ["\n".join([HEAD, *PROSE])]


def test_pages_without_any_article_are_learned_from(spark, sf):
    """The same table with its article tags renamed: the labels come from where the prose is."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    renamed = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article", "<div"), "</article", "</div"))
    model = extraction.train_extraction(renamed)
    want = {r.page_id: r.text for r in extraction.extract(pages, extraction.train_extraction(pages)).collect()}
    got = {r.page_id: r.text for r in extraction.extract(renamed, model).collect()}
    assert np.mean([got[i] == want[i] for i in want]) > 0.95
    blank = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert extraction.extract(blank, extraction.train_extraction(blank)).first().text == ""


def test_very_long_pages_and_other_columns(spark, extractor):
    rows = [(1, "u", f"<body>{NAV}<article>{PARAGRAPHS * 20_000}</article></body>", "x"), (1, "u", None, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extraction.extract(pages, extractor).collect()
    assert sorted(r.text for r in out) == ["", "\n".join(PROSE * 20_000)] and all(r.n_chars == len(r.text) for r in out)


def test_extraction_of_odd_pages(spark, extractor):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>t", "x"), (3, "u", "plain", "x"), (3, "u", "plain", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extraction.extract(pages, extractor).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out)[:3] == [(0, 1), (1, 0), (2, 0)] and len(out) == 5
    empty = pages.limit(0)
    assert extraction.extract(empty, extraction.train_extraction(empty)).count() == 0


def test_tagger_gradients(monkeypatch):
    """The steps taken lower the loss that brute force computes over all tag sequences of a short window."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 128, (6, 4)).astype(np.int16)
    y = np.array([[0, 1, 2, 0], [3, 4, 4, 0], [0, 0, 0, 0], [5, 6, 0, 7], [0, 7, 8, 8], [1, 0, 0, 3]])

    def loss(net):
        e, moves, total = net.emissions(x), net.moves + pii._CLOSED, 0
        score = lambda e, t: e[0][t[0]] + pii._START[t[0]] + sum(moves[a][b] + e[k + 1][b] for k, (a, b) in enumerate(itertools.pairwise(t)))
        for row, tags in zip(e, y, strict=True):
            all_scores = [score(row, t) for t in itertools.product(range(pii.TAGS), repeat=4)]
            total += np.logaddexp.reduce(all_scores) - score(row, tags)
        return total

    before, after = pii.fit(x, y, epochs=1, batch=6), pii.fit(x, y, epochs=150, batch=6)
    assert loss(after) < 0.2 * loss(before)
    assert (after.decode(x) == y).mean() > 0.9


def test_base_patterns_are_the_plain_ones():
    import re

    plain = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    rng = np.random.default_rng(8)
    pieces = list("a1 2.@-+()3x\n") + ["1.2.3.4", "a@b.c", "4111 1111-1111 1111", "+1 (234) 567-8901", "@@", "..", "300.1.1.1"]
    texts = ["".join(pieces[i] for i in rng.integers(0, len(pieces), 12)) for _ in range(20_000)]
    for text in texts:
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(plain) for m in re.finditer(p, text))
        assert [c[:3] for c in pii.candidates(text)] == want
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.holds("ip", "0255.1.1.1") and not pii.holds("ip", "256.1.1.1")
    assert len(pii.candidates("1" * 200_000)) == 1 and pii.candidates("1." * 100_000)


def test_pii_adds_numbers_that_run_together(spark, tagger):
    model = tagger
    text = "of the 4111111111111111 5500005555555559 and the mail is a.b@mail.example.com here"
    rows = [(1, text, 0), (2, None, 1), (3, "clean text only", 1), (4, "the 1234567890123456 is", 1)]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans int"), model).collect()}
    assert out[1].spans == "card:7:23,card:24:40,email:57:77" and out[1].n_card == 0 and out[1].n_email == 1
    assert [out[k].spans for k in (2, 3, 4)] == ["", "", ""]


def test_pii_of_odd_rows(odd, none):
    assert pii.train_pii(none).value is None
    rows = pii.find_pii(odd, pii.train_pii(odd)).collect()
    assert len(rows) == len(ROWS) and all(r.spans == "" for r in rows)
    assert pii.find_pii(none, pii.train_pii(none)).count() == 0


def test_adam_goes_down():
    p = np.array([3.0, -2.0])
    adam = Adam([p], 0.1)
    for _ in range(200):
        adam.step([2 * p])
    assert np.abs(p).max() < 0.05


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train_pii(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_tagger_finds_rewritten_spans_and_leaves_other_numbers_alone(spark, tagger):
    """Spans drawn with another seed, planted in texts that hold none: recall, and false spans among unrelated numbers."""
    rng = np.random.default_rng(99)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 3 = 1").select("text").collect()
    clean = [r.text for r in docs if not pii._TRIGGER.search(r.text) and 200 < len(r.text) < 3_000][:500]
    rows, where = [], {}
    for i, t in enumerate(clean):
        cut = t.find(" ", int(rng.integers(len(t) // 2))) + 1
        if i % 2:
            rows.append((i, f"{t[:cut]}{pii.unrelated(rng)} {t[cut:]}"))
            continue
        k = int(rng.integers(5))
        value = pii.secret(rng) if k == pii.BASE else pii.rewritten(rng, pii.drawn(rng, k), k)
        rows.append((i, f"{t[:cut]}{value} {t[cut:]}"))
        where[i] = (pii.KINDS[k], cut, cut + len(value))
    found, false = 0, 0
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), tagger).collect():
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
        if r.doc_id in where:
            kind, a, b = where[r.doc_id]
            found += any(s[0] == kind and min(s[2], b) - max(s[1], a) >= 0.8 * (b - a) for s in spans)
        else:
            false += r.n_added
    assert found / len(where) > 0.8 and false <= 0.02 * len(clean)


def test_base_spans_stay_whatever_the_tagger_adds(spark, tagger):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.find_pii(documents, tagger).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    added = 0
    for r in rows:
        base = [c[:3] for c in pii.candidates(texts[r.doc_id]) if c[3]]
        spans = set(r.spans.split(",")) - {""}
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base} <= spans and len(spans) == len(base) + r.n_added
        added += r.n_added
    assert added > 0
