"""The toxicity network's filters, pooling and score next to loops over words."""

import numpy as np
import pyarrow as pa

from taleweave.llm import toxicity
from taleweave.llm.toxicity import FILTERS, SLOTS, WIDTHS, Net, read_words


def random_net(rng, embed=5):
    n = len(WIDTHS) * FILTERS
    return Net(
        row=rng.integers(0, 40, SLOTS),
        embedding=rng.normal(size=(40, embed)).astype(np.float32),
        kernels=[rng.normal(size=(width, embed, FILTERS)).astype(np.float32) for width in WIDTHS],
        bias=rng.normal(size=n).astype(np.float32),
        out=rng.normal(size=n + 1).astype(np.float32),
        slope=1.3,
        offset=rng.normal(size=len(toxicity.LANGUAGES) + 1),
        empty=0.2,
    )


def plain_logits(net, words):
    out = []
    for a, b in zip(words.begin[:-1], words.begin[1:], strict=True):
        vectors = [sum(net.embedding[net.row[words.slots[s, i]]].astype(float) for s in range(3)) for i in range(a, b)]
        pooled = []
        for k, width in enumerate(WIDTHS):
            for f in range(FILTERS):
                top = 0.0  # a text without words, or with negative responses only
                for i in range(len(vectors)):
                    taps = [vectors[i + j] @ net.kernels[k][j][:, f] for j in range(width) if i + j < len(vectors)]
                    top = max(top, sum(taps) + net.bias[k * FILTERS + f])
                pooled.append(top)
        out.append(float(np.dot(pooled, net.out[:-1]) + net.out[-1]))
    return np.array(out)


def test_filters_and_pooling_are_the_plain_ones(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 99, n)) for n in (1, 2, 3, 7, 30, 0, 5)] + ["", "One", "é ß"]
    words = read_words(pa.array(texts))
    net = random_net(rng)
    want = plain_logits(net, words)
    assert np.allclose(net.logits(words), want, atol=1e-3)
    monkeypatch.setattr(toxicity, "_CHUNK", 4)  # a text goes over several chunks
    assert np.allclose(net.logits(words), want, atol=1e-3)
    net.project()
    assert np.allclose(net.logits(words), want, atol=1e-3)
    p = 1 / (1 + np.exp(-(net.slope * want + net.offset[toxicity.language_of(words)])))
    p[np.diff(words.begin) == 0] = net.empty
    assert np.allclose(net.score(pa.array(texts)), p, atol=1e-3)
