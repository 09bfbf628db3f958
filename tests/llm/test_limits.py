"""What operators leave on disk and what they cost."""

from pathlib import Path

import numpy as np
import pytest

from tidepath.llm import lmscore, warc
from tidepath.llm.common import shared_dir


def test_warc_leaves_no_copy_of_its_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/", "one"), (2, "http://b.example/", "one"), (3, None, None)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/warc")
    own = Path(shared_dir(spark).removeprefix("file://"), f"tidepath-{spark.sparkContext.applicationId}")
    assert own.is_dir() and not list(own.glob("warc-pages-*"))
    got = {r.page_id: r.refers_to for r in warc.captures_digest(warc.read_warc(spark, f"file://{tmp_path}/warc")).collect()}
    assert got == {1: 2, 2: None, 3: None}


class Watched(np.ndarray):
    """An array that notes along which axes maxima are taken."""

    axes: list = []

    def max(self, axis=None, **more):
        self.axes.append(axis)
        return np.asarray(self).max(axis=axis, **more)


@pytest.mark.parametrize("scale, wanted", [(1, [None]), (100, [1])])
def test_softmax_takes_row_maxima_only_of_large_scores(scale, wanted):
    # they were a fifth of the cost of scoring
    scores = np.random.default_rng(2).uniform(-1, 1, (50, 7)).astype(np.float32) * scale
    want = scores.astype(float)[:, 3] - np.log(np.exp(scores.astype(float)).sum(axis=1))
    watched, Watched.axes = scores.view(Watched), []
    got = lmscore._softmax(watched, np.arange(50), np.full(50, 3))[0]
    assert Watched.axes == wanted and np.allclose(got, want, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("scale", [1, 300])
def test_log_probs_equal_double_precision(scale):
    # with scale 300 exponentials of the scores themselves would overflow
    side, n = 5, 60
    rng = np.random.default_rng(4)
    net = lmscore.Network.fresh(side)
    net.classes *= scale
    net.words *= scale
    around, token = rng.integers(0, side**2 + 1, (n, 2 * lmscore.REACH)), rng.integers(0, side**2, n)
    total = net.bias + sum(net.context[j].astype(float)[around[:, j]] for j in range(2 * lmscore.REACH))
    h = np.hstack([np.tanh(total), np.ones((n, 1))])
    log_softmax = lambda s: s - s.max() - np.log(np.exp(s - s.max()).sum())
    want = [log_softmax(h[i] @ net.classes)[t // side] + log_softmax(h[i] @ net.words[t // side])[t % side] for i, t in enumerate(token)]
    got = net.log_probs(around, token)
    assert np.abs(net.classes).max() > (60 if scale > 1 else 0) and np.allclose(got, want, rtol=1e-4, atol=1e-4)
    net.log_probs(around, token, 1e-3)
    assert all(np.isfinite(x).all() for x in (net.context, net.bias, net.classes, net.words))
