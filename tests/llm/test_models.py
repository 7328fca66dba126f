"""The learned operators against plain loops, and what they reach on rows that they never saw."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opsloom.llm import language_mix, quality_knn, queries, toxicity_cnn
from opsloom.llm.textarrow import text_blocks

SF = "/root/testdata/sf0.01"
RNG = np.random.default_rng(8)


def texts_of(spark, n):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()]


def block_of(texts):
    return next(text_blocks(pa.array(texts, pa.string()), 1 << 40))


def test_votes_like_one_by_one(spark):
    """Scores through Spark are those of a loop over all labelled rows, with ties all voting."""
    texts = texts_of(spark, 120) + ["", None, "junk junk junk", "junk junk junk"]
    labels = [float(i % 3 > 0) for i in range(len(texts))]
    learn = spark.createDataFrame([(t, y) for t, y in zip(texts[:90], labels[:90], strict=True)] + [(texts[3], 0.0), (texts[3], 1.0)], "text string, label double").repartition(3)
    model = quality_knn.learn_neighbours(learn)
    got = {r.i: r.q for r in quality_knn.score_quality(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4), model, score_col="q").collect()}
    for i, t in enumerate(texts):
        v = quality_knn.latent(quality_knn.term_counts(block_of([t])), model.weights, model.axes)[0]
        near = sorted(((float(v @ w), y) for w, y in zip(model.vectors, model.labels, strict=True)), reverse=True)
        least = near[quality_knn.NEIGHBOURS - 1][0]
        voters = [(max(c, 0.0) ** quality_knn.POWER, y) for c, y in near if c >= least - quality_knn.TIE]
        total = sum(w for w, _ in voters)
        want = sum(w * y for w, y in voters) / total if total > 1e-9 else model.prior
        assert abs(got[i] - min(1.0, max(0.0, want))) < 1e-4, i


def test_words_tell_quality_where_shapes_are_alike(spark):
    """Texts of one shape whose words differ get different scores."""
    good, bad = ["river", "stone", "light", "field"], ["spamm", "winnn", "click", "cashh"]
    rows = [(" ".join(RNG.choice(w, 30)), y) for w, y in ((good, 1.0), (bad, 0.0)) for _ in range(60)]
    model = quality_knn.learn_neighbours(spark.createDataFrame(rows, "text string, label double"))
    held = [(0, " ".join(RNG.choice(good, 30))), (1, " ".join(RNG.choice(bad, 30)))]
    q = {r.i: r.quality_score for r in quality_knn.score_quality(spark.createDataFrame(held, "i int, text string"), model).collect()}
    assert q[0] > 0.8 and q[1] < 0.2


def test_mixtures_like_one_by_one(spark):
    """Proportions and the penalised choice of languages, document by document and cell by cell."""
    chances = RNG.random((language_mix.CELLS, 4))
    chances /= chances.sum(0)
    texts = [t for t in texts_of(spark, 25) if t] + ["ab", "abc abd"]
    text, cell, n = language_mix.cell_counts(block_of(texts))
    got = language_mix.mixtures(text, cell, n, len(texts), chances)

    def fit(cells, allowed):
        theta = {k: 1 / len(allowed) for k in allowed}
        for _ in range(language_mix.STEPS):
            new = dict.fromkeys(allowed, 0.0)
            for c, k in cells.items():
                joint = {a: theta[a] * chances[c, a] for a in allowed}
                for a in allowed:
                    new[a] += k * joint[a] / sum(joint.values())
            theta = {a: v / sum(cells.values()) for a, v in new.items()}
        return theta, sum(k * math.log(sum(theta[a] * chances[c, a] for a in allowed)) for c, k in cells.items())

    for d in range(len(texts)):
        cells = {int(c): int(k) for t, c, k in zip(text, cell, n, strict=True) if t == d}
        if not cells:
            assert not got[d].any()
            continue
        allowed = list(range(4))
        best, like = fit(cells, allowed)
        while len(allowed) > 1:
            top = max(allowed, key=lambda a: best[a])
            gone = {a for a in allowed if best[a] < 1e-3} | {min(allowed, key=lambda a: best[a])}
            gone -= {top}
            theta, now = fit(cells, [a for a in allowed if a not in gone])
            if now + language_mix.PENALTY * math.log(sum(cells.values())) * len(gone) < like:
                break
            allowed, best, like = [a for a in allowed if a not in gone], theta, now
        assert np.allclose(got[d], [best.get(a, 0.0) for a in range(4)], atol=1e-6), d


def test_convolution_like_one_by_one(spark):
    """Pooled responses of a net with random weights, filter by filter and place by place."""
    f = [RNG.normal(size=(w, toxicity_cnn.DIM, toxicity_cnn.FILTERS)).astype(np.float32) for w in toxicity_cnn.WIDTHS]
    wide = len(toxicity_cnn.WIDTHS) * toxicity_cnn.FILTERS
    net = toxicity_cnn.Net(RNG.normal(size=(toxicity_cnn.ROWS, toxicity_cnn.DIM)).astype(np.float32), RNG.normal(size=(toxicity_cnn.ROWS, toxicity_cnn.DIM)).astype(np.float32), f, RNG.normal(size=wide).astype(np.float32), RNG.normal(size=wide).astype(np.float32), 0.3, np.zeros(len(toxicity_cnn.NAMES)), 1.0)
    word, prefix, bounds = toxicity_cnn.word_rows(block_of(["one two three four", "", "Five", None, "!!!", "a b"]))
    got = toxicity_cnn.pooled(net, toxicity_cnn.lay(net, word, prefix, bounds))
    for t, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        x = [net.word[i] + net.prefix[j] for i, j in zip(word[a:b], prefix[a:b], strict=True)]
        want = np.zeros(wide)
        for k, width in enumerate(toxicity_cnn.WIDTHS):
            for j in range(toxicity_cnn.FILTERS):
                at = [sum(float(x[p + q] @ f[k][q][:, j]) for q in range(width) if p + q < len(x)) for p in range(len(x))]
                col = k * toxicity_cnn.FILTERS + j
                want[col] = max(0.0, max(at) + float(net.bias[col])) if at else 0.0
        assert np.allclose(got[t], want, atol=1e-3)


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality_classifier", "quality", 0.85), ("op5_toxicity", "toxic", 0.7)])
def test_balanced_on_held_out_labels(spark, name, label, least):
    """Mean of the shares of either class that are found; a constant reaches a half."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.col(label).isNotNull())
    j = queries.queries()[name](spark, SF).where("held_out").join(labels, "doc_id").collect()
    found = [sum(r.predicted == y for r in j if r[label] == y) / sum(r[label] == y for r in j) for y in (0, 1)]
    assert sum(found) / 2 >= least
