"""The training-data operators do the whole job: no step, character or row is left out."""

from collections import Counter

import numpy as np

from codelake.llm.classifier import PIECE, Ftrl, FtrlConfig, _Words, features
from codelake.llm.url_filter import Rule, url_filter


def links(*hosts):
    return "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)


def test_distrust_arrives_however_far_and_small(spark):
    far = [(i, f"http://far{i}/x", links(f"far{i + 1}" if i < 17 else "bad")) for i in range(18)]  # 18 links from the first to the blocked host
    thin = [(100 + i, f"http://thin{i}/x", links(*["sink"] * 3000, f"thin{i - 1}" if i else "bad")) for i in range(3)] + [(200 + i, f"http://wide{i}/x", links(f"thin{i - 1}" if i else "bad")) for i in range(3)]
    loop = [(300, "http://good/a", links("loop")), (301, "http://loop/x", links("good"))]
    pages = spark.createDataFrame([*far, *thin, *loop, (400, "http://bad/a", ""), (401, "http://sink/x", "")], "page_id long, url string, html string")
    got = {r.host: r for r in url_filter(pages, (Rule("allow", "good", "/a"), Rule("block", "bad", "/a"))).collect()}
    assert all(got[h].verdict == "block" for h in [f"far{i}" for i in range(18)] + [f"thin{i}" for i in range(3)])
    assert got["thin2"].distrust == 0 and got["sink"].verdict == "allow"  # given out in nine places
    assert abs(got["good"].trust - 0.15 / (1 - 0.85**2)) < 1e-8 and abs(got["loop"].trust - 0.15 * 0.85 / (1 - 0.85**2)) < 1e-8


def test_shapes_are_of_whole_words():
    start = "x" * PIECE
    shapes = lambda text: _Words().of(text)[1].tolist()
    assert shapes(f"a {start} b") == shapes("a") + shapes(start) + shapes("b")
    assert shapes(start + "12AB" * 100) == shapes(start) + shapes("12AB" * 16) * 6 + shapes("12AB" * 4)
    assert len(_Words().of(start * 3)[0]) == 1
    # Texts of one new word each tell good from bad behind its first characters.
    config = FtrlConfig(bits=12)
    texts = {k: [start + f"{i:06d}" * 40 + ("AB-" if k else "ab_") * 40 for i in range(30)] for k in (0, 1)}
    model = Ftrl(config)
    for i in range(20):
        for k in (0, 1):
            at, n = np.unique(features(_Words(), texts[k][i], 12), return_counts=True)
            model.learn(at.astype(np.int64), n * (config.scale / n.sum()), k)
    w = model.all_weights()
    score = lambda t: w[features(_Words(), t, 12)].mean()
    assert all(score(a) < score(b) for a in texts[0][20:] for b in texts[1][20:])


def test_pipeline_takes_rows_one_by_one(spark, tmp_path):
    import corpus_pipeline as pipeline

    good = [(i, " ".join(f"w{(i * 37 + j * j) % 911}" for j in range(60))) for i in range(120)]
    bad = [(200 + i, " ".join(f"W{(i * 31 + j) % 97}!!" for j in range(40))) for i in range(60)]
    spark.createDataFrame([(i, int(i < 200)) for i, _ in good + bad[:-1]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = lambda stage, rows: Counter((r.doc_id, r.text) for r in stage(spark, frame(rows), str(tmp_path)).collect())
    # A bad text without an id goes, a good one under a bad one's id stays.
    assert left(pipeline.quality, [*good, *bad, (None, bad[0][1]), (259, good[0][1]), (None, good[1][1])]) == Counter([*good, (259, good[0][1]), (None, good[1][1])])
    a, b, c = (t for _, t in good[:3])
    assert left(pipeline.exact, [(None, a), (None, a), (None, b), (1, b), (2, c), (2, c), (2, "x")]) == Counter([(None, a), (1, b), (2, c), (2, "x")])
    # An unrelated text under a near copy's id stays; of near copies under one id, or without any, one stays.
    assert left(pipeline.near, [(1, a), (2, a + " tail"), (2, b), (None, a + " end"), (3, c), (3, c + " tail"), (None, "q r"), (4, "")]).keys() - {(3, c), (3, c + " tail")} == {(1, a), (2, b), (None, "q r"), (4, "")}
    assert sum(left(pipeline.near, [(3, c), (3, c + " tail"), (3, c + " end")]).values()) == 1
