"""Similarity of topics by blocks, and the map of topics."""

import numpy as np
import pytest

from corpusmill.operators import topics as T


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    rows = [(t, f"w{w}", float(rng.random())) for t in range(30) for w in range(50) if rng.random() < 0.4]
    rows += [(t, "everywhere", 0.5) for t in range(30)]
    return spark.createDataFrame(rows, "topic int, word string, score double")


def vectors_of(scores):
    rows = scores.collect()
    words = sorted({r["word"] for r in rows})
    v = np.zeros((30, len(words)))
    for r in rows:
        v[r["topic"], words.index(r["word"])] = r["score"]
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("block", [1, 7, 256])
def test_blocks_of_topics_do_not_matter(scores, block):
    v = vectors_of(scores)
    got = {(r[0], r[1]): r[2] for r in T.topic_similarity(scores, "topic", block).collect()}
    assert set(got) == {(i, j) for i in range(30) for j in range(i + 1, 30)}
    assert all(abs(s - v[i] @ v[j]) < 1e-9 for (i, j), s in got.items())


def sizes_of(spark, count):
    return spark.createDataFrame([(t, 10 * t + 1) for t in range(count)], "topic int, size int")


def test_map_is_classical_scaling(spark, scores):
    v = vectors_of(scores)
    v = v - v.mean(axis=0)
    values, axes = np.linalg.eigh(v @ v.T)
    wanted = axes[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    got = T.topic_map(T.topic_similarity(scores, "topic"), sizes_of(spark, 30), "topic").orderBy("topic").collect()
    points = np.array([[r["x"], r["y"]] for r in got])
    assert [r["size"] for r in got] == [10 * t + 1 for t in range(30)]
    # Equal distances, whatever the signs; the widest coordinates are positive.
    assert np.allclose(np.abs(points), np.abs(wanted), atol=1e-4)
    assert all(points[np.abs(points[:, c]).argmax(), c] > 0 for c in range(2))


def test_distances_of_three_topics_are_exact(spark):
    scores = spark.createDataFrame([(0, "a", 1.0), (1, "a", 1.0), (1, "b", 1.0), (2, "b", 2.0)], "topic int, word string, score double")
    got = T.topic_map(T.topic_similarity(scores, "topic"), sizes_of(spark, 3), "topic").orderBy("topic").collect()
    p = np.array([[r["x"], r["y"]] for r in got])
    for i, j, similarity in ((0, 1, 0.5**0.5), (1, 2, 0.5**0.5), (0, 2, 0.0)):
        assert abs(np.linalg.norm(p[i] - p[j]) - (2 - 2 * similarity) ** 0.5) < 1e-9


def test_no_topics_one_topic_and_topics_without_words(spark):
    none = spark.createDataFrame([], "topic int, word string, score double")
    alike = T.topic_similarity(none, "topic")
    assert T.topic_map(alike, sizes_of(spark, 0), "topic").count() == 0
    assert [(r["x"], r["y"]) for r in T.topic_map(alike, sizes_of(spark, 1), "topic").collect()] == [(0.0, 0.0)]
    nulls = spark.createDataFrame([(None, 3), (1, 4), (2, 5)], "topic int, size int")
    apart = T.topic_map(alike, nulls, "topic").orderBy("topic").collect()
    assert [r["topic"] for r in apart] == [1, 2]
    assert abs(abs(apart[0]["x"] - apart[1]["x"]) - 2**0.5) < 1e-9
