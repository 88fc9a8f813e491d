import numpy as np
import pytest

from impulsar.llm.embedding_dedup import collisions, embedding_near_duplicates, least_count

from .tables import Union


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string, rep string")


@pytest.mark.parametrize(("block_rows", "deeper"), [(1024, (1 << 15,)), (40, (1 << 15,)), (1024, (50,)), (30, (20, 50))])
def test_links_and_components(spark, block_rows, deeper):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        v = rng.normal(size=16)
        if i % 3 == 0 and i:
            v = np.array(rows[i - 3][1]) + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2) if i % 7 else 1, "x", "y"))
    rows += [(300, None, 1, "", ""), (301, [0.0] * 16, 1, "", ""), (302, rows[0][1], None, "", ""), (303, [float("nan")] * 16, 1, "", ""), (304, [None] + rows[0][1][1:], 1, "", ""), (305, [float("inf")] * 16, 1, "", ""), (306, [], 1, "", ""), (307, [1.0], 1, "", ""), (None, rows[0][1], 1, "", ""), (3, rows[3][1], rows[3][2], "", "")]
    sound = [(i, np.array(v, dtype=float), lab) for i, v, lab, *_ in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, union = dict.fromkeys((r[0] for r in rows if r[0] is not None), 0), Union()
    for a in range(len(sound)):
        union.find(sound[a][0])
        if any(sound[a][0] == i and sound[a][2] == lab and np.array_equal(sound[a][1], v) for i, v, lab in sound[:a]):
            continue  # a repeated row
        for b in range(len(sound)):
            (i, x, p), (j, y, q) = sound[a], sound[b]
            if a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i] += 1
                union.join(i, j)
    found = embedding_near_duplicates(table(spark, rows), block_rows=block_rows, deeper=deeper).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["vec_id"] is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[r["vec_id"]], union.find(r["vec_id"]), union.find(r["vec_id"]) == r["vec_id"])
    assert sum(links.values()) > 100
    assert embedding_near_duplicates(table(spark, [])).count() == 0


def test_collisions_are_windows():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 5)), rng.normal(size=(30, 5))
    assert (collisions(a, b, 0.4) == (np.abs(a[:, None] - b[None]) <= 0.4).sum(axis=2)).all()


def test_recall_of_the_count():
    least = least_count(0.93, 64, 0.4, 1e-5)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(2000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y
    lines = rng.normal(size=(64, 64))
    counts = (np.abs(x @ lines - y @ lines) <= 0.4).sum(axis=1)
    assert (counts >= least).mean() > 0.995
