import numpy as np
import pytest

from parcelwise.llm import embedding


@pytest.mark.parametrize("alike", [0.6, 0.85])
def test_pairs_in_a_dense_cone_are_found(session, alike):
    rnd = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axis = unit(rnd.standard_normal(64))
    cone = unit(np.sqrt(alike) * axis + np.sqrt(1 - alike) * unit(rnd.standard_normal((6000, 64))))
    pairs = [(i, 6000 + i) for i in range(300)]
    twins = unit(cone[:300] + 0.31 * unit(rnd.standard_normal((300, 64))))
    rows = [*cone, *twins, *unit(rnd.standard_normal((1000, 64)))]
    units = unit(np.array(rows, np.float32).astype(np.float64))
    expected = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(units @ units.T >= 0.95, 1)), strict=True)}
    assert len(expected & set(pairs)) > 200
    df = session.createDataFrame(
        [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>"
    )
    found = embedding.near_duplicates(df, passes=4, window=16, dense_block=1500).collect()
    component = {r["vec_id"]: r["component_id"] for r in found}
    recall = sum(component[a] == component[b] for a, b in expected) / len(expected)
    print("recall", recall)
    assert recall >= 0.98
    links = np.zeros(len(rows), int)
    for a, b in expected:
        links[[a, b]] += 1
    assert all(r["n_links"] <= links[r["vec_id"]] for r in found)
