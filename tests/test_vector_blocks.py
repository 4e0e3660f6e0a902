"""What exact searches hold and pass on is bounded, whatever the number of queries and rows."""

import numpy as np
import pandas as pd

from quarry.operators import vector_index


def test_an_exhaustive_search_passes_on_k_rows_a_block():
    """Equal vectors have equal scores, ties go to the smaller key."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 6))
    rows[400:] = rows[7]
    rows /= np.sqrt((rows * rows).sum(axis=1))[:, None]
    queries = pd.DataFrame({"query_id": range(300), "asked": list(rows[:300]), "cell": 0, "block": 0})
    held = pd.DataFrame({"cell": 0, "block": 0, "key": range(500), "vector": list(rows)}).sample(frac=1, random_state=1)
    got = vector_index._scored_exactly(3)(queries, held)
    assert len(got) == 300 * 3
    assert got[got["query_id"] == 7].sort_values(["near", "key"], ascending=[False, True])["key"].tolist() == [7, 400, 401]
    assert len(vector_index._scored_exactly(3)(queries.iloc[:0], held)) == 0 and len(vector_index._scored_exactly(3)(queries, held.iloc[:0])) == 0


def test_ground_truth_holds_the_scores_of_a_few_queries(monkeypatch):
    rng, shapes, best = np.random.default_rng(4), [], vector_index._best
    monkeypatch.setattr(vector_index, "_best", lambda ids, keys, scores, k, cells: shapes.append(scores.shape) or best(ids, keys, scores, k, cells))
    asked, rows = rng.normal(size=(700, 4)), rng.normal(size=(50, 4))
    got = pd.concat(vector_index._blocks(np.arange(700), asked, np.arange(50), rows.T, 2, np.zeros(50, np.int32)))
    assert max(s[0] for s in shapes) <= vector_index.ASKED and sum(s[0] for s in shapes) == 700
    assert got.groupby("query_id")["near"].max().tolist() == (asked @ rows.T).max(axis=1).tolist() or np.allclose(got.groupby("query_id")["near"].max(), (asked @ rows.T).max(axis=1))
