import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm.elias_fano import STEPS, EliasFano, Trie


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**64 - 1)), max_size=60), st.lists(st.integers(0, 2**64 - 1), max_size=10))
def test_round_trip_and_successor(tmp_path_factory, values, probes):
    values = sorted(values)
    f = EliasFano(np.array(values, np.uint64), str(tmp_path_factory.mktemp("ef")), "x")
    assert f.get(np.arange(len(values))).tolist() == values
    probes = [*probes, *values, *(v + 1 for v in values if v < 2**64 - 1), 0]
    want = [next((i for i, v in enumerate(values) if v >= p), len(values)) for p in probes]
    assert f.successor(np.array(probes, np.uint64)).tolist() == want


@pytest.mark.parametrize("n", [0, 1, 500])
def test_trie_finds_what_it_holds(n, tmp_path):
    rng = np.random.default_rng(n)
    words = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, max(n, 1), (3 * n, 2))} if n else [])
    pairs = [(a, b) for a, b in pairs if a < len(words) and b < len(words)]
    triples = sorted({(i, int(w)) for i, w in zip(rng.integers(0, max(len(pairs), 1), n), rng.integers(0, max(n, 1), n))}) if n else []
    one, two, three = -rng.random(len(words)) * 9, -rng.random(len(pairs)) * 9, -rng.random(len(triples)) * 9
    column = lambda rows, k: np.array([r[k] for r in rows], np.int64)
    trie = Trie(words, one, [(column(pairs, 0), column(pairs, 1), two), (column(triples, 0), column(triples, 1), three)], str(tmp_path))
    assert trie.word_ids(words).tolist() == list(range(len(words)))
    assert trie.word_ids(np.array([2**63 + 5], np.uint64)).tolist() == [-1]
    for order, rows, logs in ((2, pairs, two), (3, triples, three)):
        place = trie.child(order, column(rows, 0), column(rows, 1))
        assert place.tolist() == list(range(len(rows)))
        assert np.abs(trie.log10(order, place) - logs).max(initial=0) <= 0.5 / STEPS + 1e-9
    every = [(a, b) for a in range(min(len(words), 60)) for b in range(min(len(words), 60))]
    place = trie.child(2, column(every, 0), column(every, 1)) if every else np.zeros(0)
    index = {p: i for i, p in enumerate(pairs)}
    assert place.tolist() == [index.get(p, -1) for p in every]
    assert trie.child(2, np.array([-1]), np.array([0])).tolist() == [-1]
