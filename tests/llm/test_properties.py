"""Properties on arbitrary inputs; no Spark."""

from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import crosssplit, mixing, neardup, packing, words
from quillstone.llm.fmindex import FMIndex
from quillstone.llm.residue import ResidueDetector, clean, level

DETECTOR = ResidueDetector()
WORD_SETS = st.lists(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=12), min_size=1, max_size=20)


@given(st.text(max_size=300))
@settings(max_examples=300, deadline=None)
def test_any_text_has_kinds_and_a_coverage(text):
    kinds, coverage = DETECTOR.cases(text)
    assert set(kinds) <= {"filler", "error", "script", "template"} and 0 <= coverage <= 1
    flat, breaks = level(clean(text))
    assert "\n" not in flat and all(flat[b] == " " for b in breaks)


@given(st.text(alphabet="{}[]<>%#$@_«»„“ aAbB1\n.", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(text):
    DETECTOR.cases(text)


@given(st.lists(st.integers(1, 50), max_size=40), st.integers(50, 60))
@settings(max_examples=200, deadline=None)
def test_packings_are_whole_and_within_capacity(sizes, capacity):
    bins = packing.bin_completion(sizes, capacity, 200)
    assert sorted(x for b in bins for x in b) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
    assert packing.lower_bound(sizes, capacity) <= len(bins) <= len(packing.best_fit_decreasing(sizes, capacity)) if sizes else not bins


@given(WORD_SETS)
@settings(max_examples=100, deadline=None)
def test_sketches_never_differ_more_than_sets(sets):
    flat, starts = words.flatten([np.array(sorted(s), np.int64) for s in sets])
    bits = neardup.sketches(flat, starts)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert (bits[i] != bits[j]).sum() <= len(a ^ b)


@given(WORD_SETS)
@settings(max_examples=100, deadline=None)
def test_overlaps_are_exact(sets):
    flat, starts = words.flatten([np.array(sorted(s), np.int64) for s in sets])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    assert words.overlaps(flat, starts, i, j).tolist() == [len(sets[a] & sets[b]) for a, b in zip(i, j)]


@given(st.lists(st.lists(st.integers(0, 3), max_size=8), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_backward_search_counts_occurrences(docs, pattern):
    flat, starts = words.flatten([np.array(d, np.int64) for d in docs])
    fm = FMIndex.build(flat.astype(np.int64), starts)
    s = fm.symbols(np.array(pattern, np.int64))
    lo, hi = fm.start(s[-1:])
    for c in s[-2::-1]:
        lo, hi = fm.extend(np.array([c]), lo, hi)
    want = sum(d[k : k + len(pattern)] == pattern for d in docs for k in range(len(d)))
    assert hi[0] - lo[0] == want


@given(st.lists(st.floats(0, 1), min_size=1, max_size=6), st.floats(0, 2))
@settings(max_examples=200, deadline=None)
def test_tempered_shares_sum_to_one(raw, exponent):
    total = sum(raw)
    shares = [r / total for r in raw] if total > 1e-9 else raw
    t = mixing.tempered(shares, exponent)
    assert all(x >= 0 for x in t) and (abs(sum(t) - 1) < 1e-6 or not sum(t))


@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 1000), max_size=6), st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0, 1), st.integers(0, 5)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_mixtures_keep_repetitions_and_budget(sizes, targets):
    given_tokens = mixing.fit_weights(sizes, targets)
    assert set(given_tokens) == set(targets)
    for n, g in given_tokens.items():
        assert -1e-6 <= g <= sizes.get(n, 0) * targets[n][1] + 1e-6
    assert sum(given_tokens.values()) <= sum(sizes.get(n, 0) for n in targets) * (1 + 1e-9) + 1e-6


@given(st.integers(1, 400))
def test_ceil_share(n):
    t = Fraction(7, 10)
    assert words.ceil_share(t, np.array([n]))[0] == -(-7 * n // 10)


@given(WORD_SETS, st.lists(st.sets(st.integers(-4, 8), min_size=1, max_size=12), min_size=1, max_size=20), st.sampled_from(["0.3", "0.5", "0.7", "0.9", "1"]))
@settings(max_examples=100, deadline=None)
def test_the_filter_of_triples_passes_every_similar_set(others, sets, threshold):
    t, known = Fraction(threshold), (np.arange(-2, 3), np.arange(5) + 1)
    lists = lambda some: words.flatten([np.array(sorted(s), np.int64) for s in some])
    (e, e_starts), (a, a_starts) = lists([*sets, *others]), lists(sets[::-1] + [s | {100} for s in sets])
    bits = crosssplit.triple_filter(words.rare_first(e, e_starts, *known), e_starts, t)
    keys, of, large = crosssplit.lookup_keys(words.rare_first(a, a_starts, *known), a_starts, t)
    passed = set(of[bits.has(keys)]) | set(large)
    for i, x in enumerate(sets[::-1] + [s | {100} for s in sets]):
        if any(len(x & y) >= t * len(x | y) for y in [*sets, *others]):
            assert i in passed


def test_few_unlike_sets_pass_the_filter_of_triples():
    rng, t = np.random.default_rng(4), Fraction("0.7")
    starts = np.arange(0, 2000 * 15 + 1, 15)
    some, unlike = rng.integers(0, 2**60, 30000), rng.integers(0, 2**60, 30000)
    keys, of, large = crosssplit.lookup_keys(unlike, starts, t)
    assert not len(large) and len(set(of[crosssplit.triple_filter(some, starts, t).has(keys)])) < 100
    assert len(set(crosssplit.lookup_keys(some, starts, t)[1])) == 2000
