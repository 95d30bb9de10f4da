"""Properties that hold for any input, tried on many."""

import math
import unicodedata
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm.mixing import _segments
from knotwork.llm.packing import plan_containers
from knotwork.llm.textforms import full_form, visual_form


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 400).flatmap(lambda cap: st.tuples(st.just(cap), st.dictionaries(st.integers(1, cap), st.integers(1, 10**6), max_size=40))))
def test_plans_hold_every_item(case):
    capacity, histogram = case
    used = Counter()
    for bundle in plan_containers(histogram, capacity):
        assert 0 < bundle.size <= capacity and bundle.count > 0
        for size, m in bundle.holds.items():
            used[size] += m * bundle.count
    assert used == Counter(histogram)


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=60))
def test_forms_settle(text):
    for form in (visual_form, full_form):
        once = form(text)
        assert form(once) == once and unicodedata.is_normalized("NFC", once) and once == once.strip() and "  " not in once


@settings(deadline=None, max_examples=200)
@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=30))
def test_invisible_and_space_change_nothing(text):
    assert visual_form(" " + text + "​\n") == visual_form(text) == visual_form(unicodedata.normalize("NFD", text))


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.floats(0, 5)), max_size=6), st.floats(0.1, 5), st.floats(0.1, 5))
def test_schedules_integrate_to_one(inner, first, last):
    segments = _segments([(0.0, first), *inner, (1.0, last)])
    assert math.isclose(sum(w * (a + b) / 2 for _, w, a, b, _ in segments), 1, rel_tol=1e-9)
    assert np.all(np.diff([s[4] for s in segments]) >= -1e-12)
