"""The matcher against the standard library's, on short, long and odd texts."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.similarity import ratio


def want(a, b):
    return SequenceMatcher(None, a, b).ratio()


@settings(max_examples=400, deadline=None)
@given(st.text("abcd \U0001f600é", max_size=60), st.text("abcd \U0001f600é", max_size=60))
def test_short_texts(a, b):
    assert ratio(a, b) == want(a, b)


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=300), st.text("ab", min_size=190, max_size=320))
def test_few_letters(a, b):
    assert ratio(a, b) == want(a, b)


@pytest.mark.parametrize("seed", range(40))
def test_edited_texts(seed):
    """Whole texts with edits inside, below and above the length from which popular
    characters count."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    text = [rng.choice(words) for _ in range(rng.choice([5, 20, 40, 120, 500]))]
    other = list(text)
    for _ in range(rng.randrange(1, 12)):
        k = rng.randrange(len(other))
        kind = rng.randrange(4)
        if kind == 0:
            other[k] = rng.choice(words).upper()
        elif kind == 1 and len(other) > 1:
            del other[k]
        elif kind == 2:
            other.insert(k, rng.choice(words))
        else:
            other[k:] = other[k:][::-1]
    a, b = "".join(text), "".join(other)
    assert ratio(a, b) == want(a, b) and ratio(b, a) == want(b, a)


def test_long_text_of_one_letter():
    for a, b in (("a" * 5000, "a" * 4000), ("a" * 300 + "b", "b" + "a" * 300), ("x", "y"), ("", "abc"), ("", "")):
        assert ratio(a, b) == want(a, b)


def test_many_pairs_at_a_time(monkeypatch):
    """Pairs that are matched together, in slices of any size, don't touch each other."""
    from tessera.functions import similarity

    rng = random.Random(7)
    first = ["".join(rng.choice("abcde \U0001f600") for _ in range(rng.choice([0, 1, 7, 60, 199, 200, 450]))) for _ in range(120)]
    second = [x[len(x) // 3 :] + x[: len(x) // 4] if k % 3 else first[k - 1] for k, x in enumerate(first)]
    expected = [want(a, b) for a, b in zip(first, second, strict=True)]
    for chars, places in ((1 << 18, 1 << 18), (300, 1 << 18), (1 << 18, 200), (1, 1)):
        monkeypatch.setattr(similarity, "SLICE_CHARS", chars)
        monkeypatch.setattr(similarity, "SLICE_PLACES", places)
        assert similarity.ratios(first, second).tolist() == expected
    assert similarity.ratios([], []).tolist() == []


def test_whole_group_texts(spark):
    """The registered query on a small fixture, pair by pair."""
    from tessera.operators.groups import page_groups
    from tessera.plans.queries import with_inner_edits
    from tessera.functions.similarity import with_match_score

    pages = spark.createDataFrame([(i, f"<p>{'one two, three. ' * (i * 9)}{i}</p><p>x</p>") for i in range(1, 6)], "page_id long, html string")
    rows = with_match_score(with_inner_edits(page_groups(pages)), "text", "edited", "score").collect()
    assert len(rows) == 10
    squash = str.maketrans("", "", " \n\t,，.")
    for r in rows:
        a, b = (x.translate(squash).lower() for x in (r.text, r.edited))
        assert r.score == want(a, b)
