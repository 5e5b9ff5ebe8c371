import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tessella.llm.suffix_array import repeated_windows, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_equals_sorted_suffixes(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_long_and_periodic_texts():
    rng = random.Random(0)
    for text in ([1] * 500, [1, 2] * 300, [2, 1, 1] * 200, [rng.randrange(300) for _ in range(3000)], [rng.randrange(2) for _ in range(3000)]):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_windows_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        names = [bytes([k]) * 16 for k in range(rng.choice([3, 30]))]
        rows = {(rng.choice(names), bytes(rng.choices(b"ab", k=rng.randint(0, 5))), bytes(rng.choices(b"ab", k=rng.randint(0, 5)))): rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randint(0, 40))}
        rows = [(*r, n) for r, n in rows.items()]
        held = {}
        for k, (f, left, right, weight) in enumerate(rows):
            for a in range(max(0, 5 - len(right)), len(left) + 1):
                held.setdefault((f, left[len(left) - a :], right[: 5 - a]), []).extend([(k, a)] * weight)
        expected = [0] * len(rows)
        for places in held.values():
            if len(places) > 1:
                for k, a in places:
                    expected[k] |= 1 << a
        families = [r[0] for r in rows]
        for k, (f, left, right, n) in enumerate(rows):  # a lone row without windows, as of a whole text
            if families.count(f) == 1 and n > 1 and len(left) + len(right) < 5:
                expected[k] = -1
        assert repeated_windows(rows, 5).tolist() == expected
