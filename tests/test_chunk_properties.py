from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.sections import table_aware_chunks

LINE = st.lists(st.text("ab", min_size=1, max_size=3), max_size=9).map(" ".join)
ROW = LINE.map(lambda t: f"| {t} |")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(LINE, ROW), max_size=40), st.integers(2, 30), st.integers(0, 12), st.booleans())
def test_chunks_hold_every_word_in_order(lines, size, overlap, first_equal):
    if overlap >= size:
        overlap = size - 1
    text = "\n".join(lines)
    got = table_aware_chunks(text, size, overlap, first_equal)
    assert [c[0] for c in got] == list(range(len(got)))
    assert all(c[2] == k * size and c[3] - c[2] == len(c[1].split()) for k, c in enumerate(got))
    assert {w for c in got for w in c[1].split()} == set(text.split())
    # all but the last are full, and close outside tables
    assert all(c[3] - c[2] >= size for c in got[:-1])
    if not overlap:
        assert [w for c in got for w in c[1].split()] == text.split()
