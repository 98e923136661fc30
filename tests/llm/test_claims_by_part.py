"""A document that claims one part many times meets its bytes once."""

from weft.llm import suffix_dedup


def test_one_row_for_each_claimed_part():
    claim = lambda b, fs: {"b": b, "e": b + 100, "fd": 1, "ft": 2, "fs": fs}
    rows = next(suffix_dedup._asked([{"d": [7, 8], "t": [0, 0], "c": [[claim(b, 50) for b in range(0, 2000, 200)], []]}]))
    assert rows["d"] == [7] and rows["part"] == [0]
    assert sorted((a["b"], a["off"], a["n"]) for a in rows["at"][0]) == [(b, 50, 100) for b in range(0, 2000, 200)]
    assert next(suffix_dedup._asked([{"d": [7], "t": [0], "c": [[]]}]))["at"] == []
