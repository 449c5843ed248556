"""The table of encoded units."""

from dockspan.llm import batches
from dockspan.llm.batches import UnitTable


def test_units_are_added_in_runs_and_found_again(monkeypatch):
    monkeypatch.setattr(batches, "ADDED", 7)
    asked = []

    def compute(units):
        units = list(units)
        asked.append(len(units))
        return ([len(u)] * (len(u) % 5) for u in units)

    table = UnitTable(compute, limit=400)
    for call in range(40):
        units = [f"{'x' * (i % 23)}{i % 190}" for i in range(call * 31, call * 31 + 97)] + ["", "x0", "x0"]
        starts, lengths = table.look_up(units)
        for unit, start, length in zip(units, starts.tolist(), lengths.tolist(), strict=True):
            assert table.flat[start : start + length].tolist() == [len(unit)] * (len(unit) % 5)
    # New strings are computed in runs, each string once while it is held.
    assert max(asked) == 7
