"""Workers give freed memory back while a task runs, not only when it ends."""

import pyarrow as pa

from subsetlab.llm import quality, shared


def test_memory_goes_back_between_slices(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda result=None: calls.append(1))
    monkeypatch.setattr(shared, "ARROW_ROWS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(95))], names=["x"])
    got = [x for part in shared.slices([batch, batch]) for x in part.column(0).to_pylist()]
    assert got == [*range(95), *range(95)]
    # Twenty slices in all, whatever the batches.
    assert len(calls) == 20 // shared.GIVE


def test_verdicts_of_a_large_batch(monkeypatch):
    texts = [None, "", "one two three", *(" ".join(f"w{i}x{k}" for k in range(12)) for i in range(40)), "a b c d e " * 20]
    want = quality.measure([(x or "").encode() for x in texts])["kept"].tolist()
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda result=None: calls.append(1))
    monkeypatch.setattr(shared, "ARROW_ROWS", 2)
    assert quality.verdicts(pa.array(texts)).to_pylist() == want and any(want) and not all(want)
    assert len(calls) == len(texts) // 2 // shared.GIVE
    assert quality.verdicts(pa.array([], pa.string())).to_pylist() == []
