"""What a worker held for one batch is the system's again before the next."""

import pyarrow as pa

from costlens.llm import common


def resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 2**20


def test_portions_give_memory_back():
    def batches():
        for k in range(2):
            rows = 60_000
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(rows)), pa.array([f"{k} {i} " + "word " * 300 for i in range(rows)])], ["id", "text"]
            )

    before, held, seen = resident_mb(), 0, 0
    for ids, texts in common.portions(common.sparing(batches())):
        seen += len(ids)
        # small pieces, which the C library would keep in its heap
        keep = [bytearray(x.encode()) for x in texts]
        held = max(held, resident_mb())
        del keep
    del ids, texts
    common.give_back()
    assert seen == 120_000
    assert resident_mb() - before < (held - before) / 2


def test_every_batch_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3]), pa.array(["a", None, "c" * 5])], ["id", "text"])
    assert list(common.portions(common.sparing([batch, batch]))) == [([1, None, 3], ["a", "", "ccccc"])] * 2
    assert len(calls) == 2
