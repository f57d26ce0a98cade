"""What a worker holds of tiles and of texts to encode: sketches are read in place, and texts are encoded in slices that hold all of them."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from latticework.llm import packing, simhash


def test_tiles_hold_no_copy_of_their_sketches():
    rng = np.random.default_rng(1)
    n = 4000
    raw = rng.integers(0, 256, (n, simhash.SKETCH), dtype=np.uint8)
    numbers = pa.array(rng.integers(-(2**62), 2**62, n + 2))
    sketch = pa.array([b"?", *[x.tobytes() for x in raw], b"?"], pa.binary())
    tracemalloc.start()
    try:
        t = simhash.Tile(*[x.slice(1, n) for x in (numbers, numbers, sketch, numbers)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < raw.nbytes / 4
    places = np.argsort(np.bitwise_count(numbers.to_numpy()[1:-1].view(np.uint64)), kind="stable")
    assert (t.cls == numbers.to_numpy()[1:-1][places]).all() and (t.sketches(np.arange(n)) == raw[places]).all()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_hold_all_rows_within_the_bound(kind):
    texts = ["before", None, "", "ab", "é", "x" * 50, "", None, "abc", "abcdefgh", "after"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array(texts, kind)], ["doc_id", "text"]).slice(1, 9)
    got = [s.column(1).to_pylist() for s in packing.slices(batch, 8)]
    assert got == [[None, "", "ab", "é"], ["x" * 50], ["", None, "abc"], ["abcdefgh"]] and not list(packing.slices(batch.slice(0, 0), 8))


def test_pieces_of_slices_are_those_of_whole_batches(spark, odd):
    docs = odd.coalesce(1)
    found = [Counter(map(tuple, packing.pieces(docs, 16, slice_bytes=n).collect())) for n in (None, 1, 40, 1 << 20)]
    assert found[1] == found[2] == found[3] == found[0]


def test_the_pipeline_encodes_in_slices(spark, odd, monkeypatch):
    asked = []
    monkeypatch.setattr(packing, "pieces", lambda *a, **k: asked.append(a[-1]) or (_ for _ in ()).throw(StopAsyncIteration))
    with pytest.raises(StopAsyncIteration):
        corpus_pipeline.pack_sequences(spark, odd, "")
    assert asked == [corpus_pipeline.SLICE_BYTES]
