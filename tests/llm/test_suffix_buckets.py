"""A bucket of suffixes is sorted in parts: right bits, and memory that does not follow the share of repeated text."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from barlake.llm import suffixes

LAYOUT = [("unit", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary())]


def bucket(units):
    """Of (distinct ascending hashes, document ids) per unit, as a round sends them."""
    rows = []
    for n, (keys, owner) in enumerate(units):
        ids, docs = np.unique(owner, return_inverse=True)
        rows.append((n, 0, keys.tobytes(), docs.astype(np.uint16).tobytes(), ids.tobytes()))
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), LAYOUT)], schema=pa.schema(LAYOUT))


def made(units, each, seed=3):
    """Hashes in the upper range of 64 bits, most of them in several units."""
    draw = np.random.default_rng(seed)
    known = (np.uint64(1) << np.uint64(63)) + draw.integers(0, 1 << 62, each * 2, dtype=np.uint64)
    for n in range(units):
        keys = np.unique(draw.choice(known, each, replace=False))
        yield keys, draw.integers(n * 5, n * 5 + 12, len(keys)).astype(np.int64)


def test_bits_of_a_bucket_sorted_in_parts(monkeypatch):
    monkeypatch.setattr(suffixes, "SORTED", 500, raising=False)
    units = list(made(9, 400))
    units.append((units[0][0][:1], np.array([-3])))
    units.append((units[0][0][-1:], np.array([suffixes._LAST])))
    least = {}
    for keys, owner in units:
        for k, o in zip(keys.tolist(), owner.tolist()):
            least[k] = min(o, least.get(k, o))
    got = {r["unit"]: r for r in suffixes._tied_suffixes((pa.scalar(0),), bucket(units)).to_pylist()}
    for n, (keys, owner) in enumerate(units):
        bits = np.unpackbits(np.frombuffer(got[n]["bits"], np.uint8), count=got[n]["n"]).astype(bool).tolist()
        assert bits == [least[k] < o for k, o in zip(keys.tolist(), owner.tolist())]


def test_a_bucket_takes_little_beside_its_rows(monkeypatch):
    monkeypatch.setattr(suffixes, "SORTED", 1 << 12, raising=False)
    table = bucket(made(40, 10_000))
    n = sum(len(k) // 8 for k in table.column("keys").to_pylist())
    tracemalloc.start()
    suffixes._tied_suffixes((pa.scalar(0),), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n  # its rows hold 10 bytes a suffix; 65 and more came on top
