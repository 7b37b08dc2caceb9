"""Steps of the removal of repeats that did the same work more than once."""

import numpy as np
import pyarrow as pa
import zstandard

from artifactlake.llm import common, windows


def _slow_runs(codes, offsets, width, gram):
    """Runs by looking at each window of each row."""
    spans, out = common.Spans(codes), []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        last = None
        for s in range(a, b - width + 1):
            at = np.arange(s, s + width - gram + 1)
            grams = spans.of(at, at + gram)
            anchor = s + int(np.argmin(grams & ~windows._LOW))
            if anchor == last:
                out[-1][2] += 1
            else:
                out.append([row, s - a, 1, anchor - s, int(spans.of(np.array([anchor]), np.array([anchor + gram]))[0])])
            last = anchor
    return out


def test_runs_look_up_rows_once_a_run(monkeypatch):
    rng = np.random.default_rng(1)
    offsets = np.concatenate([[0, 0], np.cumsum(rng.integers(0, 300, 12))])
    offsets = np.append(offsets, offsets[-1])
    codes = common.BYTE_CODES[rng.integers(0, 3, offsets[-1])]
    asked = []
    find = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *r, **k: asked.append(np.size(v)) or find(a, v, *r, **k))
    for width, gram in ((40, 8), (9, 9), (12, 1)):
        for limit in (1 << 21, 50):
            monkeypatch.setattr(windows.stretches, "__defaults__", (limit,))
            asked.clear()
            got = windows.runs(codes, offsets, width, gram)
            rows = [list(r) for r in zip(*(got[c].tolist() for c in ("row", "start", "n", "lead", "anchor")), strict=True)]
            if limit > len(codes):
                assert rows == _slow_runs(codes, offsets, width, gram)
                assert width != 40 or sum(asked) < len(codes) / 4
            covered = [s + i for r, s, n, _, _ in rows for i in range(n)]
            assert len(covered) == sum(max(0, int(n) - width + 1) for n in np.diff(offsets))


def test_unmarked_documents_stay_packed(monkeypatch):
    pack = zstandard.ZstdCompressor().compress
    rows = [(1, 1, None, pack(b"one")), (2, 1, 5, None), (2, 1, 6, None), (2, 1, None, pack(b"two")), (2, 1, None, pack(b"two")), (3, 1, None, pack(b""))]
    own = pa.array([{"id": r[0]} for r in rows])
    cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
    batch = pa.RecordBatch.from_arrays([*cols, own], names=["k1", "k2", "start", "z", "own"])
    pieces = [batch.slice(0, 2), batch.slice(2, 2), batch.slice(4)]
    some = [(int(k[0]), data, marks[0].tolist()) for k, data, marks in windows.keyed_stream(pieces, ("start",), False)]
    assert some == [(2, b"two", [5, 6])] * 2
    everything = [(int(k[0]), data, marks[0].tolist()) for k, data, marks in windows.keyed_stream(pieces, ("start",))]
    assert everything == [(1, b"one", []), *some, (3, b"", [])]
