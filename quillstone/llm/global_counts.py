"""Which fingerprints occur twice or more anywhere, told back to the groups that hold them.

Groups of documents send the distinct fingerprints they hold, packed by hash bucket, so that one row carries
thousands. Each bucket is counted in one task; what it answers to a group is the subset that is shared. A
fingerprint that half of all documents hold reaches its bucket once for each group, not once for each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SENT = "grp long, bucket long, lo binary, hi binary, multi binary"
TOLD = "grp long, bucket long, bits binary"
_SENT_ARROW = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary()), ("multi", pa.binary())])
_TOLD_ARROW = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])


class Distinct:
    """The distinct fingerprints of one group in order of (lo, hi), cut into buckets by the top bits of ``lo``.

    Where there is a second half, all 128 bits travel, so that no two of a corpus' fingerprints meet by chance.
    The same fingerprints always give the same order, so an answer needs one bit for each.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray | None, buckets: int):
        order = np.argsort(lo, kind="stable") if hi is None else np.lexsort((hi, lo))
        lo, hi = lo[order], None if hi is None else hi[order]
        new = np.ones(len(lo), dtype=bool)
        new[1:] = lo[1:] != lo[:-1]
        if hi is not None:
            new[1:] |= hi[1:] != hi[:-1]
        at = np.flatnonzero(new)
        self.lo, self.hi = lo[at], None if hi is None else hi[at]
        self.multi = np.diff(np.append(at, len(lo))) > 1
        self.of = np.empty(len(lo), dtype=np.int64)  # for each given fingerprint its place among the distinct
        self.of[order] = np.cumsum(new) - 1
        bucket = (self.lo >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).astype(np.int64)
        self.buckets = {int(bucket[x]): (int(x), int(y)) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y > x}

    def rows(self, grp: int) -> list[dict]:
        """Rows of SENT."""
        return [
            {"grp": grp, "bucket": k, "lo": self.lo[a:b].tobytes(), "hi": b"" if self.hi is None else self.hi[a:b].tobytes(), "multi": np.packbits(self.multi[a:b]).tobytes()}
            for k, (a, b) in self.buckets.items()
        ]

    def shared(self, answers: pa.Table) -> np.ndarray:
        """For each given fingerprint whether it occurs twice or more, from the TOLD rows of its group."""
        known = np.zeros(len(self.lo), dtype=bool)
        for k, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            a, b = self.buckets[k]
            known[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        return known[self.of]


def sent_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_SENT_ARROW)


def _count(key: tuple, table: pa.Table) -> pa.Table:
    lo = [np.frombuffer(x, np.uint64) for x in table["lo"].to_pylist()]
    hi = [np.frombuffer(x, np.uint64) for x in table["hi"].to_pylist()]
    multi = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)) for m, x in zip(table["multi"].to_pylist(), lo, strict=True)]
    grp = table["grp"].to_pylist()
    ends = np.cumsum([len(x) for x in lo])
    lo, multi = np.concatenate(lo), np.concatenate(multi)
    wide = any(len(x) for x in hi)
    hi = np.concatenate(hi) if wide else None
    order = np.argsort(lo, kind="stable") if hi is None else np.lexsort((hi, lo))
    a = lo[order]
    same = a[1:] == a[:-1]
    if hi is not None:
        b = hi[order]
        same &= b[1:] == b[:-1]
    shared = multi[order].astype(bool)
    shared[1:] |= same
    shared[:-1] |= same
    known = np.empty(len(lo), dtype=bool)
    known[order] = shared
    # a fingerprint that its sender holds twice is shared for all that hold it; equal ones are neighbours above
    parts = np.split(known, ends[:-1])
    rows = [{"grp": g, "bucket": key[0].as_py(), "bits": np.packbits(x).tobytes()} for g, x in zip(grp, parts, strict=True) if x.any()]
    return pa.Table.from_pylist(rows, schema=_TOLD_ARROW)


def shared(sent: DataFrame) -> DataFrame:
    """Rows of TOLD: for each group and bucket, which of its fingerprints occur twice or more over all groups."""
    return sent.groupBy("bucket").applyInArrow(_count, TOLD)
