"""Operator 2: exact removal of repeated byte windows by a depth-limited radix sort.

A *window* is the first ``depth`` bytes of a suffix. Two windows are repeats when
all ``depth`` bytes are equal, so suffixes only have to be ordered that far. The
order is made by most-significant-digit passes, each of which shuffles the
current digit, closes the groups it can decide, and hands only the others to the
next, finer digit:

1. digit = the window's minimiser, the ``core``-byte string of least hash in it.
   Consecutive windows mostly share it, so one row stands for a *run* of windows.
   A digit seen once closes its run as unique; a digit whose runs all cover the
   same bytes closes them as repeated.
2. digit = the bytes common to a cell of ``CELL`` neighbouring windows, for one
   representative of each distinct run that is still open.
3. digit = the whole window, for the cells that are still open. Equal groups are
   the repeated windows.

Every pass counts digits with partial aggregation, so in the counts a run shared by
a third of the corpus is one row per task; in the joins that follow, the rows of so
hot a digit are salted. Digits are compared by 64-bit
fingerprints inside the group of the preceding digit (128 bits in all).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted, save

CHUNK = 1 << 19
CELL = 16
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x2545F4914F6CDD1D


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes; powers of the base and of its inverse, modulo 2^64."""
    size = CHUNK + 4096
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.cumprod(np.full(size, _BASE, np.uint64))])
    down = np.concatenate([one, np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))])
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)), up, down


class _Prefix:
    """Polynomial hashes of any substring of one chunk from prefix sums."""

    def __init__(self, data: np.ndarray):
        values, self.up, self.down = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def _runs(data: np.ndarray, depth: int, core: int):
    """Per run of windows with one minimiser: its digit, its bytes' hash, start, size, minimiser."""
    for at in range(0, max(0, len(data) - depth + 1), CHUNK):
        part = data[at : at + CHUNK + depth - 1]
        prefix = _Prefix(part)
        digit = prefix.every(core)
        least = (digit & ~_LOW) | np.arange(len(digit), dtype=np.uint64)
        width, have = depth - core + 1, 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        place = (least & _LOW).astype(np.int64)
        turn = np.flatnonzero(place[1:] != place[:-1]) + 1
        start = np.concatenate([[0], turn])
        end = np.concatenate([turn, [len(place)]])
        size = end - start
        body = _mix(prefix.of(start, end + depth - 1) ^ size.astype(np.uint64))
        yield digit[place[start]], body, start + at, size, place[start] + at


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer() if value.is_valid else b"", np.uint8)


def _batches(columns: list[list[np.ndarray]], schema: pa.Schema):
    if columns and columns[0]:
        arrays = [np.concatenate(c) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, f.type) for a, f in zip(arrays, schema)], schema=schema)


RUN = "digit long, body long, doc_id long, dk long, lo long, n int, core_at long"
_RUN = pa.schema([("digit", pa.int64()), ("body", pa.int64()), ("doc_id", pa.int64()), ("dk", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("core_at", pa.int64())])


def _run_rows(depth: int, core: int):
    def rows(batches):
        for batch in batches:
            ids, dks, texts = (batch.column(i) for i in range(3))
            out = [[] for _ in _RUN]
            held = 0
            for i in range(batch.num_rows):
                for digit, body, lo, size, place in _runs(_bytes(texts[i].cast(pa.binary())), depth, core):
                    one = np.ones(len(digit), np.int64)
                    for column, x in zip(out, (digit, body, one * ids[i].as_py(), one * dks[i].as_py(), lo, size.astype(np.int32), place)):
                        column.append(x)
                    held += len(digit)
                if held > 200_000:
                    yield from _batches(out, _RUN)
                    out, held = [[] for _ in _RUN], 0
            yield from _batches(out, _RUN)

    return rows


BODY = "digit long, body long, weight long, doc_id long, dk long, lo long, n int, core_off int, bytes binary"


def _cut_bodies(depth: int):
    """Bytes of each representative run, cut from its document's text."""

    def rows(batches):
        for batch in batches:
            got = {c: [] for c in ("digit", "body", "weight", "doc_id", "dk", "lo", "n", "core_off", "bytes")}
            text, reps = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                data = text[i].as_py()
                for r in reps[i].as_py():
                    for c in ("digit", "body", "weight", "doc_id", "dk", "lo", "n"):
                        got[c].append(r[c])
                    got["core_off"].append(r["core_at"] - r["lo"])
                    got["bytes"].append(data[r["lo"] : r["lo"] + r["n"] + depth - 1])
            yield pa.RecordBatch.from_arrays([pa.array(got[c], t) for c, t in zip(got, (pa.int64(),) * 6 + (pa.int32(), pa.int32(), pa.binary()))], names=list(got))

    return rows


def _packs(batch):
    """Row ranges of a batch whose runs' bytes together fit one chunk."""
    size = np.diff(np.frombuffer(batch.column("bytes").buffers()[1], np.int32)[batch.column("bytes").offset :][: batch.num_rows + 1])
    first, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held + n > CHUNK and i > first:
            yield first, i
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield first, batch.num_rows


def _joined(part):
    """The bytes of all runs of ``part`` in one array, and where each run begins."""
    rows = part.column("bytes").to_pylist()
    begin = np.cumsum([0, *map(len, rows)])[:-1]
    return np.frombuffer(b"".join(rows), np.uint8), begin


CELLS = "digit long, body long, cell int, core long, cell_body long, weight long, doc_id long, dk long, lo long, n int, at int"
_CELLS = pa.schema([("digit", pa.int64()), ("body", pa.int64()), ("cell", pa.int32()), ("core", pa.int64()), ("cell_body", pa.int64()), ("weight", pa.int64()), ("doc_id", pa.int64()), ("dk", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])


def _cells(depth: int):
    """The cells of each run: windows whose distance before the minimiser has one quotient by CELL."""

    def rows(batches):
        for batch in batches:
            for first, last in _packs(batch):
                part = batch.slice(first, last - first)
                data, begin = _joined(part)
                prefix = _Prefix(data)
                n, off = part.column("n").to_numpy(), part.column("core_off").to_numpy()
                run = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                cell = (off[run] - at) // CELL
                new = np.concatenate([[True], (run[1:] != run[:-1]) | (cell[1:] != cell[:-1])])
                start = np.flatnonzero(new)
                size = np.diff(np.append(start, len(run)))
                r, at, cell = run[start], at[start], cell[start]
                centre = begin[r] + off[r] - CELL * cell
                core = prefix.of(centre, centre - (CELL - 1) + depth)
                body = _mix(prefix.of(begin[r] + at, begin[r] + at + size + depth - 1) ^ size.astype(np.uint64))
                of = {c: part.column(c).to_numpy() for c in ("digit", "body", "weight", "doc_id", "dk", "lo")}
                yield from _batches([[x] for x in (of["digit"][r], of["body"][r], cell.astype(np.int32), core, body, of["weight"][r], of["doc_id"][r], of["dk"][r], of["lo"][r] + at, size.astype(np.int32), at.astype(np.int32))], _CELLS)

    return rows


WINDOW = "core long, window long, weight long, doc_id long, dk long, lo long"
_WINDOW = pa.schema([(c, pa.int64()) for c in ("core", "window", "weight", "doc_id", "dk", "lo")])


def _windows(depth: int):
    """Every window of the open cells of each run."""

    def rows(batches):
        for batch in batches:
            for first, last in _packs(batch):
                part = batch.slice(first, last - first)
                data, begin = _joined(part)
                prefix = _Prefix(data)
                cells = part.column("cells")
                run = np.repeat(np.arange(len(begin)), np.diff(cells.offsets.to_numpy()))
                core, at, n = (cells.flatten().field(c).to_numpy() for c in ("core", "at", "n"))
                which = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                r, place = run[which], at[which] + step
                of = {c: part.column(c).to_numpy() for c in ("weight", "doc_id", "dk", "lo")}
                window = prefix.of(begin[r] + place, begin[r] + place + depth)
                yield from _batches([[x] for x in (core[which], window, of["weight"][r], of["doc_id"][r], of["dk"][r], of["lo"][r] + place)], _WINDOW)

    return rows


def _strip(depth: int):
    """Drop what the repeated windows of each document cover."""

    def rows(batches):
        for batch in batches:
            ids, texts, spans = (batch.column(i) for i in range(3))
            removed, n_spans, sha, size, kept_text = [], [], [], [], []
            for i in range(batch.num_rows):
                data = _bytes(texts[i].cast(pa.binary()))
                edge = np.zeros(len(data) + 1, np.int64)
                if spans[i].is_valid:
                    s = spans[i].values
                    lo, n = s.field("lo").to_numpy(), s.field("n").to_numpy()
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + n + depth - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = data[~gone].tobytes()
                size.append(len(data))
                removed.append(int(gone.sum()))
                n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha), pa.array(kept_text, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows


def repeated_spans(docs: DataFrame, depth: int = 200, core: int = 40) -> DataFrame:
    """Rows (doc_id, dk, lo, n): ``n`` repeated windows of a document from byte ``lo`` on.

    ``docs`` needs doc_id, dk (a key of the row's content) and text. ``depth`` has
    to exceed ``core`` by more than ``CELL``. Texts shorter than ``depth`` bytes,
    empty and null ones have no window. Equal rows repeat one another.
    """
    if depth - core <= CELL:
        raise ValueError("depth must exceed core by more than CELL")
    runs = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "dk", "text").where(F.octet_length("text") >= depth).mapInArrow(_run_rows(depth, core), RUN)
    counts = (F.count("*").alias("__n"), F.min("body").alias("least"), F.max("body").alias("most"))
    again = save(runs.groupBy("digit").agg(*counts).where("__n > 1").select("digit", "__n", (F.col("least") != F.col("most")).alias("open")), "op2-digits")
    spread, marked, on = salted(runs, again, ["digit"], ["doc_id", "lo"], "__n")
    kept = save(spread.join(marked, on).drop("__salt", "__n"), "op2-runs")
    distinct = save(kept.where("open").groupBy("digit", "body").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "dk", "lo", "n", "core_at")).alias("r")).select("digit", "body", "weight", "r.*"), "op2-distinct")

    per_doc = distinct.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("digit", "body", "weight", "doc_id", "dk", "lo", "n", "core_at")).alias("reps"))
    bodies = save(docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "dk", "text").join(per_doc, ["doc_id", "dk"]).select(F.col("text").cast("binary").alias("text"), "reps").mapInArrow(_cut_bodies(depth), BODY), "op2-bodies")

    cells = bodies.mapInArrow(_cells(depth), CELLS)
    key = ["digit", "cell", "core"]
    counts = (F.sum("weight").alias("c"), F.count("*").alias("rows"), F.min("cell_body").alias("least"), F.max("cell_body").alias("most"))
    marks = save(cells.groupBy(*key).agg(*counts).where("c > 1").select(*key, F.col("rows").alias("__n"), (F.col("least") != F.col("most")).alias("open")), "op2-cell-digits")
    spread, marked, on = salted(cells, marks, key, ["doc_id", "lo", "at"], "__n")
    hit = save(spread.join(marked, on).drop("__salt", "__n"), "op2-cells")

    open_cells = hit.where("open").groupBy("digit", "body", "doc_id", "dk").agg(F.collect_list(F.struct("core", "at", "n")).alias("cells"))
    windows = bodies.join(open_cells, ["digit", "body", "doc_id", "dk"]).select("cells", "bytes", "weight", "doc_id", "dk", "lo").mapInArrow(_windows(depth), WINDOW)
    counts = (F.sum("weight").alias("c"), F.count_if(F.col("weight") == 1).alias("__n"))
    twice = save(windows.groupBy("core", "window").agg(*counts).where("c > 1").select("core", "window", "__n"), "op2-windows")

    span = ["doc_id", "dk", "lo", "n"]
    whole = kept.where("not open").select(*span)
    spread, marked, on = salted(kept.where("open"), distinct.where("weight > 1").select("digit", "body", F.col("weight").alias("__n")), ["digit", "body"], ["doc_id", "lo"], "__n")
    copied = spread.join(marked, on).select(*span)
    spread, marked, on = salted(windows.where("weight = 1"), twice, ["core", "window"], ["doc_id", "lo"], "__n")
    single = spread.join(marked, on).select("doc_id", "dk", "lo", F.lit(1).alias("n"))
    return save(whole.union(copied).union(hit.where("not open and weight = 1").select(*span)).union(single), "op2-spans")


def remove_repeats(docs: DataFrame, depth: int = 200, core: int = 40) -> DataFrame:
    """Remove each byte covered by a ``depth``-byte string that also starts anywhere else.

    One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left).
    Null text counts as empty; null doc_ids stay null; two equal rows remove one
    another as any other copies do.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("dk", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed, depth, core).groupBy("doc_id", "dk").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    keyed = keyed.withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    joined = keyed.join(spans.withColumnRenamed("doc_id", "id"), ["id", "dk"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_strip(depth), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
