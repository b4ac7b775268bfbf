"""Sequences as arrays: batches of strings as bytes, k-mers as numbers, column counts; used inside Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21  # bytes worked on at once, or one sequence where that is longer
MOST_K = 31
_CODE = np.full(256, 255, np.uint8)
_CODE[[65, 67, 71, 84]] = [0, 1, 2, 3]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) and col.num_chunks else col
    col = col.cast(pa.large_binary())
    col = col.fill_null(b"") if col.null_count else col
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about `size` bytes."""
    at, n = 0, len(off) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1))
        yield at, to
        at = to


def kmer_codes(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the k-mers of A, C, G, T within one sequence, two bits a base, with their row and place."""
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k is 1 to {MOST_K}")
    n = len(buf) - k + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    base = _CODE[buf]
    # stretches of 1, 2, 4 ... bases, put together to k
    power, have, code = base.astype(np.int64) & 3, 1, None
    rest, done = k, 0
    while rest:
        if rest & 1:
            part = power[done : done + n]
            code = part.copy() if code is None else (code << (2 * have)) | part
            done += have
        rest >>= 1
        if rest:
            power = (power[: len(power) - have] << (2 * have)) | power[have:]
            have *= 2
    bad = np.concatenate([[0], np.cumsum(base == 255)])
    row = np.searchsorted(off, np.arange(n), "right") - 1
    ok = (np.arange(n) + k <= off[row + 1]) & (bad[k:] == bad[:-k])
    at = np.flatnonzero(ok)
    return code[at], row[at], at - off[row[at]]


def decoded(code: int, k: int) -> str:
    return "".join("ACGT"[code >> 2 * (k - 1 - i) & 3] for i in range(k))


# ---------------------------------------------------------------- small forms for what is shuffled or written


def packed_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose `seq` has four bases a byte, with `letters` of it; a sequence with other letters stays as it is, with -1."""
    for b in batches:
        at = b.schema.get_field_index("seq")
        buf, off = buffers(b.column(at))
        for lo, hi in slices(off) if len(b) else ():
            part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            base, n = _CODE[part], np.diff(o)
            other = np.concatenate([[0], np.cumsum(base == 255)])
            raw = other[o[1:]] > other[o[:-1]]
            size = np.where(raw, n, -(-n // 4))
            ends = np.concatenate([[0], np.cumsum(size)])
            out, is_raw = np.zeros(ends[-1], np.uint8), np.repeat(raw, n)
            wide = np.zeros(4 * int(size[~raw].sum()), np.uint8)  # every packed sequence to a multiple of four
            start = np.cumsum(np.where(raw, 0, 4 * size)) - np.where(raw, 0, 4 * size)
            wide[(np.repeat(start - o[:-1], n) + np.arange(len(part)))[~is_raw]] = base[~is_raw]
            raw_bytes = np.repeat(raw, size)
            out[~raw_bytes] = wide.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
            out[raw_bytes] = part[is_raw]
            seq = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
            cut = b.slice(lo, hi - lo).set_column(at, "seq", seq)
            yield cut.append_column("letters", pa.array(np.where(raw, -1, n), pa.int64()))


def unpacked_sequences(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the sequences."""
    buf, off = buffers(t.column("seq"))
    size, letters = np.diff(off), t.column("letters").to_numpy()
    raw = letters < 0
    n = np.where(raw, size, letters)
    out, is_raw, raw_bytes = np.empty(n.sum(), np.uint8), np.repeat(raw, n), np.repeat(raw, size)
    wide = ((buf[~raw_bytes][:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).reshape(-1)
    end = np.cumsum(4 * size[~raw])
    keep = np.arange(len(wide)) < np.repeat(end - 4 * size[~raw] + n[~raw], 4 * size[~raw])
    out[~is_raw] = np.frombuffer(b"ACGT", np.uint8)[wide[keep]]
    out[is_raw] = buf[raw_bytes]
    return out, np.concatenate([[0], np.cumsum(n)])


def packed_set(rising: np.ndarray) -> bytes:
    """Whole numbers from 0, each above the one before, by their distances: low bits as they are, the others in unary."""
    gap = np.diff(rising) - 1
    low = max(0, int(np.log2(gap.mean() + 1))) if len(gap) else 0
    ones = np.zeros(int((gap >> low).sum()) + len(gap), bool)
    ones[np.cumsum((gap >> low) + 1) - 1] = True
    bits = (gap[:, None] >> np.arange(low)) & 1
    return np.array([rising[0], len(rising) << 8 | low], np.int64).tobytes() + np.packbits(bits.astype(bool)).tobytes() + np.packbits(ones).tobytes()


def unpacked_set(data: pa.Buffer | bytes) -> np.ndarray:
    first, n = np.frombuffer(data, np.int64, 2).tolist()
    n, low = n >> 8, n & 255
    rest, size = np.frombuffer(data, np.uint8, offset=16), -(-(n - 1) * low // 8)
    gap = (np.flatnonzero(np.unpackbits(rest[size:]))[: n - 1] + 1).astype(np.int64)
    gap[1:] = np.diff(gap)
    gap -= 1
    gap <<= low
    bits = np.unpackbits(rest[:size])[: (n - 1) * low].reshape(n - 1, low)
    for i in range(low):
        gap |= bits[:, i].astype(np.int64) << i
    return first + np.concatenate([[0], np.cumsum(gap + 1)])


def packed_counts(n: np.ndarray) -> bytes:
    """Whole numbers from 0, compressed byte by byte: the lowest of all, then the next."""
    width = max(1, -(-int(n.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(n.astype("<i8").view(np.uint8).reshape(-1, 8).T[:width])
    return np.array([len(n), width], np.int32).tobytes() + pa.Codec("zstd").compress(planes, asbytes=True)


def unpacked_counts(data: pa.Buffer | bytes) -> np.ndarray:
    n, width = np.frombuffer(data, np.int32, 2).tolist()
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(data)[8:], decompressed_size=n * width, asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<i8")
