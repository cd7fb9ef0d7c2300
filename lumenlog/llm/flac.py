"""A FLAC encoder and decoder for one channel of 8-bit samples, in numpy.

Encoder: frames of BLOCK samples; each takes the fixed predictor (or, where asked for, a quantised linear one) with the smallest
residual, as one Rice partition, or the constant or verbatim form where that is shorter. Decoder: any
one-channel 8-bit stream of these forms, with Rice partitions of any order and escape codes. It checks each frame header's CRC-8,
each frame's CRC-16, the sample count and the MD5 of all samples, and raises FlacError where one differs.

Rice codes are one after the other, each where the last one ended. So frames go in step: the decoder takes code i of all frames of a
batch at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

BLOCK = 4096
RATE = 8000
LPC_PRECISION = 12
LPC_LEAST = 256


class FlacError(ValueError):
    """The stored bytes are not what was written."""


def _crc_table(bits: int, poly: int) -> np.ndarray:
    at = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        at = np.where(at >> (bits - 1) & 1, at << 1 ^ poly, at << 1) & ((1 << bits) - 1)
    return at.astype(np.uint16)


_CRC8, _CRC16 = _crc_table(8, 0x07).tolist(), _crc_table(16, 0x8005)
_far = [_CRC16]  # _far[i][b]: what byte b adds to the checksum when i bytes follow it


def _crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def _crc16(data: np.ndarray) -> int:
    """The checksum is linear: each byte's part depends on the number of bytes behind it only."""
    global _table
    if len(data) > len(_table):
        while len(_far) < len(data) + 256:
            last = _far[-1]
            _far.append((last << 8).astype(np.uint16) ^ _CRC16[last >> 8])
        _table = np.stack(_far)
    return int(np.bitwise_xor.reduce(_table[np.arange(len(data) - 1, -1, -1), data], initial=0)) if len(data) else 0


_table = np.stack(_far)


def _utf8(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    out = []
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    for _ in range(size - 1):
        out.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (8 - size)) & 0xFF | n, *out[::-1]])


def _bits_of(values: Sequence[int], width: int) -> np.ndarray:
    v = np.asarray(values, np.int64).reshape(-1, 1)
    return (v >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).reshape(-1)


def _rice(residual: np.ndarray) -> tuple[int, np.ndarray, int]:
    """The best parameter, the values folded to be positive, and the bits they take."""
    folded = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    middle = int(folded.mean()).bit_length() - 1
    size, k = min((int((folded >> k).sum()) + len(folded) * (1 + k), k) for k in range(max(0, middle - 1), max(1, middle + 2)) if k < 15)
    return k, folded, size


def _rice_bits(folded: np.ndarray, k: int, size: int) -> np.ndarray:
    bits = np.zeros(size, np.uint8)
    one = np.cumsum((folded >> k) + (1 + k)) - (1 + k)
    bits[one] = 1
    for j in range(k):
        bits[one + (1 + j)] = folded >> (k - 1 - j) & 1
    return bits


def _lpc(samples: np.ndarray, order: int) -> tuple[list[int], int] | None:
    """Coefficients quantised to LPC_PRECISION bits and their shift, by Levinson and Durbin's recursion."""
    x = samples.astype(np.float64)
    r = [float(x[i:] @ x[: len(x) - i]) for i in range(order + 1)]
    if r[0] <= 0:
        return None
    a, error = np.zeros(0), r[0]
    for i in range(order):
        reflect = (r[i + 1] - float(a @ np.array(r[i:0:-1])[: len(a)])) / error if len(a) else r[1] / error
        a = np.append(a - reflect * a[::-1], reflect)
        error *= 1 - reflect * reflect
        if error <= 0:
            return None
    largest = float(np.abs(a).max())
    if not 0 < largest < 1 << (LPC_PRECISION - 2):
        return None
    shift = min(15, max(0, LPC_PRECISION - 1 - int(np.ceil(np.log2(largest) + 1e-9)) - 1))
    return [int(v) for v in np.clip(np.round(a * (1 << shift)), -(1 << (LPC_PRECISION - 1)), (1 << (LPC_PRECISION - 1)) - 1)], shift


def _lpc_residual(samples: np.ndarray, coefficients: list[int], shift: int) -> np.ndarray:
    m = len(coefficients)
    s = samples.astype(np.int64)
    told = sum((c * s[m - 1 - j : len(s) - 1 - j] for j, c in enumerate(coefficients)), np.zeros(len(s) - m, np.int64))
    return s[m:] - (told >> shift)


def _subframe(samples: np.ndarray, lpc_order: int) -> bytes:
    n = len(samples)
    if (samples == samples[0]).all():
        return bytes([0, int(samples[0]) & 0xFF])
    s = samples.astype(np.int32)
    best, residual, order, kind = np.abs(s).sum(), s, 0, 0x08
    for m in range(1, min(3, n)):
        tried = np.diff(s, m)
        if (size := np.abs(tried).sum()) < best:
            best, residual, order, kind = size, tried, m, 0x08 | m
    head = np.empty(0, np.uint8)
    if 0 < lpc_order and n >= LPC_LEAST and (fit := _lpc(s, lpc_order)):
        tried = _lpc_residual(s, *fit)
        size = max(1, np.abs(tried).sum())  # about the log of the mean for each sample; coefficients have to pay for themselves
        if n * np.log2(size / max(1, best)) + 9 + (LPC_PRECISION + 8) * lpc_order < 8 * order and np.abs(tried).max() < 1 << 24:
            residual, order, kind = tried, lpc_order, 0x20 | (lpc_order - 1)
            head = np.concatenate([_bits_of([LPC_PRECISION - 1], 4), _bits_of([fit[1]], 5), _bits_of(fit[0], LPC_PRECISION)])
    k, folded, size = _rice(residual)
    if size + 8 * order + 10 + len(head) >= 8 * n:
        return bytes([0x02]) + samples.astype(np.int8).tobytes()
    start = bytes([kind << 1]) + samples[:order].astype(np.int8).tobytes()
    return start + np.packbits(np.concatenate([head, _bits_of([0], 6), _bits_of([k], 4), _rice_bits(folded, k, size)])).tobytes()


def encode(payload: bytes, lpc_order: int = 0) -> bytes:
    """A FLAC stream of the bytes as samples of 8 bits (byte - 128)."""
    if not payload:
        raise ValueError("a stream has a sample at least")
    samples = (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8)
    block = min(BLOCK, len(samples)) if len(samples) >= 16 else 16
    frames = []
    for number, at in enumerate(range(0, len(samples), block)):
        piece = samples[at : at + block]
        head = b"\xff\xf8\x70\x02" + _utf8(number) + (len(piece) - 1).to_bytes(2, "big")
        frame = head + bytes([_crc8(head)]) + _subframe(piece, lpc_order)
        frames.append(frame + _crc16(np.frombuffer(frame, np.uint8)).to_bytes(2, "big"))
    sizes = [len(f) for f in frames]
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    seek = b"".join((i * block).to_bytes(8, "big") + at.to_bytes(8, "big") + min(block, len(samples) - i * block).to_bytes(2, "big") for i, at in enumerate(starts))
    return b"fLaC\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


class _Reader:
    """Bits one after the other, for what is short."""

    def __init__(self, data: bytes, bit: int):
        self.data, self.bit = data, bit

    def take(self, n: int) -> int:
        a, b = self.bit, self.bit + n
        if b > 8 * len(self.data):
            raise FlacError("the stream ends early")
        self.bit = b
        return int.from_bytes(self.data[a // 8 : (b + 7) // 8], "big") >> (-b % 8) & ((1 << n) - 1) if n else 0

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


_CLZ16 = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def _in_step(data: bytes, bit: np.ndarray, k: np.ndarray, count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """`count` Rice codes of parameter `k` from each start: their values, and the bits where they end."""
    by_size = np.argsort(-count, kind="stable")
    at, k, count = bit[by_size].astype(np.int64), k[by_size].astype(np.uint64), count[by_size]
    windows = np.ndarray((len(data) + 1,), ">u8", data + bytes(8), 0, (1,))  # the 8 bytes from each byte on
    out = np.empty((int(count[0]) if len(count) else 0, len(count)), np.int32)
    active = np.searchsorted(-count, -np.arange(len(out)), side="left")
    last = 8 * len(data)
    shift = np.uint64(63) - k
    step = (k + np.uint64(1)).astype(np.int64)
    one, top = np.uint64(1), np.uint64(48)
    for i, m in enumerate(active.tolist()):
        p = at[:m]
        if p.max() >= last:
            raise FlacError("the stream ends early")
        x = windows[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        q = _CLZ16[(x >> top).view(np.int64)]
        if q.max() == 16:
            q, x = _long_runs(data, p, q, x)
        u = q.astype(np.uint64)
        low = (x << (np.minimum(u, np.uint64(16)) + one)) >> one >> shift[:m]
        out[i, :m] = ((u << k[:m]) | low).view(np.int64)
        p += q + step[:m]
    values: list[np.ndarray] = [None] * len(count)  # type: ignore[list-item]
    ends = np.empty(len(count), np.int64)
    for j, f in enumerate(by_size.tolist()):
        values[f], ends[f] = out[: count[j], j], at[j]
    return values, ends


def _long_runs(data: bytes, p: np.ndarray, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of 16 zeros or more: their length, and the window moved so that the run's last 16 bits at most lie before the code."""
    q, x = q.copy(), x.copy()
    for j in np.flatnonzero(q == 16).tolist():
        reader = _Reader(data, int(p[j]))
        q[j] = reader.unary()
        start = reader.bit - 17
        word = int.from_bytes((data[start // 8 : start // 8 + 9] + bytes(9))[:9], "big")
        x[j] = word >> (8 - start % 8) & ((1 << 64) - 1)
    return q, x


def _restored(warm: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Undo a fixed predictor: each order is one running sum."""
    out = residual.astype(np.int64)
    for level in range(len(warm) - 1, -1, -1):
        out = np.cumsum(np.concatenate([np.diff(warm, level)[:1], out]))
    return out


def _predicted(frames: list[dict]) -> list[np.ndarray]:
    """Undo the linear predictors of frames of one order: sample i of all frames at once, the longest frames first."""
    by_size = sorted(range(len(frames)), key=lambda i: -frames[i]["n"])
    held = [frames[i] for i in by_size]
    order, sizes = len(held[0]["warm"]), np.array([f["n"] for f in held])
    out = np.zeros((int(sizes[0]), len(held)), np.int64)
    for j, f in enumerate(held):
        out[:order, j], out[order : f["n"], j] = f["warm"], f["residual"]
    coefficients, shift = np.array([f["lpc"][0][::-1] for f in held]).T, np.array([f["lpc"][1] for f in held])
    active = np.searchsorted(-sizes, -np.arange(len(out)), side="left").tolist()
    for i in range(order, len(out)):
        m = active[i]
        out[i, :m] += (coefficients[:, :m] * out[i - order : i, :m]).sum(0) >> shift[:m]
    found: list[np.ndarray] = [None] * len(frames)  # type: ignore[list-item]
    for j, i in enumerate(by_size):
        found[i] = out[: frames[i]["n"], j]
    return found


def _partitioned(reader: _Reader, n: int, order: int, method: int, partition_order: int) -> np.ndarray:
    """Residuals of several partitions or with escape codes."""
    width, parts, out = 4 + method, 1 << partition_order, []
    for part in range(parts):
        count = (n >> partition_order) - (order if part == 0 else 0)
        k = reader.take(width)
        if k == (1 << width) - 1:
            raw = reader.take(5)
            out.append(np.array([reader.signed(raw) for _ in range(count)], np.int64))
            continue
        found, ends = _in_step(reader.data, np.array([reader.bit]), np.array([k]), np.array([count])) if count else ([np.empty(0, np.int32)], np.array([reader.bit]))
        out.append(_unfolded(found[0]))
        reader.bit = int(ends[0])
    return np.concatenate(out)


def _unfolded(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    return (v >> 1) ^ -(v & 1)


def _opened(data: bytes) -> dict:
    """What stands before the frames: the place of the first, the samples, their MD5, and where the seek table puts the frames."""
    if data[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, info, seek, final = 4, b"", b"", False
    while not final:
        if len(data) < at + 4:
            raise FlacError("the stream ends early")
        final, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        info, seek = (data[at + 4 : at + 4 + size] if kind == k else held for k, held in ((0, info), (3, seek)))
        at += 4 + size
    if len(info) != 34:
        raise FlacError("no stream information")
    packed, block = int.from_bytes(info[10:18], "big"), int.from_bytes(info[:2], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise FlacError("one channel of 8 bits is what is read here")
    points = np.frombuffer(seek, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]), len(seek) // 18)
    total = packed & ((1 << 36) - 1)
    whole = len(points) and np.array_equal(points["sample"], np.arange(len(points)) * block) and int(points["sample"][-1]) + int(points["n"][-1]) == total
    starts = (at + points["offset"].astype(np.int64)).tolist() if whole else [at]
    return {"data": data, "starts": starts, "whole": whole, "total": total, "md5": info[18:]}


def decode_all(streams: list[bytes]) -> list[list[bytes]]:
    """The PCM blocks of each stream, as unsigned bytes. With a seek table all frames go in step, else the first of each stream, and so on."""
    held = [_opened(data) for data in streams]
    blocks: list[list[np.ndarray]] = [[] for _ in held]
    jobs = [(i, s["data"], at, number) for i, s in enumerate(held) for number, at in enumerate(s["starts"]) if s["total"]]
    ends = [s["starts"][0] for s in held]
    while jobs:
        more = []
        for (i, data, at, number), (pcm, stop) in zip(jobs, _frames(jobs)):
            s = held[i]
            if at != ends[i]:
                raise FlacError("a frame is not where the seek table puts it")
            blocks[i].append(pcm)
            ends[i] = stop
            if not s["whole"] and sum(map(len, blocks[i])) < s["total"]:
                more.append((i, data, stop, number + 1))
        jobs = more
    out = []
    for s, own, end in zip(held, blocks, ends):
        digest = hashlib.md5()
        for b in own:
            digest.update(b)
        if end != len(s["data"]) or sum(map(len, own)) != s["total"] or digest.digest() != s["md5"]:
            raise FlacError("the samples' checksum differs")
        out.append([(b.view(np.uint8) ^ 0x80).tobytes() for b in own])
    return out


def _frames(jobs: list[tuple[int, bytes, int, int]]) -> list[tuple[np.ndarray, int]]:
    """The samples of the frame that starts at each place, and where it ends."""
    waiting, joined, base = [], [], 0
    for _, data, at, place in jobs:
        number = _utf8(place)
        end = at + 4 + len(number) + 2
        if data[at : at + 4] != b"\xff\xf8\x70\x02" or data[at + 4 : end - 2] != number or len(data) <= end or _crc8(data[at:end]) != data[end]:
            raise FlacError("no sound frame header where one is due")
        n, reader = int.from_bytes(data[end - 2 : end], "big") + 1, _Reader(data, 8 * (end + 1))
        kind = reader.take(8) >> 1
        f = {"data": data, "at": at, "n": n, "reader": reader}
        if kind == 0:
            f["samples"] = np.full(n, reader.signed(8), np.int64)
        elif kind == 1:
            a = reader.bit // 8
            if a + n > len(data):
                raise FlacError("the stream ends early")
            f["samples"] = np.frombuffer(data, np.int8, n, a)
            reader.bit += 8 * n
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            f["warm"] = np.array([reader.signed(8) for _ in range(order)], np.int64)
            if kind >= 32:
                precision, shift = reader.take(4) + 1, reader.signed(5)
                f["lpc"] = ([reader.signed(precision) for _ in range(order)], max(0, shift))
            method, partition_order = reader.take(2), reader.take(4)
            k = reader.take(4 + method) if partition_order == 0 else -1
            if method > 1 or order > n:
                raise FlacError("a subframe of no known form")
            if partition_order or k == (1 << (4 + method)) - 1:
                reader.bit -= 4 + method if partition_order == 0 else 0
                f["residual"] = _partitioned(reader, n, order, method, partition_order)
            else:
                f |= {"k": k, "count": n - order, "bit": 8 * base + reader.bit - 8 * at}
                stop = min(len(data), at + 2 * n + 64)  # no frame of this encoder is longer
                joined.append(data[at:stop])
                base += stop - at
        else:
            raise FlacError("a subframe of no known form")
        waiting.append(f)
    stepped = [f for f in waiting if "k" in f]
    if stepped:
        values, ends = _in_step(b"".join(joined), *(np.array([f[x] for f in stepped]) for x in ("bit", "k", "count")))
        for f, v, e in zip(stepped, values, ends.tolist()):
            f["residual"] = _unfolded(v)
            f["reader"].bit += e - f["bit"]
    for order in {len(f["warm"]) for f in waiting if "lpc" in f}:
        of_order = [f for f in waiting if "lpc" in f and len(f["warm"]) == order]
        for f, x in zip(of_order, _predicted(of_order)):
            f["samples"] = x
    out = []
    for f in waiting:
        data, at, stop = f["data"], f["at"], -(-f["reader"].bit // 8)
        if stop + 2 > len(data) or _crc16(np.frombuffer(data, np.uint8, stop - at, at)) != int.from_bytes(data[stop : stop + 2], "big"):
            raise FlacError("a frame's checksum differs")
        if "samples" not in f:
            f["samples"] = _restored(f["warm"], f["residual"])
        out.append((f["samples"].astype(np.int8), stop + 2))
    return out
