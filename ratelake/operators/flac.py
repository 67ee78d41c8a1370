"""FLAC decoding without a library: constant, verbatim, fixed and linear-prediction subframes; checksums are not looked at."""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: block sizes and sample rates by code, bits a sample by code, fixed predictors by order.
_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class _Bits:
    """Reads big-endian bit fields from text of 0 and 1, whose search for a 1 is fast."""

    def __init__(self, raw: bytes) -> None:
        self.text, self.at = bin(int.from_bytes(b"\x01" + raw, "big"))[3:], 0

    def unsigned(self, n: int) -> int:
        self.at += n
        return int(self.text[self.at - n : self.at], 2) if n else 0

    def signed(self, n: int) -> int:
        x = self.unsigned(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        one = self.text.index("1", self.at)
        zeros, self.at = one - self.at, one + 1
        return zeros


def _block_size(code: int, bits: _Bits) -> int:
    if code == 1:
        return 192
    if 2 <= code <= 5:
        return 576 << (code - 2)
    if code in (6, 7):
        return bits.unsigned(8 if code == 6 else 16) + 1
    return 256 << (code - 8)


def _residual(bits: _Bits, n: int, order: int) -> list[int]:
    wide, parts = 5 if bits.unsigned(2) else 4, 1 << bits.unsigned(4)
    out: list[int] = []
    for part in range(parts):
        size, k = n // parts - (order if part == 0 else 0), bits.unsigned(wide)
        if k == (1 << wide) - 1:
            raw = bits.unsigned(5)
            out += [bits.signed(raw) for _ in range(size)]
            continue
        for _ in range(size):
            high = bits.unary()
            x = high << k | bits.unsigned(k)
            out.append(x >> 1 if x & 1 == 0 else -(x >> 1) - 1)
    return out


def _predicted(first: list[int], residual: list[int], weights: tuple[int, ...] | list[int], shift: int) -> list[int]:
    out, order = list(first), len(weights)
    for r in residual:
        out.append(r + (sum(w * out[-1 - i] for i, w in enumerate(weights[:order])) >> shift))
    return out


def _subframe(bits: _Bits, n: int, depth: int) -> np.ndarray:
    bits.unsigned(1)
    kind = bits.unsigned(6)
    wasted = bits.unary() + 1 if bits.unsigned(1) else 0
    depth -= wasted
    if kind == 0:
        values = [bits.signed(depth)] * n
    elif kind == 1:
        values = [bits.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12:
        first = [bits.signed(depth) for _ in range(kind - 8)]
        values = _predicted(first, _residual(bits, n, kind - 8), _FIXED[kind - 8], 0)
    elif kind >= 32:
        order = kind - 31
        first = [bits.signed(depth) for _ in range(order)]
        precision, shift = bits.unsigned(4) + 1, bits.signed(5)
        weights = [bits.signed(precision) for _ in range(order)]
        values = _predicted(first, _residual(bits, n, order), weights, shift)
    else:
        raise ValueError(f"subframe of reserved kind {kind}")
    return np.array(values, np.int64) << wasted


def _frame(bits: _Bits, rate: int, depth: int) -> tuple[np.ndarray, int, int]:
    """Samples (channels, n), rate and depth of the next frame."""
    if bits.unsigned(14) != 0x3FFE:
        raise ValueError("no frame where one should begin")
    bits.unsigned(2)
    size, rates, layout, depths = bits.unsigned(4), bits.unsigned(4), bits.unsigned(4), bits.unsigned(3)
    bits.unsigned(1)
    lead = bits.unsigned(8)
    while lead & 0x40 and lead & 0x80:  # the frame's number, as long as its first byte says
        bits.unsigned(8)
        lead = (lead << 1) & 0xFF | 0x80 if lead & 0x20 else 0
    n = _block_size(size, bits)
    rate = bits.unsigned(8) * 1000 if rates == 12 else bits.unsigned(16) * (10 if rates == 14 else 1) if rates in (13, 14) else _RATES.get(rates, rate)
    depth = _DEPTHS.get(depths, depth)
    bits.unsigned(8)
    wide = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(layout, (0,) * (layout + 1))
    x = [_subframe(bits, n, depth + extra) for extra in wide]
    if layout == 8:
        x[1] = x[0] - x[1]
    elif layout == 9:
        x[0] = x[1] + x[0]
    elif layout == 10:
        twice = x[0] << 1 | x[1] & 1
        x = [(twice + x[1]) >> 1, (twice - x[1]) >> 1]
    bits.at += -bits.at % 8 + 16
    return np.stack(x), rate, depth


def decode_flac(raw: bytes) -> tuple[np.ndarray, int]:
    """Mono float32 samples and the rate of FLAC bytes."""
    if raw[:4] != b"fLaC":
        raise ValueError("not FLAC")
    at, last, rate, depth = 4, False, 0, 16
    while not last:
        last, kind, size = bool(raw[at] >> 7), raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
        if kind == 0:
            info = int.from_bytes(raw[at + 14 : at + 22], "big")
            rate, depth = info >> 44, (info >> 36 & 31) + 1
        at += 4 + size
    bits, parts = _Bits(raw[at:]), []
    while bits.at + 80 <= len(bits.text):
        samples, rate, depth = _frame(bits, rate, depth)
        parts.append((samples / 2.0 ** (depth - 1)).mean(axis=0))
    return np.concatenate([*parts, np.zeros(0)]).astype(np.float32), rate
