"""Intra frames of motion JPEG: lossless JPEG (SOF3) written and read by array operations, and a plain decoder of baseline
(SOF0) and lossless frames for other writers' files.

Frames that we write use predictor 1 and a Huffman table in which category s has a code of 9 - s bits, so that every
sample takes nine bits whatever its value: a scan is decoded without walking through it bit by bit.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH = 64

# Fixed values of the JPEG standard: the zigzag order of coefficients.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]

#: Code lengths by count (1 to 16 bits) and the categories in order of their codes.
NINE_BITS = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def _codes() -> tuple[np.ndarray, np.ndarray]:
    to = np.zeros(511, np.uint16)
    back = np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1
        code = prefix << s | (d if d >= 0 else d + (1 << s) - 1)
        to[d + 255] = code
        back[code] = d
    return to, back


_TO, _BACK = _codes()


def frame_header(height: int) -> bytes:
    return (
        b"\xff\xd8\xff\xc4" + struct.pack(">HB", 3 + len(NINE_BITS), 0) + NINE_BITS
        + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, height, WIDTH, 1) + b"\x01\x11\x00"
        + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x01\x00\x00"
    )


def encode_scans(rows: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded bytes of all frames, one after another, and where each starts. rows: (n, WIDTH) bytes; first: first row of each frame."""
    s = rows.astype(np.int16)
    d = np.empty_like(s)
    d[:, 1:] = s[:, 1:] - s[:, :-1]
    d[1:, 0] = s[1:, 0] - s[:-1, 0]
    d[first, 0] = s[first, 0] - 128
    c = _TO[d + 255].reshape(-1, 8)
    b = np.empty((len(c), 9), np.uint8)
    b[:, 0] = c[:, 0] >> 1
    for j in range(1, 8):
        b[:, j] = ((c[:, j - 1] & ((1 << j) - 1)) << (8 - j)) | (c[:, j] >> (j + 1))
    b[:, 8] = c[:, 7] & 255
    flat = b.ravel()
    ff = np.flatnonzero(flat == 255)
    at = first * (WIDTH * 9 // 8)
    return np.insert(flat, ff + 1, 0).tobytes(), np.append(at + np.searchsorted(ff, at), len(flat) + len(ff))


def decode_scans(scans: list[bytes | memoryview], heights: list[int]) -> np.ndarray:
    """The rows of frames as encode_scans wrote them."""
    data = np.frombuffer(b"".join(scans), np.uint8)
    sizes = np.array([len(x) for x in scans])
    keep = np.ones(len(data), bool)
    keep[1:] = ~((data[1:] == 0) & (data[:-1] == 255))
    keep[(np.cumsum(sizes) - sizes)] = True
    b = data[keep].reshape(-1, 9).astype(np.uint16)
    c = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        c[:, k] = ((b[:, k] & ((1 << (8 - k)) - 1)) << (k + 1)) | (b[:, k + 1] >> (7 - k))
    d = _BACK[c].reshape(-1, WIDTH).astype(np.int32)
    h = np.array(heights)
    first = np.cumsum(h) - h
    if len(d) != h.sum():
        raise ValueError("a scan does not fill its frame")
    lead = np.cumsum(d[:, 0])
    d[:, 0] = lead - np.repeat(lead[first] - d[first, 0], h) + 128
    return np.cumsum(d, axis=1).astype(np.uint8)


class Frame:
    """Markers of one JPEG image."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.tables, self.quant = memoryview(data), {}, {}
        self.restart, self.kind, i = 0, 0, 2
        if bytes(self.data[:2]) != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while True:
            if self.data[i] != 0xFF:
                raise ValueError("a marker is missing")
            kind, size = self.data[i + 1], struct.unpack_from(">H", self.data, i + 2)[0]
            body = bytes(self.data[i + 4 : i + 2 + size])
            i += 2 + size
            if kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif kind == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else np.uint8, 64, 1).astype(np.int64)
                    body = body[1 + 64 * wide :]
            elif kind in (0xC0, 0xC1, 0xC3):
                self.kind = kind
                self.precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif kind == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif kind == 0xDA:
                self.select = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                self.predictor, self.shift = body[-3], body[-1] & 15
                break
            elif kind in (0xC2, *range(0xC5, 0xD0)):
                raise ValueError("neither baseline nor lossless JPEG")
        if not self.kind:
            raise ValueError("a scan without a frame header")
        self._check()
        end = len(self.data) - 2 if bytes(self.data[-2:]) == b"\xff\xd9" else len(self.data)
        self.scan = self.data[i:end]

    def _check(self) -> None:
        """Every sample, or block of samples, takes a bit at least: a header that promises more than the bytes hold is damaged."""
        if not self.height or not self.width or not self.parts:
            raise ValueError("a frame without samples")
        if any(not 1 <= p[1] <= 4 or not 1 <= p[2] <= 4 for p in self.parts) or not 2 <= self.precision <= 16:
            raise ValueError("no such sampling or precision")
        units = self.height * self.width if self.kind == 0xC3 else self.height * self.width / 64
        if units > 8 * len(self.data):
            raise ValueError("the frame's size is more than its bytes hold")
        if any(name not in self.select for name, *_ in self.parts):
            raise ValueError("a component that no scan holds")

    @property
    def nine_bits(self) -> bool:
        return self.kind == 0xC3 and self.width == WIDTH and self.precision == 8 and len(self.parts) == 1 and self.predictor == 1 and not self.shift and not self.restart and self.tables.get(0) == NINE_BITS

    def grey(self) -> np.ndarray:
        """The first component, decoded step by step."""
        if self.nine_bits:
            return decode_scans([self.scan], [self.height])
        if self.restart:
            raise ValueError("restart intervals are not supported")
        bits = _Bits(bytes(self.scan).replace(b"\xff\x00", b"\xff"))
        return self._lossless(bits) if self.kind == 0xC3 else self._baseline(bits)

    def _codes(self, key: int) -> dict[tuple[int, int], int]:
        spec, out, code, k = self.tables[key], {}, 0, 16
        for n in range(1, 17):
            for _ in range(spec[n - 1]):
                out[n, code] = spec[k]
                code, k = code + 1, k + 1
            code <<= 1
        return out

    def _lossless(self, bits: _Bits) -> np.ndarray:
        if len(self.parts) != 1:
            raise ValueError("one component only")
        out = np.zeros((self.height, self.width), np.int64)
        codes = self._codes(next(iter(self.select.values())) >> 4)
        for y in range(self.height):
            for x in range(self.width):
                a, b, c = out[y, x - 1] if x else 0, out[y - 1, x] if y else 0, out[y - 1, x - 1] if x and y else 0
                if not x and not y:
                    guess = 1 << (self.precision - self.shift - 1)
                elif not y:
                    guess = a
                elif not x:
                    guess = b
                else:
                    guess = (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[self.predictor]
                s = bits.symbol(codes)
                out[y, x] = (guess + (32768 if s == 16 else bits.signed(s))) & 0xFFFF
        return (out << self.shift).astype(np.uint8)

    def _baseline(self, bits: _Bits) -> np.ndarray:
        k = np.arange(8)
        basis = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
        top_h, top_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            top_h = top_v = 1
        across, down = -(-self.width // (8 * top_h)), -(-self.height // (8 * top_v))
        first = self.parts[0]
        fh, fv = (1, 1) if len(self.parts) == 1 else first[1:3]
        out = np.zeros((down * fv * 8, across * fh * 8))
        dc = {p[0]: self._codes(self.select[p[0]] >> 4) for p in self.parts}
        ac = {p[0]: self._codes(0x10 | self.select[p[0]] & 15) for p in self.parts}
        last = dict.fromkeys(dc, 0)
        for my in range(down):
            for mx in range(across):
                for name, h, v, q in self.parts:
                    h, v = (1, 1) if len(self.parts) == 1 else (h, v)
                    for by in range(v):
                        for bx in range(h):
                            z = np.zeros(64, np.int64)
                            last[name] += bits.signed(bits.symbol(dc[name]))
                            z[0], i = last[name], 1
                            while i < 64:
                                rs = bits.symbol(ac[name])
                                if rs == 0:
                                    break
                                i += rs >> 4
                                if rs != 0xF0:
                                    z[ZIGZAG[i]] = bits.signed(rs & 15) * self.quant[q][i]
                                i += 1
                            if name == first[0]:
                                z[0] *= self.quant[q][0]
                                y, x = (my * fv + by) * 8, (mx * fh + bx) * 8
                                out[y : y + 8, x : x + 8] = basis @ z.reshape(8, 8) @ basis.T + 128
        return np.clip(np.rint(out[: self.height, : self.width]), 0, 255).astype(np.uint8)


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("the scan ends early")
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        v = 0
        for n in range(1, 17):
            v = v << 1 | self.take(1)
            if (n, v) in codes:
                return codes[n, v]
        raise ValueError("no such code")

    def signed(self, s: int) -> int:
        v = self.take(s)
        return v if s == 0 or v >> (s - 1) else v - (1 << s) + 1
