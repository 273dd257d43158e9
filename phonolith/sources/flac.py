"""FLAC samples, by the public format description (RFC 9639).

A frame is taken apart as a field of bits: Rice codes are found by a table of the
next set bit, so each costs one step, and their values are gathered at once.
Fixed predictors are repeated sums; linear prediction is a recurrence and goes
sample by sample. The stream's own checksum decides whether the result is right.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from operator import mul

import numpy as np

#: Fixed values of frame headers: block sizes, bits a sample (None: as the stream), bytes of a rate that follows.
BLOCK_SIZES = {1: 192, **{n: 576 << n - 2 for n in range(2, 6)}, **{n: 256 << n - 8 for n in range(8, 16)}}
SAMPLE_BITS = {0: None, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
RATE_BYTES = {12: 1, 13: 2, 14: 2}
#: Fixed values of the channel codes: first and second channel are left and side, side and right, mid and side.
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


@dataclass(frozen=True)
class Stream:
    rate: int
    channels: int
    bits: int
    frames: int
    md5: bytes
    #: Where the first frame begins.
    body: int


def stream_of(data: bytes) -> Stream | None:
    """The stream's facts, or None if this is no FLAC file."""
    if data[:4] != b"fLaC" or len(data) < 42 or data[4] & 0x7F:
        return None
    packed, at, last = int.from_bytes(data[18:26], "big"), 4, False
    while not last and at + 4 <= len(data):
        last, at = data[at] >= 0x80, at + 4 + int.from_bytes(data[at + 1 : at + 4], "big")
    return Stream(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, data[26:42], at)


class Bits:
    """The bits of a frame from a byte on; reading goes forward."""

    def __init__(self, data: bytes, at: int, size: int):
        self.data = data[at : at + size]
        self.field = np.unpackbits(np.frombuffer(self.data, np.uint8))
        n, self.at = len(self.field), 0
        # The place of the next 1 at or after each place.
        places = np.where(self.field, np.arange(n), n)
        self.following = np.minimum.accumulate(places[::-1])[::-1].tolist()

    def take(self, n: int) -> int:
        first, end = self.at, self.at + n
        if end > len(self.field):
            raise ValueError("the frame ends early")
        self.at = end
        return int.from_bytes(self.data[first >> 3 : end + 7 >> 3], "big") >> (-end & 7) & (1 << n) - 1

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> n - 1 else value

    def unary(self) -> int:
        """How many 0 stand before the next 1."""
        first = self.at
        self.at = self.following[first] + 1
        return self.at - 1 - first

    def _gathered(self, starts: np.ndarray, width: int) -> np.ndarray:
        if not width:
            return np.zeros(len(starts), np.int64)
        if len(starts) and starts[-1] + width > len(self.field):
            raise ValueError("the frame ends early")
        return self.field[starts[:, None] + np.arange(width)].astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))

    def numbers(self, n: int, width: int) -> np.ndarray:
        """n signed numbers of the same width."""
        found = self._gathered(self.at + width * np.arange(n), width)
        self.at += n * width
        return found - ((found >> width - 1) << width) if width else found

    def rice(self, n: int, parameter: int) -> np.ndarray:
        ends, at, following, step = [], self.at, self.following, parameter + 1
        try:
            for _ in range(n):
                end = following[at]
                ends.append(end)
                at = end + step
        except IndexError:
            raise ValueError("the frame ends early") from None
        last = np.array(ends, np.int64)
        first = np.append(np.int64(self.at), last[:-1] + step) if n else last
        folded = (last - first << parameter) | self._gathered(last + 1, parameter)
        self.at = at
        return (folded >> 1) ^ -(folded & 1)


def _residual(bits: Bits, block: int, order: int) -> np.ndarray:
    method = bits.take(2)
    if method > 1:
        raise ValueError("an unknown residual coding")
    width, parts = 4 + method, 1 << bits.take(4)
    out = []
    for p in range(parts):
        n = block // parts - (order if p == 0 else 0)
        parameter = bits.take(width)
        out.append(bits.numbers(n, bits.take(5)) if parameter == (1 << width) - 1 else bits.rice(n, parameter))
    return np.concatenate(out)


def _subframe(bits: Bits, block: int, width: int) -> np.ndarray:
    head = bits.take(8)
    kind, wasted = head >> 1 & 0x3F, 0
    if head & 1:
        wasted = bits.unary() + 1
        width -= wasted
    if kind == 0:
        out = np.full(block, bits.signed(width), np.int64)
    elif kind == 1:
        out = bits.numbers(block, width)
    elif 8 <= kind <= 12:
        order = kind - 8
        start = [bits.signed(width) for _ in range(order)]
        rest = _residual(bits, block, order)
        # Repeated differences of the first samples are where the repeated sums begin.
        for level in range(order - 1, -1, -1):
            first = np.diff(np.array(start[: level + 1], np.int64), n=level)[0]
            rest = first + np.append(np.int64(0), np.cumsum(rest))
        # Each sum put one value in front.
        out = rest
    elif kind >= 32:
        order = kind - 31
        x = [bits.signed(width) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        weights = [bits.signed(precision) for _ in range(order)][::-1]
        if shift < 0:
            raise ValueError("a negative shift")
        for r in _residual(bits, block, order).tolist():
            x.append(r + (sum(map(mul, weights, x[-order:])) >> shift))
        out = np.array(x, np.int64)
    else:
        raise ValueError(f"an unknown kind of subframe: {kind}")
    return out << wasted


def _frame(data: bytes, at: int, s: Stream) -> tuple[np.ndarray, int]:
    """(block x channels, where the next frame begins)."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFC != 0xF8:
        raise ValueError(f"no frame at {at}")
    size, rate, layout, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if size == 0 or layout > MID_SIDE or depth not in SAMPLE_BITS:
        raise ValueError(f"a reserved value in the frame at {at}")
    # The frame's number has as many bytes as its first one has leading 1 bits.
    lead = data[at + 4]
    after = at + 4 + (1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length())
    if size in (6, 7):
        block, after = int.from_bytes(data[after : after + size - 5], "big") + 1, after + size - 5
    else:
        block = BLOCK_SIZES[size]
    after += RATE_BYTES.get(rate, 0) + 1
    channels = layout + 1 if layout < LEFT_SIDE else 2
    width = SAMPLE_BITS[depth] or s.bits
    # Rice codes of a sensible encoder are not longer than plain samples; if they are, more bytes are taken.
    room = channels * (block * (width + 1) // 8 + 64) + 1024
    while True:
        bits = Bits(data, after, room)
        try:
            own = [_subframe(bits, block, width + ((layout == SIDE_RIGHT and c == 0) or (layout in (LEFT_SIDE, MID_SIDE) and c == 1))) for c in range(channels)]
            break
        except ValueError as error:
            if "ends early" not in str(error) or after + room >= len(data):
                raise
            room *= 4
    if layout == LEFT_SIDE:
        own[1] = own[0] - own[1]
    elif layout == SIDE_RIGHT:
        own[0] = own[0] + own[1]
    elif layout == MID_SIDE:
        both = (own[0] << 1) | (own[1] & 1)
        own = [both + own[1] >> 1, both - own[1] >> 1]
    return np.stack(own, axis=1), after + (bits.at + 7 >> 3) + 2


def decode_whole(data: bytes) -> tuple[np.ndarray, Stream] | None:
    """(whole-number frames x channels, facts), checked by the stream's MD5; None if this is no FLAC file."""
    s = stream_of(data)
    if s is None:
        return None
    at, blocks, total = s.body, [], 0
    while at < len(data) and (not s.frames or total < s.frames):
        block, at = _frame(data, at, s)
        blocks.append(block)
        total += len(block)
    x = np.concatenate(blocks) if blocks else np.zeros((0, s.channels), np.int64)
    size = (s.bits + 7) // 8
    raw = np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
    if any(s.md5) and hashlib.md5(raw).digest() != s.md5:
        raise ValueError("the samples differ from the stream's checksum")
    return x, s


def decode_flac(data: bytes) -> tuple[np.ndarray, int] | None:
    found = decode_whole(data)
    if found is None:
        return None
    x, s = found
    return (x / (1 << s.bits - 1)).astype(np.float32), s.rate
