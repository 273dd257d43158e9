"""RIFF/WAVE bytes: header facts, linear PCM in, float files with loop points out."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: WAVE format numbers.
PCM, IEEE_FLOAT = 1, 3


@dataclass(frozen=True)
class WavHeader:
    audio_format: int
    channels: int
    sample_rate: int
    block_align: int
    bits_per_sample: int
    data_offset: int
    data_size: int

    @property
    def frames(self) -> int:
        return self.data_size // self.block_align if self.block_align else 0

    @property
    def duration_ms(self) -> int | None:
        return self.frames * 1000 // self.sample_rate if self.sample_rate and self.block_align else None


def sniff(data: bytes) -> WavHeader | None:
    """The header, or None if this is no WAVE file with a format chunk; without a data chunk its size is 0."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, fmt, body = 12, None, (0, 0)
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            fmt = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            body = (at + 8, min(size, len(data) - at - 8))
        if fmt and body[0]:
            break
        at += 8 + size + size % 2
    if fmt is None:
        return None
    kind, channels, rate, _, align, bits = fmt
    return WavHeader(kind, channels, rate, align, bits, *body)


def decode_linear(data: bytes) -> tuple[np.ndarray, int] | None:
    """(float32 frames x channels, sample rate), or None if another decoder is needed."""
    h = sniff(data)
    if h is None or not h.channels or not h.data_offset or h.channels * (h.bits_per_sample // 8) != h.block_align:
        return None
    if (h.audio_format, h.bits_per_sample) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (IEEE_FLOAT, 32)}:
        return None
    raw = data[h.data_offset : h.data_offset + h.frames * h.block_align]
    if h.audio_format == IEEE_FLOAT:
        x = np.frombuffer(raw, "<f4").astype(np.float32)
    elif h.bits_per_sample == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif h.bits_per_sample == 16:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif h.bits_per_sample == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608).astype(np.float32)
    else:
        x = (np.frombuffer(raw, "<i4") / 2147483648).astype(np.float32)
    return x.reshape(-1, h.channels), h.sample_rate


#: Decoders for other formats: extension -> function of the bytes. None are bundled.
DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, int]]] = {}


def decode(data: bytes, extension: str) -> tuple[np.ndarray, int]:
    found = decode_linear(data) if extension == "wav" else None
    if found is None and extension in DECODERS:
        found = DECODERS[extension](data)
    if found is None:
        raise ValueError(f"no decoder for this {extension or 'unnamed'} file")
    if not found[0].size:
        raise ValueError("no audio samples")
    return found


def smpl_chunk(rate: int, first: int, last: int) -> bytes:
    """One forward loop without end; first and last frame are both part of it."""
    head = struct.pack("<9I", 0, 0, 1_000_000_000 // max(1, rate), 60, 0, 0, 0, 1, 0)
    return b"smpl" + struct.pack("<I", 60) + head + struct.pack("<6I", 0, 0, first, last, 0, 0)


def float_wav(x: np.ndarray, rate: int, loop: tuple[int, int] | None = None) -> bytes:
    """A 32-bit float WAVE file, with a loop chunk after the data if given."""
    channels = x.shape[1]
    body = np.ascontiguousarray(x, "<f4").tobytes()
    tail = smpl_chunk(rate, *loop) if loop else b""
    fmt = struct.pack("<HHIIHH", IEEE_FLOAT, channels, rate, rate * channels * 4, channels * 4, 32)
    return b"RIFF" + struct.pack("<I", 36 + len(body) + len(tail)) + b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body + tail
