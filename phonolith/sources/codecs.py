"""Header facts of audio files beyond WAVE, and AIFF and FLAC samples.

Ogg Vorbis and MP3 tell rate, channels and (mostly) length in plain bytes; their
samples need a decoder that plugs into ``wav.DECODERS``. FLAC's are in ``flac``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from phonolith.sources import flac, wav

#: Fixed values of MPEG layer III headers: rates of version 1, kbit/s of versions 1 and 2.
MP3_RATES = (44100, 48000, 32000)
MP3_KBITS_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MP3_KBITS_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
#: AIFC compressions that are linear samples -> byte order.
AIFC_LINEAR = {b"NONE": ">", b"twos": ">", b"sowt": "<"}


@dataclass(frozen=True)
class Facts:
    sample_rate: int | None
    channels: int | None
    bit_depth: int | None
    frames: int | None

    @property
    def duration_ms(self) -> int | None:
        return self.frames * 1000 // self.sample_rate if self.frames is not None and self.sample_rate else None


def _extended(raw: bytes) -> int:
    """The whole part of an 80-bit float that is not negative."""
    exponent, mantissa = struct.unpack(">HQ", raw)
    shift = 16383 + 63 - (exponent & 0x7FFF)
    return mantissa >> shift if 0 <= shift < 64 else 0


def aiff_parts(data: bytes) -> tuple[Facts, str, bytes] | None:
    """(facts, byte order, sample bytes), or None if this is no linear AIFF file."""
    if len(data) < 12 or data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        return None
    at, facts, order, body = 12, None, ">", b""
    while at + 8 <= len(data):
        name, size = struct.unpack_from(">4sI", data, at)
        if name == b"COMM" and size >= 18 and at + 26 <= len(data):
            channels, frames, bits = struct.unpack_from(">HIH", data, at + 8)
            facts = Facts(_extended(data[at + 16 : at + 26]), channels, bits, frames)
            if data[8:12] == b"AIFC":
                order = AIFC_LINEAR.get(data[at + 26 : at + 30], "")
        elif name == b"SSND" and size >= 8 and at + 16 <= len(data):
            (offset,) = struct.unpack_from(">I", data, at + 8)
            body = data[at + 16 + offset : at + 8 + size]
        at += 8 + size + size % 2
    return (facts, order, body) if facts else None


def decode_aiff(data: bytes) -> tuple[np.ndarray, int] | None:
    parts = aiff_parts(data)
    if parts is None:
        return None
    facts, order, body = parts
    width = (facts.bit_depth + 7) // 8
    if not order or not facts.channels or width not in (1, 2, 3, 4):
        return None
    body = body[: len(body) // (width * facts.channels) * width * facts.channels]
    raw = np.frombuffer(body, np.uint8).reshape(-1, width)
    # Each sample's bytes as the high ones of a 32-bit number.
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, :width] = raw if order == ">" else raw[:, ::-1]
    x = (wide.view(">i4")[:, 0] / 2147483648).astype(np.float32)
    return x.reshape(-1, facts.channels), facts.sample_rate


def flac_facts(data: bytes) -> Facts | None:
    """From the stream info block, which comes first."""
    s = flac.stream_of(data)
    return s and Facts(s.rate, s.channels, s.bits, s.frames or None)


def vorbis_facts(data: bytes) -> Facts | None:
    """Rate and channels of the first page, length by the last page's position."""
    at = data.find(b"\x01vorbis", 0, 512)
    if data[:4] != b"OggS" or at < 0 or at + 16 > len(data):
        return None
    channels, rate = struct.unpack_from("<BI", data, at + 11)
    last = data.rfind(b"OggS")
    frames = struct.unpack_from("<q", data, last + 6)[0] if last + 14 <= len(data) else -1
    return Facts(rate, channels, None, frames if frames >= 0 else None)


def mp3_start(data: bytes) -> int:
    """Where the first frame begins, after a tag."""
    return 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]) if data[:3] == b"ID3" and len(data) >= 10 else 0


def mp3_facts(data: bytes, size: int | None = None) -> Facts | None:
    """From the first frame; the length by its count of frames if it has one, else by its bit rate.

    size: of the frames, if data is only their beginning.
    """
    at = mp3_start(data) if size is None else 0
    size = len(data) - at if size is None else size
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE6 != 0xE2:
        return None
    version, kbits, rate, mode = data[at + 1] >> 3 & 3, data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 3] >> 6
    if version == 1 or rate == 3 or kbits in (0, 15):
        return None
    hz = MP3_RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    channels, per_frame = 1 if mode == 3 else 2, 1152 if version == 3 else 576
    info = at + 4 + ((17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17))
    if data[info : info + 4] in (b"Xing", b"Info") and info + 12 <= len(data) and data[info + 7] & 1:
        frames = struct.unpack_from(">I", data, info + 8)[0] * per_frame
    else:
        frames = size * 8 * hz // ((MP3_KBITS_1 if version == 3 else MP3_KBITS_2)[kbits] * 1000)
    return Facts(hz, channels, None, frames)


def _wav_facts(data: bytes) -> Facts | None:
    h = wav.sniff(data)
    return h and Facts(h.sample_rate, h.channels, h.bits_per_sample, h.frames if h.block_align else None)


def _aiff_facts(data: bytes) -> Facts | None:
    parts = aiff_parts(data)
    return parts and parts[0]


#: Formats whose facts lie at the edges of a file.
BY_EDGES = ("ogg", "mp3")
EDGE_BYTES = 65_536


def edge_facts(size: int, read: Callable[[int, int], bytes], extension: str) -> Facts | None:
    """Header facts from parts of a file: read gives the bytes at an offset."""
    head = read(0, EDGE_BYTES)
    if extension == "mp3":
        at = mp3_start(head)
        return mp3_facts(head[at:] if at + 512 <= len(head) else read(at, 512), size - at) if at <= size else None
    if size <= 2 * EDGE_BYTES:
        return vorbis_facts(read(0, size))
    # A page is at most 65,307 bytes, so the last one begins in the tail.
    return vorbis_facts(head + read(size - EDGE_BYTES, EDGE_BYTES))


READERS = {"wav": _wav_facts, "aiff": _aiff_facts, "aif": _aiff_facts, "flac": flac_facts, "ogg": vorbis_facts, "mp3": mp3_facts}


def facts_of(data: bytes, extension: str) -> Facts | None:
    """Header facts, or None if the file is not what its extension says."""
    reader = READERS.get(extension)
    return reader and reader(data)


def decode(data: bytes, extension: str) -> tuple[np.ndarray, int]:
    """(float32 frames x channels, sample rate); an error if no decoder reads the file."""
    own = {"aiff": decode_aiff, "aif": decode_aiff, "flac": flac.decode_flac}.get(extension)
    found = own and own(data)
    return found if found is not None and found[0].size else wav.decode(data, extension)
