import numpy as np
import pytest
from phonolith.plans.audio_queries import flac_file
from phonolith.sources import codecs, flac

KINDS = ["fixed0", "fixed1", "fixed2", "fixed3", "fixed4", "linear", "verbatim"]


def signal(seed, n, channels, bits=16):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.integers(-90, 91, (n, channels)), axis=0) + rng.integers(-3, 4, (n, channels))
    x[n // 3 : n // 2] = 5
    return np.clip(x, -(1 << bits - 1), (1 << bits - 1) - 1)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("layout", [None, 8, 9, 10])
def test_every_subframe_and_layout(kind, layout):
    x = signal(3, 1500, 2)
    found, facts = flac.decode_whole(flac_file(x, 44100, 256, [kind], layout))
    assert np.array_equal(found, x) and (facts.rate, facts.channels, facts.bits, facts.frames) == (44100, 2, 16, 1500)


@pytest.mark.parametrize("n,channels,bits,block", [(1, 1, 16, 16), (5, 1, 24, 16), (1000, 3, 24, 333), (70_000, 1, 16, 4096), (300, 8, 16, 64)])
def test_sizes_channels_and_depths(n, channels, bits, block):
    x = signal(4, n, channels, bits)
    data = flac_file(x, 96000, block, KINDS, bits=bits)
    y, rate = codecs.decode(data, "flac")
    assert rate == 96000 and np.array_equal(np.rint(y.astype(np.float64) * (1 << bits - 1)), x)
    assert codecs.facts_of(data, "flac") == codecs.Facts(96000, channels, bits, n)


def test_extreme_samples_need_long_codes():
    x = np.tile(np.array([[32767], [-32768]]), (200, 1))
    for kind in KINDS:
        assert np.array_equal(flac.decode_whole(flac_file(x, 8000, 100, [kind]))[0], x)


def test_damage_is_an_error():
    x = signal(5, 900, 1)
    data = bytearray(flac_file(x, 8000, 300, ["fixed2"]))
    with pytest.raises(ValueError):
        flac.decode_whole(bytes(data[:-40]))
    data[120] ^= 0x10
    with pytest.raises(ValueError):
        flac.decode_whole(bytes(data))
    assert flac.decode_flac(b"RIFF") is None and codecs.facts_of(b"fLaC", "flac") is None
    with pytest.raises(ValueError):
        codecs.decode(b"fLaC but not really", "flac")


def test_no_samples_are_an_error():
    with pytest.raises(ValueError):
        codecs.decode(flac_file(np.zeros((0, 1), np.int64), 8000, 100, ["fixed0"]), "flac")
