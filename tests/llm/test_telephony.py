import hashlib
import math
import zlib

import numpy as np
import pytest

from quantloom.llm import common
from quantloom.llm import telephony as t


def test_tables_are_those_of_the_standard():
    mu, a = t.mulaw_table().astype(int), t.alaw_table().astype(int)
    assert (mu[0], mu[127], mu[128], mu[255], mu[0x80 | 0x0F]) == (-32124, 0, 32124, 0, 16764)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    for table in (mu, a):
        assert sorted(table[:128]) == sorted(-table[128:])
    assert len(set(a)) == 256 and len(set(mu)) == 255


def scalar_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            d = step >> 3
            d += step if code & 4 else 0
            d += step >> 1 if code & 2 else 0
            d += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            index = max(0, min(88, index + int(t.MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_against_a_scalar_decoder():
    blocks = np.random.default_rng(2).integers(0, 256, (9, t.BLOCK), dtype=np.uint8)
    assert t.decode_adpcm(blocks).tolist() == [scalar_adpcm(bytes(b)) for b in blocks]


@pytest.mark.parametrize("kind", t.FORMATS)
def test_files_are_lossless(kind):
    codes = bytes(np.random.default_rng(1).integers(0, 256, 3 * t.UNIT, dtype=np.uint8))
    got = t.unpack(t.pack(codes, kind))
    assert got[:2] == (kind, t.RATE) and t.codes_of(kind, got[2]) == codes
    assert t.unpack(b"RIFFxxxxWAVE") is None and t.unpack(None) is None and t.unpack(b"no") is None


def brute_resample(pcm, rate, to):
    import math

    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    taps, out = t._filters(up, down), []
    for i in range(-(-len(pcm) * up // down)):
        base, phase = divmod(i * down, up)
        total = 16384
        for k, c in enumerate(taps[phase]):
            total += int(c) * int(pcm[min(max(base + k - len(taps[0]) // 2 + 1, 0), len(pcm) - 1)])
        out.append(max(-32768, min(32767, total >> 15)))
    return out


@pytest.mark.parametrize("to", [16000, 8000, 4000, 12000, 11025])
def test_resampling(to):
    pcm = (9000 * np.sin(np.arange(400) / 9)).astype(np.int16)
    got = t.resample(pcm, 8000, to)
    assert got.tolist() == (brute_resample(pcm, 8000, to) if to != 8000 else pcm.tolist())
    if to == 16000:
        want = 9000 * np.sin(np.arange(800) / 18)
        assert np.abs(got[20:-20] - want[20:-20]).max() < 150


@pytest.mark.parametrize("to", [2000, 4000])
def test_tones_that_the_new_rate_cant_hold_vanish(to):
    def kept(tone):
        pcm = np.round(12000 * np.sin(2 * np.pi * tone / 8000 * np.arange(16000))).astype(np.int16)
        out = t.resample(pcm, 8000, to).astype(float)[200:-200]
        return np.sqrt((out**2).mean() * 2) / 12000

    half = to / 2
    for f in (0.1, 0.5, 0.7):
        assert kept(f * half) > 0.95
    for f in (1.3, 1.7, 1.95):
        assert kept(f * half) < 0.02


def test_op9_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    rows = t.op9_telephony_audio(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, p = t.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (n, len(p)) and r.payload_bytes % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-16:])
        kind = t.FORMATS[zlib.crc32(p) % 3]
        file = t.pack(p, kind)
        assert r.media_bytes == len(file) and r.media_sha256 == hashlib.sha256(file).hexdigest()
        pcm = np.array([x for at in range(0, len(p), 192) for x in scalar_adpcm(bytes(4) + p[at : at + 192])] if kind == "ima_adpcm" else [int(t._TABLES[kind][c]) for c in p], np.int16)
        assert r.feature == t.features(kind, np.array(brute_resample(pcm, 8000, t.QUERY_RATE)), t.QUERY_RATE)


def test_pcm_that_is_read_back_is_what_was_resampled(spark, odd):
    media = t.encode_media(odd)
    stored = common.materialize(t.read_media(media, 16000), "test-pcm")
    want = {bytes(r.media): bytes(r.pcm) for r in t.with_pcm(media.select("doc_id", "media"), 16000).collect()}
    by = {hashlib.sha256(m).hexdigest(): p for m, p in want.items()}
    rows = stored.collect()
    assert len(rows) == odd.count() and all(bytes(r.pcm) == by[r.media_sha256] for r in rows)
    for r in t.with_features(stored, 16000).collect():
        assert r.feature == t.features(r.feature.split(";")[0], np.frombuffer(by[r.media_sha256], "<i2"), 16000)


def test_columns_named_pcm_stay(spark):
    files = spark.createDataFrame([(1, t.pack(bytes(range(192)), "mulaw"), "mine", 5, "r")], "doc_id long, media binary, PCM string, pcm_rate int, row string")
    out = t.with_pcm(files)
    assert out.columns == ["doc_id", "media", "PCM", "pcm_rate", "row", "pcm_2", "pcm_rate_2"]
    r = out.first()
    assert (r.PCM, r.pcm_rate, r.row, r.pcm_rate_2, len(r.pcm_2)) == ("mine", 5, "r", 16000, 768)


def test_odd_rows_and_pcm(spark, odd, none):
    media = t.encode_media(odd)
    rows = t.read_media(media).collect()
    assert len(rows) == odd.count() and min(r.payload_bytes for r in rows) == 192
    featured = t.with_features(t.read_media(media), t.OUT_RATE).collect()
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in featured}) == len({r.payload_sha256 for r in rows})
    out = t.with_pcm(odd.select("text", "doc_id").join(media.select("doc_id", "media").dropDuplicates(), "doc_id"))
    assert out.columns == ["doc_id", "text", "media", "pcm", "pcm_rate"]
    for r in out.collect():
        f = t.unpack(bytes(r.media))
        assert len(r.pcm) == 2 * 2 * len(t.expand([f])[0]) and r.pcm_rate == 16000
    broken = spark.createDataFrame([(1, 3, b"junk"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r.payload_bytes for r in t.read_media(broken).collect()] == [None, None]
    assert [r.pcm for r in t.with_pcm(broken).collect()] == [None, None]
    assert t.read_media(t.encode_media(none)).count() == 0 and t.with_pcm(t.encode_media(none)).count() == 0


def test_op9_stores_pcm_at_the_full_rate(spark, sf):
    """Features are of 16,000 samples a second, as many as the coded samples give; scratch holds one slice's PCM at most."""
    for r in t.op9_telephony_audio(spark, sf).select("payload_bytes", "feature").collect():
        kind, rate, n = r.feature.split(";")[:3]
        coded = r.payload_bytes if kind != "ima_adpcm" else r.payload_bytes // t.UNIT * t.BLOCK_SAMPLES
        assert int(rate) == t.OUT_RATE == 2 * t.RATE and int(n) == 2 * coded


def test_sums_in_32_bits_are_exact():
    rng = np.random.default_rng(5)
    for pcm in (np.where(rng.random(4000) < 0.5, -32768, 32767).astype(np.int16), rng.integers(-32768, 32768, 999).astype(np.int16), np.full(50, -32768, np.int16)):
        for to in (16000, 2000, 11025):
            assert t.resample(pcm, 8000, to).tolist() == brute_resample(pcm, 8000, to)
        x = pcm.astype(object)
        told = t.features("mulaw", pcm, 16000).split(";")
        assert int(told[4]) == math.isqrt(int((x * x).sum()) // len(x)) and int(told[3]) == int(abs(x).max())
