import hashlib
import zlib

import numpy as np

from tracewright.llm import media

ROWS = [(1, "abc" * 100, 7), (2, None, 7), (3, "", 7), (4, "é" * 64, 7), (4, "é" * 64, 7), (5, "long text " * 60_000, 7)]


def test_round_trip_and_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_bytes int")
    got = media.media_columns(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        data = (dict((k, t) for k, t, _ in ROWS)[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(payload) + 44
    four = [tuple(r) for r in got if r.doc_id == 4]
    assert four[0] == four[1]
    stored = {r.doc_id: bytes(r.media) for r in media.encode_media(docs).collect()}
    assert media.from_wav(stored[1])[:300] == b"abc" * 100
    assert media.media_columns(docs.where("false")).count() == 0


def test_a_tone_peaks_at_its_bin():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * t / media.FRAME)).astype(np.uint8)
    bins = media.peak_bins(tone)
    assert (bins[1:-1, 0] == 40).all()
    codes = media.pair_codes(bins)
    assert (np.diff(codes) >= 0).all() and ((codes >> 11) & 511)[0] == 40


def test_blocks_do_not_change_the_peaks():
    rng = np.random.default_rng(5)
    s = rng.integers(0, 256, media.HOP * 50, dtype=np.uint8)
    one = media.peak_bins(s)
    old, media._BLOCK = media._BLOCK, 7
    try:
        assert (media.peak_bins(s) == one).all()
    finally:
        media._BLOCK = old


def test_peaks_and_pairs_match_a_direct_transform():
    rng = np.random.default_rng(7)
    for n in (64, 512, 513, 2000):
        s = rng.integers(0, 256, n, dtype=np.uint8)
        frames = max(1, -(-max(0, n - media.FRAME) // media.HOP) + 1)
        k = np.arange(media.FRAME)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * k / (media.FRAME - 1))
        waves = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), k) / media.FRAME)
        tops = []
        for f in range(frames):
            part = [float(s[i]) if i < n else 128.0 for i in range(f * media.HOP, f * media.HOP + media.FRAME)]
            power = np.abs(waves @ ((np.array(part) - np.mean(part)) * window))
            peaks = [i for i in range(1, len(power) - 1) if power[i] > power[i - 1] and power[i] >= power[i + 1]]
            tops.append(sorted(peaks, key=lambda i: -power[i])[: media.PEAKS])
        bins = media.peak_bins(s)
        assert [[int(b) for b in row if b] for row in bins] == tops
        want = sorted(f << 20 | a << 11 | tops[f + d][0] << 2 | d for f in range(frames) for a in tops[f] for d in range(1, media.REACH + 1) if f + d < frames and tops[f + d])
        assert media.pair_codes(bins).tolist() == want
