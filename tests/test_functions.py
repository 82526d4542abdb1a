import io
import struct
import unicodedata
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import audio, docx, identity, text, vectors
from lodestone.plans.reference import MAGIC
from lodestone.profiles import active_profiles, canonical_json, find_profile, profile_id, registry
from lodestone.types import LodestoneError

SAMPLES = ["a", "abc abc", "naïve — 価格 🙂 x", "é\r\nb\rc", "﻿BOM", "word " * 40]


def scalar_counts(s: str) -> np.ndarray:
    """The definition, one gram at a time."""
    out = np.zeros(4096)
    for n in range(1, 6):
        for i in range(len(s) - n + 1):
            h = text.FNV_OFFSET
            for byte in bytes([n]) + s[i : i + n].encode():
                h = (h ^ byte) * text.FNV_PRIME % (1 << 64)
            out[h & 4095] += 1 if h >> 63 == 0 else -1
    return out


@pytest.mark.parametrize("s", SAMPLES)
def test_gram_counts_equal_the_definition(s):
    clean = text.normalize(s)
    assert np.array_equal(text.gram_counts(clean), scalar_counts(clean))


def test_random_texts_and_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(10):
        s = "".join(chr(c) for c in rng.choice([65, 0xE9, 0x4E00, 0x1F600, 10], 30))
        assert np.array_equal(text.gram_counts(s), scalar_counts(s))
    long = "abc défg 🙂 " * 20
    monkeypatch.setattr(text, "PIECE", 37)
    assert np.array_equal(text.gram_counts(long), scalar_counts(long))


def test_normalisation_is_safe_at_boundaries():
    a = "a" * 8190 + "é\r\n"
    b = "﻿" + "a" * 8190 + "é\n"
    assert np.array_equal(text.encode_text(a)[0], text.encode_text(b.encode())[0])
    assert text.normalize("﻿﻿x") == "﻿x"
    assert text.normalize("\r\n\n") == "\n\n"


@pytest.mark.parametrize("content,code", [(b"a\xff", "invalid_text"), (b" \n", "insufficient_content"), (b"", "insufficient_content"), (b"a\0b", "invalid_text"), (b"\xed\xa0\x80", "invalid_text"), (b"\xc0\x80", "invalid_text"), ("a" + "́" * 1025, "invalid_text"), (None, "io_error")])
def test_text_failures_are_values(content, code):
    out = text.text_outcome(content)
    assert (out["state"], out["error"], out["vector"]) == ("failed", code, None)


def test_marks_within_the_limit_pass():
    assert text.text_outcome("a" + "́" * 1024)["state"] == "ready"
    assert text.text_outcome("\x1c\x1d")["state"] == "ready"  # separators are no White_Space


def test_similar_texts_are_closer():
    cos = lambda a, b: float(text.encode_text(a)[0].astype(float) @ text.encode_text(b)[0].astype(float))
    assert cos("Im human!", "I'm human!") > cos("Im human!", "Trains leave at noon.")
    assert cos("1.25", "125") < 0.999
    assert abs(np.linalg.norm(text.encode_text("unit")[0]) - 1) < 1e-6


def test_catalyst_features_equal_the_kernel(spark):
    df = spark.createDataFrame([(i, text.normalize(s)) for i, s in enumerate(SAMPLES)], "i long, s string")
    rows = df.select("i", F.explode(text.grams(F.col("s"))).alias("g")).select("i", text.gram_feature(F.col("g")).alias("f")).groupBy("i", "f.bucket").agg(F.sum("f.sign").alias("n")).collect()
    for i, s in enumerate(SAMPLES):
        want = scalar_counts(text.normalize(s))
        got = np.zeros(4096)
        for r in rows:
            if r.i == i:
                got[r.bucket] = r.n
        assert np.array_equal(got, want)


def test_grams_of_short_and_empty_text(spark):
    df = spark.createDataFrame([("",), ("ab",), (None,)], "s string").select(text.grams(F.col("s")).alias("g"))
    assert [r.g for r in df.collect()] == [[], ["a", "b", "ab"], []]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0]), ([float("nan"), 1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    c, n, ok = zip(*[(r.c, r.n, r.ok) for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.l2_normalize(F.col("a")).alias("n"), vectors.is_valid(vectors.l2_normalize(F.col("a")), F.lit(2)).alias("ok")).collect()])
    assert c[0] == pytest.approx(0.96) and c[1] is c[2] is c[3] is None
    assert n[0] == pytest.approx([0.6, 0.8]) and n[1] is n[3] is n[4] is None
    assert ok == (True, False, False, False, False)


def test_vector_digest(spark):
    import hashlib

    want = hashlib.sha256(struct.pack("<2f", 0.5, -2)).hexdigest()
    rows = spark.createDataFrame([([0.5, -2.0],), (None,)], "v array<float>").select(vectors.vector_sha256("v").alias("d")).collect()
    assert [r.d for r in rows] == [want, None]


KINDS = {
    "a.pdf": "text/pdf", "a.zip": "text/docx", "a.gz": "unknown/archive", "a.7z": "unknown/archive", "a.rar": "unknown/archive", "a.jpg": "image/raster", "named.heic": "image/raster", "prose.txt": "image/raster",
    "a.webp": "image/raster", "a.wav": "audio/media", "a.avi": "video/media", "a.riff": "unknown/riff", "a.mp3": "audio/media", "b.mp3": "audio/media", "a.ogv": "video/media", "a.oga": "audio/media",
    "a.mp4": "video/media", "a.heic": "image/heif_avif", "b.avif": "image/heif_avif", "a.m4a": "audio/media", "a.mkv": "video/media", "a.flv": "video/media", "code.ts": "text/utf8", "a.tga": "image/tga", "empty": "text/utf8", "a.mov": "video/media",
}


def test_sniff(spark):
    df = spark.createDataFrame([(n, bytearray.fromhex(h)) for n, h in MAGIC.items()] + [("x.MP4", b"zz"), (".mp4", b"zz"), (None, b"zz"), ("n", None), ("ts", b"G" + bytes(187) + b"G" + bytes(187) + b"G")], "n string, c binary")
    kind = identity.sniff(F.col("c"), F.col("n"))
    got = {r.n: r.k for r in df.select("n", F.concat_ws("/", kind["family"], kind["format"]).alias("k")).collect()}
    assert got == KINDS | {"x.MP4": "video/media", ".mp4": "text/utf8", None: "text/utf8", "n": "unknown/unreadable", "ts": "video/media"}


def test_paths(spark):
    df = spark.createDataFrame([("a-b",), ("a/b",), ("a",)], "p string")
    assert [r.p for r in df.orderBy(identity.path_order(F.col("p"))).collect()] == ["a", "a/b", "a-b"]
    js = spark.createDataFrame([(bytearray(b'q"\xc3\xa9'),), (bytearray(b"\xff"),)], "b binary").select(identity.path_json(F.col("b")).alias("j")).collect()
    assert [r.j for r in js] == ['"q\\"é"', '{"encoding":"posix_bytes","base64":"/w=="}']


def tone(f, seconds=3.0, rate=16000):
    t = np.arange(int(seconds * rate)) / rate
    return (np.sin(2 * np.pi * f * t + 3 * np.sin(2 * np.pi * 0.7 * t)) * 0.5).astype(np.float32)


def noise(seed):
    return np.random.default_rng(seed).uniform(-0.5, 0.5, 48000).astype(np.float32)


def tones(**strength):
    """Tones that fall on whole bins, named b<bin>: each is a peak of its own bin alone."""
    t = np.arange(4096) / 1024
    return sum(a * np.sin(2 * np.pi * int(k[1:]) * t) for k, a in strength.items()).astype(np.float32)


@pytest.mark.parametrize(
    "made,want",
    [
        ({"b20": 0.5, "b61": 0.3, "b100": 0.2}, [10, 30, 50]),
        ({"b100": 0.5, "b61": 0.3, "b20": 0.2}, [50, 30, 10]),  # the strongest first
        ({"b20": 0.30, "b50": 0.28, "b80": 0.26, "b110": 0.24, "b140": 0.22, "b170": 0.2}, [10, 25, 40, 55, 70]),  # five at most
        ({"b20": 0.5, "b61": 0.05}, [10]),  # below a share of the strongest
        ({"b20": 0.5, "b23": 0.4, "b61": 0.3}, [10, 30]),  # too near a stronger one
        ({"b3": 0.5, "b61": 0.3, "b300": 0.5}, [30]),  # outside the band
        ({"b20": 0.0}, []),
    ],
)
def test_peaks_of_known_spectra(made, want):
    found = audio.peaks(tones(**made))
    assert len(found) == 13 and all([int(v) for v in row if v >= 0] == want for row in found)


def test_audio_sketch():
    assert audio.landmarks(np.zeros(16000, np.float32), np.zeros(4096)) == 0
    a, b = (audio.encode_samples(tone(f))[0].astype(float) for f in (440, 900))
    assert audio.landmarks(tone(440), np.zeros(4096)) > 32 and abs(a @ b) < 0.2
    n, m = (audio.encode_samples(noise(s))[0].astype(float) for s in (1, 9701))
    assert abs(n @ m) < 0.3 and abs(n @ n - 1) < 1e-6
    with pytest.raises(text.TextFailure):
        audio.encode_samples(np.zeros(16000, np.float32))
    with pytest.raises(text.TextFailure):
        audio.encode_samples(np.zeros(0, np.float32))


def wav(samples, width=2, rate=16000):
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((samples * 32767).astype("<i2").tobytes())
    return f.getvalue()


def test_wav_reader():
    x, rate = audio.read_pcm(wav(tone(440)))
    assert rate == 16000 and np.abs(x - tone(440)).max() < 1e-3
    for bad in (b"RIFF....WAVE", b"FORM....AIFF", b".snd", b"caff\0\1\0\0", b"RIFF....WAVEfmt \x10\0\0\0short", wav(tone(440))[:30]):
        with pytest.raises(text.TextFailure) as e:
            audio.read_pcm(bad)
        assert e.value.code == "decode_failed"


def test_other_rates_are_resampled():
    want = audio.encode_samples(tone(440))[0].astype(float)
    t = np.arange(3 * 44_100) / 44_100
    other = (np.sin(2 * np.pi * 440 * t + 3 * np.sin(2 * np.pi * 0.7 * t)) * 0.5).astype(np.float32)
    assert audio.encode_samples(other, 44_100)[0].astype(float) @ want > 0.8
    assert np.abs(audio.resample(other, 44_100)[400:-400] - tone(440)[400:-400]).max() < 0.02
    assert len(audio.resample(np.zeros(0, np.float32), 8000)) == 0


def test_windows():
    assert audio.windows(3.0) == [(0.0, 3.0)]
    spans = audio.windows(1000.0)
    assert len(spans) == 32 and all(length == 8.0 for _, length in spans)
    assert audio.windows(0) == audio.windows(float("nan")) == []


BODY = '<d:document xmlns:d="http://purl.oclc.org/ooxml/wordprocessingml/main"><d:body><d:p><d:r><d:t>Tom &amp; Ann&#33;</d:t><d:tab/><d:t>more</d:t><d:br/></d:r><d:del><d:r><d:t>gone</d:t><d:tab/></d:r></d:del></d:p></d:body></d:document>'


def package(xml, names=("[Content_Types].xml", "word/document.xml"), comment=b""):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for n in names:
            z.writestr(n, xml)
        z.comment = comment
    return f.getvalue()


def test_docx():
    assert docx.docx_text(package(BODY)) == docx.docx_text(package(BODY, comment=b"some comment")) == "Tom & Ann!\tmore\n\n"
    word = "http://purl.oclc.org/ooxml/wordprocessingml/main"
    whole = '<d:document xmlns:d="' + word + '">{}</d:document>'
    deep = whole.format("<d:body>" + "<d:p>" * 300 + "</d:p>" * 300 + "</d:body>")
    outside = whole.format("<d:t>before</d:t><d:body><d:p><d:t>in</d:t></d:p></d:body><d:t>after</d:t><d:body><d:t>second</d:t></d:body>")
    assert docx.docx_text(package(outside)) == "in\n"
    volumes = bytearray(package(BODY))
    volumes[-18] = 1
    cases = {
        "no parts": (package(BODY, ("a",)), "unsupported_format"),
        "no directory": (b"PK\3\4", "decode_failed"),
        "trailing bytes": (package(BODY) + b"x", "decode_failed"),
        "volumes": (bytes(volumes), "unsupported_format"),
        "document type": (package("<!DOCTYPE a><a/>"), "decode_failed"),
        "cut off": (package(whole[:-20]), "decode_failed"),
        "other root": (package(f'<w:p xmlns:w="{word}"><w:t>hi</w:t></w:p>'), "decode_failed"),
        "other namespace": (package("<document><body/></document>"), "decode_failed"),
        "no body": (package(whole.format("")), "decode_failed"),
        "too deep": (package(deep), "resource_budget_too_small"),
    }
    for name, (bad, code) in cases.items():
        with pytest.raises(text.TextFailure) as e:
            docx.docx_text(bad)
        assert e.value.code == code, name


def test_profiles():
    assert canonical_json({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}'
    with pytest.raises(ValueError):
        canonical_json({"a": "é"})
    ids = [p.profile_id for p in registry()]
    assert len(set(ids)) == len(ids) and all(profile_id(p.manifest) == p.profile_id for p in registry())
    assert set(active_profiles("cuda")) == {"text", "image", "audio", "video"}
    assert find_profile(ids[0]).status == "historic"
    assert unicodedata.unidata_version in canonical_json(registry()[0].manifest)
    for bad in (lambda: find_profile("x"), lambda: active_profiles("abacus")):
        with pytest.raises(LodestoneError):
            bad()
