"""BPE codec, token counts, Ogg: exact round trips and comparisons with the libraries."""

import base64
import os
import random

import pytest

from geomill.llm import bpe_codec, ogg_media, token_counts

public = pytest.importorskip("public_tokenizers")

ALPHABET = "aabbcdefeiotnrs  \n\t'éèüßñ漢字かな한글😀👍🏽́‍0123456789.,!?$#ＡΣσς"


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(bpe_codec.read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_library(codec, library):
    r = random.Random(1)
    tokens = list(codec.ranks)
    for k in range(3000):
        s = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) if k % 2 else b"".join(r.choice(tokens) for _ in range(r.randint(1, 10))).decode("utf8", "ignore")
        ids = codec.encode(s)
        assert ids == library.encode_ordinary(s)
        assert codec.decode(ids) == s.encode()


@pytest.mark.parametrize("s", ["a" * 20_000, "ab" * 9_000, "漢" * 9_000, "!" * 15_000, "x" + " " * 9_000])
def test_codec_long_matches(codec, library, s):
    assert codec.encode(s) == library.encode_ordinary(s)


def test_codec_frames(spark):
    df = spark.createDataFrame([(1, "hello world", "a"), (2, None, "b"), (3, "", "c"), (None, "é" * 5000, "d"), (1, "hello world", "a")], "doc_id bigint, text string, n_tokens string")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    out = bpe_codec.encode_digest(df, path, public.PATTERN).collect()
    assert len(out) == 5 and all(r.round_trip for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}
    arrays = {(r.doc_id, r.n_tokens): r.ids for r in bpe_codec.encode_digest(df, path, public.PATTERN, with_ids=True).collect()}
    assert all(len(ids) == n for (_, n), ids in arrays.items()) and arrays[2, 0] == []
    back = bpe_codec.decode_ids(bpe_codec.encode_ids(df, path, public.PATTERN), path, public.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe_codec.encode_digest(df.limit(0), path, public.PATTERN).count() == 0


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    parts = [*ALPHABET, "<|endoftext|>", "'s", "'LL", "\x1c", "\x85", "\xa0", "\x0b", "\x0c", "\r", "İ", "ΑΣ ", "<|startoftext|> "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["word " * 30_000, "a" * 50_000, "", None]
    path = public.path("word_bpe_49k.json")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {x.doc_id: x for x in token_counts.count_tokens(df, path).collect()}
    t = Tokenizer.from_file(path)
    want = [len(e) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for i, n in enumerate(want):
        assert (out[i].n_tokens, out[i].over_limit, out[i].n_bytes) == (n, n > 2048, len((texts[i] or "").encode()))
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_other_tokenizers_get_whole_texts(spark):
    """A byte-level tokenizer takes white space into its tokens, so its texts aren't cut."""
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert token_counts.Counter(public.path("word_bpe_49k.json")).cuts and not token_counts.Counter(path).cuts
    texts = ["a  b\n\nc", " lead and trail  ", "", None, "word " * 3000]
    out = {x.doc_id: x.n_tokens for x in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path).collect()}
    assert [out[i] for i in range(len(texts))] == [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


def test_batches_hold_all_pieces():
    pieces = [b"x" * n for n in (1, 5, 300, 2, 90, 1000)]
    made = list(token_counts.batches(pieces, 300))
    assert sorted(p for b in made for p in b) == sorted(pieces)
    assert all(sum(map(len, b)) <= 300 or len(b) == 1 for b in made)


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_page_checksum():
    for n in (0, 1, 27, 300):
        x = os.urandom(n)
        assert ogg_media.page_crc(x) == slow_crc(x)


@pytest.mark.parametrize("n", [0, 1, 254, 255, 576, 4608, 4609, 100_000, 300_001])
def test_ogg_round_trip(n):
    raw = random.Random(n).randbytes(n)
    payload = ogg_media.padded(raw)
    assert len(payload) % 576 == 0 and len(payload) >= max(576, n)
    d = ogg_media.demux(ogg_media.encode(payload))
    assert ogg_media.samples(d) == (payload, ogg_media.RATE, len(payload)) and d.damaged == d.lost == 0
    times = ogg_media.timestamps(d)
    assert times[0][1] == 0 and times[-1][2] == len(payload) / ogg_media.RATE
    assert all(a[2] == b[1] for a, b in zip(times, times[1:], strict=False))


def test_ogg_damage_is_seen():
    media = bytearray(ogg_media.encode(ogg_media.padded(os.urandom(200_000))))
    media[len(media) // 2] ^= 1
    d = ogg_media.demux(bytes(media))
    assert d.damaged == 1 and d.lost >= 1 and ogg_media.index_faults(d) >= 1
    sound = bytearray(ogg_media.encode(ogg_media.padded(os.urandom(200_000))))
    assert ogg_media.index_faults(ogg_media.demux(bytes(sound))) == 0
    found, _ = ogg_media.pages(bytes(sound))
    p = next(x for x in found if x.serial == ogg_media.SAMPLES and x.number == 1)
    forged = ogg_media.page(p.flags, p.granule, p.serial, p.number, p.lacing, b"\0" * len(p.body))  # a right page checksum over other samples
    at = sound.find(p.body) - 27 - len(p.lacing)
    sound[at : at + len(forged)] = forged
    d = ogg_media.demux(bytes(sound))
    assert d.damaged == 0 and ogg_media.index_faults(d) == 1
    assert ogg_media.demux(b"").pages == 0
    again = ogg_media.demux(b"junk" + ogg_media.encode(b"\xff" * 576))
    assert ogg_media.samples(again)[0] == b"\xff" * 576


def test_ogg_frames(spark):
    df = spark.createDataFrame([(1, "abc", 1), (2, None, 2), (None, "", 3), (1, "abc", 1), (4, "ü" * 70_000, 4)], "doc_id bigint, text string, feature int")
    out = ogg_media.read_media(ogg_media.store(df)).collect()
    assert len(out) == 5 and len({(r.payload_sha256, r.media_sha256, r.feature) for r in out if r.doc_id == 1}) == 1
    assert {r.payload_bytes for r in out if r.doc_id in (2, None)} == {576}
    times = ogg_media.packet_times(ogg_media.store(df)).collect()
    assert max(t.end_s for t in times if t.id == 4) == max(r.payload_bytes for r in out) / ogg_media.RATE
    assert ogg_media.read_media(ogg_media.store(df.limit(0))).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id bigint, media binary")
    assert ogg_media.read_media(none).first().payload_sha256 is None
