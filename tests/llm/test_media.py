import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import media, webp
from ledgerline.llm.queries import op6_media_columns
from tests.llm.conftest import ODD, SF, rows
from tests.llm.webp_writer import Writer


def test_round_trip(spark, odd):
    got = rows(media.features(media.encode(odd)))
    want = []
    for doc_id, text, *_ in ODD:
        raw = (text or "").encode()
        pay = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((doc_id, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:])))
    assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
    assert len({r[1:] for r in got}) == len({r[1] or "" for r in ODD})  # equal texts, equal values


def payload(text):
    raw = (text or "").encode()
    return raw, raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))


def test_query_reads_back_every_document(spark, documents):
    """All fields of the query from the texts alone; the files go through transforms and back-references."""
    got = {r[0]: r for r in rows(op6_media_columns(spark, SF))}
    stored = {r[0]: r[2] for r in rows(media.encode(spark.read.parquet(f"{SF}/documents.parquet")))}
    kinds, copies, size = Counter(), 0, 0
    for doc_id, text, *_ in documents:
        raw, pay = payload(text)
        files = stored[doc_id]
        held = b"".join(files)
        assert got[doc_id][1:7] == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]), len(held), hashlib.sha256(held).hexdigest())
        for f in files:
            seen = set()
            assert (webp.decode(f, seen)[..., 1].tobytes()) in pay
            kinds.update(seen)
        copies += len(webp.find_copies(np.frombuffer(pay, np.uint8), np.array([len(pay)]))[0]) > 0
        size += len(held)
        counts = Counter(pay)
        top = min(counts, key=lambda k: (-counts[k], k))
        assert got[doc_id][7] == f"{len(files)}:{len(counts)}:{top}:{1000 * sum(pay) // len(pay)}"
    assert kinds[webp.SUBTRACT_GREEN] and copies == len(documents) and size < 0.6 * sum(len(payload(t)[0]) for _, t, *_ in documents)


def test_encoder_chooses_transforms():
    dice = np.random.default_rng(2)
    walk = lambda n: np.cumsum(dice.integers(-2, 3, n)) % 256
    own = [dice.integers(0, 256, 576), dice.geometric(0.02, 1728) % 256, dice.integers(97, 100, 5760), np.full(576, 7), np.arange(576) % 256, walk(48_000), np.tile(np.frombuffer(b"hello world, again ", np.uint8), 31)[:576],
           (walk(24)[None] + walk(48)[:, None]).ravel() % 256, np.arange(576 * 20) // 5 % 13, dice.integers(0, 2, 576), np.repeat(dice.integers(0, 256, 24), 24 * 24)]
    own = [np.asarray(x, np.uint8) for x in own]
    for widths in (np.full(len(own), 24), np.array([576 if len(x) % 576 == 0 and i % 2 else 24 for i, x in enumerate(own)])):
        files = webp.encode_many(np.concatenate(own), np.cumsum([0, *map(len, own)]), widths)
        kinds = []
        for file, samples, w in zip(files, own, widths):
            seen = set()
            full = webp.decode(file, seen)
            kinds.append(seen)
            assert full.shape[1] == w and (full[..., :3].reshape(-1, 3) == samples[:, None]).all() and (full[..., 3] == 255).all()
        assert kinds[0] == {webp.SUBTRACT_GREEN} and kinds[2] == {webp.PALETTE} and webp.PREDICTOR in kinds[5] and len(files[6]) < 200


def test_long_copies_and_distances():
    dice = np.random.default_rng(4)
    block = dice.integers(0, 256, 30_000).astype(np.uint8)
    samples = np.concatenate([block, block, block[::-1], block, np.full(24 * 700, 255, np.uint8)])
    (file,) = webp.encode_many(samples, np.array([0, len(samples)]), np.array([24]))
    assert (webp.decode(file)[..., 1].ravel() == samples).all() and len(file) < 2.2 * len(block)
    start, length, distance = webp.find_copies(samples, np.array([len(samples)]))
    assert length.max() == webp.MOST_COPY and (np.diff(start) >= length[:-1]).all()
    assert all((samples[i : i + n] == samples[i - d : i - d + n]).all() or d < n for i, n, d in zip(start, length, distance))


def test_tall_payloads_are_cut(monkeypatch):
    monkeypatch.setattr(webp, "MAX_SIDE", 4)
    assert media.images(96) == [(96, 24)]
    assert media.images(576) == [(576, 576)]
    assert media.images(576 * 9) == [(2304, 576), (2304, 576), (576, 576)]


def test_length_limit():
    counts = np.array([1, 1] + [int(1.6**k) for k in range(1, 40)])
    lengths = webp.code_lengths(counts)
    assert lengths.max() <= webp.LONGEST_CODE and sum(2.0 ** -int(n) for n in lengths) == 1


def test_near_offsets():
    """The first and last short distances of the format."""
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


@pytest.mark.parametrize("seed", range(6))
def test_transforms_references_and_cache(seed):
    """Files from a separate writer that uses every transform, back-references, a cache and meta codes."""
    dice = random.Random(seed)
    width, height = dice.choice([(7, 5), (24, 24), (33, 9)])
    colours = [tuple(dice.randrange(256) for _ in range(4)) for _ in range(dice.choice([2, 4, 13, 60]))]
    image = np.array([dice.choice(colours) for _ in range(width * height)], np.uint8).reshape(height, width, 4)
    image[height // 2 :] = image[: height - height // 2]
    for kinds in ((), (2,), (0,), (1,), (3,), (0, 1, 2), (3, 0), (1, 0)):
        for cache in (0, 4):
            for meta in (False, True):
                data = Writer(dice).image(image, kinds, cache, meta)
                assert (webp.decode(data) == image).all(), (kinds, cache, meta)


def test_many_files_equal_each_alone(monkeypatch):
    """Lanes, their few long files and files of other kinds give what the decoder gives of each file."""
    dice = np.random.default_rng(7)
    own = [np.repeat(dice.integers(0, 256, 48), dice.integers(1, 30, 48))[: 24 * 20] for _ in range(90)] + [dice.integers(0, 40, 24 * int(n)) for n in dice.integers(1, 200, 60)]
    own = [np.resize(x, 24 * max(1, len(x) // 24)).astype(np.uint8) for x in own] + [np.full(24, 9, np.uint8)]
    files = webp.encode_many(np.concatenate(own), np.cumsum([0, *map(len, own)]), np.full(len(own), 24))
    files.append(Writer(random.Random(3)).image(dice.integers(0, 5, (6, 7, 4)).astype(np.uint8), (0, 1, 2), 4, True))
    alone = [webp.decode(f) for f in files]
    assert all((a[..., 1].ravel() == x).all() for a, x in zip(alone, own))
    for few in (1, 16, 64, 1000):
        monkeypatch.setattr(webp, "FEW_LANES", few)
        assert all(a.shape == b.shape and (a == b).all() for a, b in zip(webp.decode_many(files), alone, strict=True))
