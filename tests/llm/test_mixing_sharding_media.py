from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from tests.compare import same
from tidemark.llm import media, mixing, sharding


def test_mix_matches_its_sql(spark, sf_dir):
    same(mixing.op9_mixing(spark, sf_dir), mixing.OP9_SQL, sf_dir)


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        weights = sum(weight[s] for s in sizes if s not in capped)
        above = {s for s in sizes if s in capped or (weights and weight[s] * rest > 3 * sizes[s] * weights)}
        if above == capped:
            return {s: 3 * sizes[s] if s in capped else weight[s] * rest / weights for s in sizes}
        capped = above


def test_targets_and_takes(docs, rows, no_docs):
    size = {repr(r): len((r[1] or "").encode().split()) for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size[repr(r)]
    wanted = plain_targets(sizes)
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows)
    taken = defaultdict(int)
    of = {(r[0], size[repr(r)]): r[3] for r in rows}
    for r in found:
        source = of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(wanted[source]) and r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    longest = max(size.values())
    assert all(abs(taken[s] - wanted[s]) <= longest for s in sizes)
    assert sorted(map(repr, mixing.mixed(docs).collect())) == sorted(map(repr, found))
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns
    counted = Counter(repr(tuple(r)) for r in mix.collect())
    words = Counter()
    for r in rows:
        words[r[3]] += counted[repr(r)] * size[repr(r)] / sum(x == r for x in rows)
    assert {s: round(n) for s, n in words.items()} == dict(taken)
    assert mixing.mixed(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_texts_without_words_are_taken_with_whole_epochs_only(spark):
    """Source a stops at three times its size, so three epochs are all of it; b and c have epochs and a rest."""
    rows = [(i, " \t" * i, source) for source in "abc" for i in range(40)]
    rows += [(100 + i, f"w{i} x y", source) for source, n in (("a", 2), ("b", 30), ("c", 5)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    wanted = plain_targets(size)
    times = Counter((r["doc_id"], r["source"]) for r in mixing.mix(docs).collect())
    for s in "abc":
        assert {times[i, s] for i in range(40)} == {int(wanted[s] // size[s])}
    assert max(times.values()) <= 3


def test_many_buckets_choose_like_one(docs, monkeypatch):
    one = sorted(map(repr, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET", 2)
    assert sorted(map(repr, mixing.mixed(docs).collect())) == one


def test_shards(docs, rows, no_docs):
    found = sharding.shard(docs, shards=4).collect()
    size = {repr((r[0], r[1])): len((r[1] or "").encode()) + 1 for r in rows}
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted((repr(r[0]), size[repr((r[0], r[1]))], zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, load = defaultdict(list), Counter()
    for r in found:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    mean = sum(load.values()) / 4
    assert all(abs(load[i] - mean) <= max(size.values()) for i in range(4))
    assert sharding.shard(no_docs).count() == 0


def test_groups_stay_whole_where_there_is_room(spark):
    groups = [("a" * 9, 900), ("b" * 99, 80), ("c" * 4, 1500), ("d" * 49, 2), ("e" * 199, 45)]  # 9000, 8000, 7500, 100, 9000 bytes
    rows = [(t, i * 10_000 + k) for i, (t, n) in enumerate(groups) for k in range(n)] + [(f"{i:09d}", 90_000 + i) for i in range(4640)]
    docs = spark.createDataFrame(rows, "text string, doc_id long").repartition(3)
    found = sharding.shard(docs, shards=8).collect()  # 80,000 bytes, 10,000 a shard
    of, load, slots = defaultdict(set), Counter(), defaultdict(list)
    text = {i: t for t, i in rows}
    for r in found:
        of[text[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(x) == 1 for x in of.values()) and len({min(of[t]) for t, n in groups if n != 2}) == 4
    # what the plain rule gives: the largest groups to the emptiest shards, all else in a line up to the mean
    assert len(load) == 8 and all(abs(x - 10_000) <= 0.01 * 10_000 + 200 for x in load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)
    again = sharding.shard(docs, shards=8).collect()
    assert sorted((r["doc_id"], r["shard"]) for r in again) == sorted((r["doc_id"], r["shard"]) for r in found)


def plain_shards(rows, shards):
    """Group sums, the largest first into the emptiest shard with room; whole or not, and the loads they make."""
    sums = Counter()
    for t, _ in rows:
        sums[t] += len(t.encode()) + 1
    mean, loads, whole = sum(sums.values()) / shards, [0.0] * shards, set()
    for t, size in sorted(sums.items(), key=lambda x: -x[1]):
        if size > sharding.GROUP_SHARE * mean and min(loads) + size <= mean:
            loads[loads.index(min(loads))] += size
            whole.add(t)
    return mean, whole


@pytest.mark.parametrize("seed", range(3))
def test_shards_by_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    groups = [("x" * rng.randrange(1, 60) + str(i), rng.randrange(1, 300)) for i in range(40)]
    rows = [(t, i * 1000 + k) for i, (t, n) in enumerate(groups) for k in range(n)] + [(f"single {i}", 10**6 + i) for i in range(3000)]
    found = sharding.shard(spark.createDataFrame(rows, "text string, doc_id long"), shards=5).collect()
    mean, whole = plain_shards(rows, 5)
    text, of, load = {i: t for t, i in rows}, defaultdict(set), Counter()
    for r in found:
        of[text[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert whole and all(len(of[t]) == 1 for t in whole) and len(found) == len(rows)
    assert all(abs(load[i] - mean) <= sharding.GROUP_SHARE * mean + 100 for i in range(5))


def test_overfull_ranges_are_divided(spark):
    texts = [("same", i) for i in range(3000)] + [(f"text {i}", 5000 + i) for i in range(1000)] + [("", 9000 + i) for i in range(500)]
    docs = spark.createDataFrame(texts, "text string, doc_id long")
    found = sharding.shard(docs, shards=16).collect()
    load = Counter()
    for r in found:
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 16
    assert len(load) == 16 and all(abs(x - mean) < 0.02 * mean + 20 for x in load.values())
    for s in range(16):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))


def test_stored_texts_come_back(docs, rows, no_docs):
    found = media.text_media(docs, with_media=True).collect()
    texts = Counter((r[0], len((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["n_bytes"]) for r in found) == texts
    by_id = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in found:
        if r["doc_id"] is None:
            continue
        payload = media.pad((by_id[r["doc_id"]] or "").encode())
        (track,) = media.probe(bytes(r["media"]))
        assert media.read_back(bytes(r["media"]), track) == payload and r["payload_bytes"] == len(payload) and len(payload) % 576 == 0
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        n = len(payload) // 576
        assert track["key"].sum() == -(-n // media.GOP) and track["codec"] == "raw " and track["duration"] == n / media.RATE
    assert media.text_media(no_docs).count() == 0


@pytest.mark.parametrize("frames", [1, 7, 8, 9, 16, 25])
def test_sample_tables(frames):
    payload = bytes(i % 251 for i in range(576 * frames))
    data = media.store(payload)
    (track,) = media.probe(data)
    assert media.read_back(data, track) == payload and len(track["sizes"]) == frames


def fragmented(default_base: bool) -> tuple[bytes, bytes]:
    """Two tracks in two fragments: the first with flags for each sample, the second with defaults only."""
    u32, box, full = media.u32, media.box, media.full

    def trak(number: int, kind: bytes, codec: bytes) -> bytes:
        table = box(b"stbl", full(b"stsd", 0, u32(1), box(codec, bytes(8))), full(b"stts", 0, u32(0)), full(b"stsc", 0, u32(0)), full(b"stsz", 0, u32(0, 0)), full(b"stco", 0, u32(0)))
        mdia = box(b"mdia", full(b"mdhd", 0, u32(0, 0, 100, 0), bytes(4)), full(b"hdlr", 0, u32(0), kind, bytes(13)), box(b"minf", table))
        return box(b"trak", full(b"tkhd", 3, u32(0, 0, number, 0, 0), bytes(60)), mdia)

    mvex = box(b"mvex", full(b"trex", 0, u32(1, 1, 10, 0, 0x10000)), full(b"trex", 0, u32(2, 1, 4, 3, 0)))
    out = box(b"ftyp", b"iso5", u32(0)) + box(b"moov", trak(1, b"vide", b"avc1"), trak(2, b"soun", b"mp4a"), mvex)
    payload = b""
    for turn in range(2):
        sizes = [5 + turn, 7, 9]
        first = bytes([65 + turn]) * sum(sizes)
        second = bytes([97 + turn]) * 6

        def moof(at: int) -> bytes:
            run = full(b"trun", 0x205 if turn else 0x601, u32(3, at), *([u32(0), u32(*sizes)] if turn else [u32(s, f) for s, f in zip(sizes, (0, 0x10000, 0), strict=True)]))
            base = 0x20000 if default_base else 0
            sound = full(b"trun", 1, u32(2, at + sum(sizes))) if default_base else full(b"trun", 0, u32(2))
            return box(b"moof", full(b"mfhd", 0, u32(turn + 1)), box(b"traf", full(b"tfhd", base, u32(1)), run), box(b"traf", full(b"tfhd", base, u32(2)), sound))

        out += moof(len(moof(0)) + 8) + box(b"mdat", first + second)
        payload += first
    return out, payload


@pytest.mark.parametrize("default_base", [True, False])
def test_fragments(spark, default_base):
    data, payload = fragmented(default_base)
    video, sound = media.probe(data)
    assert media.read_back(data, video) == payload and media.read_back(data, sound) == b"aaaaaabbbbbb"
    assert video["sizes"].tolist() == [5, 7, 9, 6, 7, 9] and video["key"].tolist() == [True, False, True, True, False, False]
    assert (video["codec"], video["duration"], sound["codec"], sound["duration"]) == ("avc1", 0.6, "mp4a", 0.16) and sound["key"].all()
    cases = {1: data, 2: data[:-5], 3: data.replace(b"tfhd", b"tfhx"), 4: data.replace(b"trex", b"trey")}
    at = data.rindex(b"tkhd") - 4
    whole = struct.unpack_from(">I", data, at)[0]
    cases[6] = data[:at] + media.box(b"tkhd") + struct.pack(">I4s", whole - 8, b"free") + data[at + 16 :]  # of a header without content
    nested = media.box(b"moov")
    for _ in range(40):
        nested = media.box(b"moov", nested)
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in (cases | {5: nested}).items()], "id int, content binary")
    found = {r["id"]: r for r in media.media_columns(rows, id_col="id", content_col="content").collect()}
    assert [t["samples"] for t in found[1]["tracks"]] == [6, 4] and all(found[k]["error"] for k in (2, 3, 4, 5, 6))


def test_malformed_files_are_reported(spark):
    good = media.store(media.pad(b"x" * 2000))
    at = good.index(b"stsz")
    cases = {1: good, 2: good[:100], 3: b"\0\0\0\x04bad!", 4: None, 5: b"", 6: good[: at + 12] + struct.pack(">I", 10**6) + good[at + 16 :], 7: good[:-1], 8: b"not a media file at all"}
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in cases.items()], "id int, content binary")
    found = {r["id"]: r for r in media.media_columns(rows, id_col="id", content_col="content").collect()}
    assert found[1]["error"] is None and found[1]["tracks"][0]["samples"] == 4 and found[1]["tracks"][0]["keyframes"][0]["size"] == 576
    assert found[4]["tracks"] == found[5]["tracks"] == [] and found[4]["error"] is None
    assert all(found[k]["tracks"] is None and found[k]["error"] for k in (2, 3, 6, 7, 8))
