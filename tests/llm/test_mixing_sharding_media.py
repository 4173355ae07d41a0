import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from spanlake.llm import common, media, mixing, sharding

from .helpers import odd_docs, words


def brute_targets(sizes):
    """Share by weight; give the excess over 2x to the rest, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def check_mix(docs):
    found = mixing.mix(docs).collect()
    given = docs.select("doc_id", "source", "text").collect()
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in found), key=repr) == sorted(((r["doc_id"], r["source"], len(words(r["text"]))) for r in given), key=repr)
    sizes, taken = Counter(), Counter()
    for r in given:
        sizes[r["source"]] += len(words(r["text"]))
    for r in found:
        taken[r["source"]] += r["taken"]
        assert r["taken"] == sum(d["words"] for d in r["draws"]) <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert len({d["epoch"] for d in r["draws"]}) == len(r["draws"]) and all(0 <= d["shard"] < mixing.SHARDS for d in r["draws"])
    want = brute_targets(dict(sizes))
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5001
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in found)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    return found


def test_mix(spark, tiny):
    check_mix(odd_docs(spark))
    check_mix(spark.read.parquet(f"{tiny}/documents.parquet"))
    assert mixing.mix(odd_docs(spark).limit(0)).collect() == []
    assert all(r["taken"] == 0 for r in mixing.mix(odd_docs(spark).withColumn("text", F.lit(None).cast("string"))).collect())


def check_mixed(docs):
    """The rows of mixed_documents are whole documents, those of mix's draws of half a document or more; reruns agree."""
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    texts = defaultdict(list)
    for r in docs.select("doc_id", "source", "text").collect():
        texts[r["doc_id"], r["source"]].append(r["text"] or "")
    want, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want.update((r["doc_id"], r["source"], r["size"]) for d in r["draws"] if 2 * d["words"] >= r["size"])
    found = out.collect()
    for r in found:
        got[r["doc_id"], r["source"], len(words(r["text"]))] += 1
        assert r["text"] in texts[r["doc_id"], r["source"]] and ("n_chars" not in docs.columns or r["n_chars"] == len(r["text"]))
    assert got == want
    again = mixing.mixed_documents(docs.repartition(3)).collect()
    assert Counter(map(repr, again)) == Counter(map(repr, found))
    return sum((Counter({k[1]: k[2] * v}) for k, v in got.items()), Counter())


def test_mixed_documents(spark, tiny):
    check_mixed(spark.read.parquet(f"{tiny}/documents.parquet"))
    check_mixed(odd_docs(spark))
    equal = spark.createDataFrame([(1, "a b c d e f", "s")] * 3 + [(2, "g h", "t")] * 2, "doc_id long, text string, source string")
    got = check_mixed(equal)
    assert all(abs(got[r["source"]] - r["target"]) <= r["size"] / 2 for r in mixing.mix(equal).collect())
    assert mixing.mixed_documents(odd_docs(spark).limit(0)).collect() == []


def test_more_sources_than_columns(spark, tiny, monkeypatch):
    rows = [(i, "w " * (1 + i * 7 % 50), f"site{i % 40}" if i % 41 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = {(r["doc_id"], r["taken"]) for r in check_mix(docs)}
    monkeypatch.setattr(mixing, "GROUPS", 4)
    found = check_mix(docs)
    assert {(r["doc_id"], r["taken"]) for r in found} == plain
    load = Counter()
    for r in found:
        for d in r["draws"]:
            load[d["shard"]] += 1
    assert len(load) > mixing.SHARDS // 2
    check_mixed(docs)


def test_shared_columns_deal_each_source_to_all_shards(spark, monkeypatch):
    """With more sources than columns, a source's draws per shard stay near its even share."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', 700 + cast(id % 50 AS int)) AS text", "concat('site', id % 20) AS source")
    monkeypatch.setattr(mixing, "GROUPS", 3)
    shards = {}
    for r in mixing.mix(docs).collect():
        for d in r["draws"]:
            shards.setdefault(r["source"], Counter())[d["shard"]] += d["words"]
    for load in shards.values():
        assert len(load) == mixing.SHARDS and max(load.values()) < 2.5 * sum(load.values()) / mixing.SHARDS


def test_hypergeometric_beyond_the_library():
    rng = np.random.default_rng(1)
    draws = [mixing.hypergeometric(rng, 3_000_000_000, 1_000_000_000, 1_000_000) for _ in range(200)]
    assert abs(np.mean(draws) - 750_000) < 200 and mixing.hypergeometric(rng, 2_000_000_000, 5, 2_000_000_005) == 2_000_000_000


def test_tree_keeps_quotas():
    quota = np.array([5, 0, 100, 1, 33])
    for shards in (1, 2, 3, 16):
        leaves = mixing.split_tree(quota, shards, 4)
        assert leaves.shape == (shards, 5) and (leaves.sum(axis=0) == quota).all() and (leaves >= 0).all()
        assert np.ptp(leaves.sum(axis=1)) <= np.ceil(np.log2(shards)) + 1
    draws = np.array([mixing.split_tree(quota, 2, s)[0] for s in range(400)])
    assert abs(draws[:, 2].mean() - 50) < 1  # its mean, by the hypergeometric law


def check_places(docs):
    found = sharding.place(docs, 24).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    places, load = defaultdict(list), Counter()
    for r in found:
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.place(docs.repartition(3), 24).collect()) == Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in found)
    return load


def test_places(spark, tiny):
    check_places(odd_docs(spark))
    load = check_places(spark.read.parquet(f"{tiny.replace('0.001', '0.01')}/documents.parquet"))
    assert max(load.values()) < 1.01 * min(load.values())
    assert sharding.place(odd_docs(spark).limit(0), 24).collect() == []


def test_versions_and_growth(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(0, 10_000, sharding.SLOTS)]
    owner = [s % 24 for s in range(sharding.SLOTS)]
    even = sharding.rebalanced(owner, sizes, 24)
    more = sharding.grown(even, sizes, 24)
    load = Counter()
    for slot, (a, b) in enumerate(zip(even, more, strict=True)):
        assert b in (a, 24)  # the new shard takes slots only into itself
        load[b] += sizes[slot]
    assert max(load.values()) < 1.02 * min(load.values())
    path = common.new_path(spark, "map")
    store = sharding.SlotMap(spark, path)
    store.write(1, owner, sizes, "dealt in turn")
    store.write(2, even, sizes, "rebalanced")
    assert [r["shard"] for r in store.read(1).orderBy("slot").collect()] == owner
    assert [r["shard"] for r in store.read().orderBy("slot").collect()] == even


def test_media_round_trip(spark):
    docs = odd_docs(spark)
    found = media.describe(media.store(docs)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.select("doc_id", "text").collect():
        data = (r["text"] or "").encode()
        full = data + b"\xff" * (576 - len(data) % 576 if len(data) % 576 or not data else 0)
        want.append((r["doc_id"], len(data), len(full), sha(full), zlib.crc32(full[-32:])))
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    assert media.describe(media.store(docs.limit(0))).collect() == []


def test_boxes_and_tables():
    payload = bytes(range(256)) * 9 * 200
    data = media.pack(payload)
    track = media.index(data)
    assert track.codec == "raw " and track.seconds == len(payload) / 576 / 25
    assert media.payload_of(data, track) == payload
    for k, (a, n, t) in zip(range(0, len(payload) // 576, 12), track.keyframes(), strict=True):
        assert data[a : a + n] == payload[576 * k : 576 * (k + 1)] and abs(t - k / 25) < 1e-9
    kinds = [b"/".join(p) for p, _, _ in media.boxes(data)]
    assert b"moov/trak/mdia/minf/stbl/stsz" in kinds and kinds[-1] == b"mdat"
    for cut in range(0, len(data) - len(payload), 7):  # broken files have no track, and don't crash
        media.index(data[:cut])
    # sample sizes of their own, 64-bit offsets and no sync table: chunks of 2, 2 and 1 samples, out of order
    samples = [b"a" * 3, b"b" * 5, b"", b"c" * 7, b"d"]
    body = samples[4] + samples[0] + samples[1] + samples[2] + samples[3]
    tables = [
        media.full(b"stsd", 0, be(">u4", 1), media.box(b"mp4a", bytes(28))), media.full(b"stsc", 0, be(">u4", 2, 1, 2, 1, 3, 1, 1)),
        media.full(b"stsz", 0, be(">u4", 0, 5, 3, 5, 0, 7, 1)), media.full(b"co64", 0, be(">u4", 3), be(">u8", 9, 17, 8)),
    ]
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", 1 << 24, be(">u8", 0, 0), be(">u4", 1000), be(">u8", 2500)), media.box(b"minf", media.box(b"stbl", *tables)))))
    data = media.box(b"mdat", body) + moov
    track = media.index(data)
    assert (track.codec, track.seconds, len(track.keys)) == ("mp4a", 2.5, 5)
    assert [data[a : a + n] for a, n in zip(track.offsets, track.sizes, strict=True)] == samples and media.payload_of(data, track) == b"".join(samples)


def be(kind, *x):
    return np.array(x, kind).tobytes()


def movie(tables, number=1, rate=1000, extra=b"", length=2500, of_track=b""):
    """moov with one track of the given sample tables."""
    head = media.full(b"tkhd", 3, be(">u4", 0, 0, number, 0, 0))
    mdia = media.box(b"mdia", media.full(b"mdhd", 0, be(">u4", 0, 0, rate, length)), media.box(b"minf", media.box(b"stbl", *tables)))
    return media.box(b"moov", media.box(b"trak", head, of_track, mdia), extra)


ENTRY = media.full(b"stsd", 0, be(">u4", 1), media.box(b"avc1", bytes(28)))


def test_times_compact_sizes_and_damaged_counts():
    tables = [
        ENTRY, media.full(b"stts", 0, be(">u4", 2, 2, 100, 2, 50)), media.full(b"ctts", 1 << 24, be(">u4", 2, 1, 0, 3) + be(">i4", -20)),
        media.full(b"stsc", 0, be(">u4", 1, 1, 4, 1)), media.full(b"stz2", 0, be(">u4", 4, 4), bytes([0x12, 0x34])), media.full(b"stss", 0, be(">u4", 2, 1, 3)), media.full(b"stco", 0, be(">u4", 1, 8)),
    ]
    data = media.box(b"mdat", b"abbcccdddd") + movie(tables)
    track = media.index(data)
    assert (track.codec, track.seconds, track.sizes.tolist(), track.offsets.tolist()) == ("avc1", 0.3, [1, 2, 3, 4], [8, 9, 11, 14])
    assert np.allclose(track.times, [0.0, 0.08, 0.18, 0.23]) and [k[:2] for k in track.keyframes()] == [(8, 1), (11, 3)]
    for bits, raw in ((8, be(">u1", 1, 2, 3, 4)), (16, be(">u2", 1, 2, 3, 4))):
        tables[4] = media.full(b"stz2", 0, be(">u4", bits, 4), raw)
        assert media.index(media.box(b"mdat", b"abbcccdddd") + movie(tables)).sizes.tolist() == [1, 2, 3, 4]
    big = 0xFFFFFFF0
    for k, wrong in ((1, be(">u4", big)), (3, be(">u4", 1, 1, big, 1)), (3, be(">u4", big)), (4, be(">u4", 4, big)), (4, be(">u4", 3, 4)), (5, be(">u4", 1, big)), (5, be(">u4", big)), (6, be(">u4", big, 8)), (6, be(">u4", 1, big))):
        kind = tables[k][4:8]
        broken = [*tables[:k], media.full(kind, 0, wrong), *tables[k + 1 :]]
        media.index(media.box(b"mdat", b"abbcccdddd") + movie(broken))  # null or what can be read, but no crash and no large array
    for each in (1, 576, big):
        sized = media.full(b"stsz", 0, be(">u4", each, big))
        assert media.index(media.box(b"mdat", b"abbcccdddd") + movie([*tables[:4], sized, *tables[5:]])) is None
    rng = np.random.default_rng(5)
    whole = bytearray(media.pack(bytes(range(256)) * 9 * 50))
    for _ in range(2000):  # bytes turned at random
        turned = bytearray(whole)
        for at in rng.integers(0, len(whole) - 9 * 256 * 50, 3):
            turned[at] = int(rng.integers(0, 256))
        track = media.index(bytes(turned))
        assert track is None or (len(track.offsets) == len(track.sizes) and (track.offsets + track.sizes <= len(turned)).all())


def test_fragments_and_tracks():
    trex = media.box(b"mvex", media.full(b"trex", 0, be(">u4", 1, 1, 40, 3, 0x10000)))
    empty = [ENTRY, *[media.full(k, 0, be(">u4", 0)) for k in (b"stts", b"stsc", b"stco")], media.full(b"stsz", 0, be(">u4", 0, 0))]
    head = movie(empty, extra=trex, length=0)

    def fragment(truns, body, flags=0x20000, own=b""):
        make = lambda n: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", flags, be(">u4", 1), own), *truns(n)))
        return make(len(make(0)) + 8) + media.box(b"mdat", body)

    one = fragment(lambda at: [media.full(b"trun", 0x1 | 0x4 | 0x200, be(">u4", 2, at, 0, 4, 5))], b"aaaabbbbb")
    two = fragment(lambda at: [media.full(b"trun", 0x1, be(">u4", 2, at)), media.full(b"trun", 0x100 | 0x400, be(">u4", 1, 10, 0))], b"cccdddeee")
    data = head + one + two
    track = media.index(data)
    assert [data[a : a + n] for a, n in zip(track.offsets, track.sizes, strict=True)] == [b"aaaa", b"bbbbb", b"ccc", b"ddd", b"eee"]
    assert track.keys.tolist() == [0, 4] and np.allclose(track.times, [0, 0.04, 0.08, 0.12, 0.16]) and abs(track.seconds - 0.17) < 1e-9
    assert media.index(head + one[:-3]) is None or len(media.index(head + one[:-3]).sizes) < 3
    second = media.box(b"trak", media.full(b"tkhd", 3, be(">u4", 0, 0, 2, 0, 0)), media.box(b"mdia", media.full(b"mdhd", 0, be(">u4", 0, 0, 10, 5)), media.box(b"minf", media.box(b"stbl", *empty))))
    both = media.tracks(media.box(b"moov", second) + b"")
    assert len(both) == 1 and len(both[0].sizes) == 0 and media.index(media.box(b"moov", second)) is None


def test_times_of_fragments_and_edits():
    """A fragment's own base time counts, fragments without one follow on, and edit lists move all times."""
    trex = media.box(b"mvex", media.full(b"trex", 0, be(">u4", 1, 1, 40, 3, 0x10000)))
    empty = [ENTRY, *[media.full(k, 0, be(">u4", 0)) for k in (b"stts", b"stsc", b"stco")], media.full(b"stsz", 0, be(">u4", 0, 0))]

    def fragment(*timed):
        make = lambda n: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", 0x20000, be(">u4", 1)), *timed, media.full(b"trun", 0x1 | 0x4, be(">u4", 2, n, 0))))
        return make(len(make(0)) + 8) + media.box(b"mdat", b"abcdef")

    base = lambda t: media.full(b"tfdt", 0, be(">u4", t))
    wide = media.full(b"tfdt", 1 << 24, be(">u8", 60_000))
    data = movie(empty, extra=trex, length=0) + fragment(base(50_000)) + fragment() + fragment(wide)
    track = media.index(data)
    assert np.allclose(track.times, [50, 50.04, 50.08, 50.12, 60, 60.04]) and [k[2] for k in track.keyframes()] == [50.0, 50.08, 60.0]
    assert abs(track.seconds - 0.24) < 1e-9
    mvhd = media.full(b"mvhd", 0, be(">u4", 0, 0, 600, 0))
    for edits, shift in (([(300, 0xFFFFFFFF), (600, 40)], 0.5 - 0.04), ([(600, 80)], -0.08), ([(300, 0xFFFFFFFF)], 0.0), ([], 0.0)):
        elst = media.box(b"edts", media.full(b"elst", 0, be(">u4", len(edits), *[x for a, b in edits for x in (a, b, 0x10000)])))
        moved = media.index(movie(empty, extra=mvhd + trex, length=0, of_track=elst) + fragment(base(0)))
        assert np.allclose(moved.times, [shift, 0.04 + shift])


def test_unreadable_rows_are_null(spark):
    rows = [(1, 3, bytearray(media.pack(b"x" * 576))), (2, 0, None), (3, 0, bytearray(b"")), (4, 5, bytearray(b"plain")), (None, 3, bytearray(media.pack(b"x" * 576)[:-1]))]
    found = {r["doc_id"]: r for r in media.describe(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert found[1]["payload_bytes"] == 576 and all(found[k]["codec"] is None and found[k]["payload_sha256"] is None for k in (2, 3, 4, None))
