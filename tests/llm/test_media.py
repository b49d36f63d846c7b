import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshframe.llm import media


def joined(data):
    return b"".join(data[p[2] : p[2] + p[3]] for p in media.demux(data))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000), st.sampled_from(["fixed", "xiph", "ebml"]))
def test_round_trip(body, lacing):
    assert joined(media.mux(media.pad(body), lacing)) == media.pad(body)


def test_long_payload_has_clusters_cues_and_times():
    body = bytes(i % 251 for i in range(1_000_000))
    data = media.mux(media.pad(body))
    packets = media.demux(data)
    assert joined(data) == media.pad(body)
    assert [p[1] for p in packets] == [i * media.FRAME_MS for i in range(len(packets))]
    assert sum(p[7] for p in packets) == max(p[5] for p in packets) + 1 == -(-len(packets) // (media.LACE * media.BLOCKS))


@pytest.mark.parametrize("lacing", ["xiph", "ebml"])
@pytest.mark.parametrize("sizes", [[1, 2, 3], [300, 255, 0, 510], [1, 70000, 5], [192] * 8, [5, 4, 3, 2, 1]])
def test_uneven_laces(lacing, sizes):
    frames = [bytes([i]) * s for i, s in enumerate(sizes)]
    flag, block = media.laced(frames, lacing)
    assert media.lace_sizes(block, 0, len(block), flag)[0] == sizes


def test_unknown_sizes_and_block_groups():
    head, tracks = media.front()
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, b"\x81\x00\x05\x00" + b"ab") + media.number(media.REFERENCE, 1))
    unknown = b"\x01" + b"\xff" * 7
    cluster = lambda at: media.CLUSTER.to_bytes(4, "big") + unknown + media.number(media.TIMESTAMP, at) + group
    data = head + media.SEGMENT.to_bytes(4, "big") + unknown + tracks + cluster(10) + cluster(50)
    assert [p[:2] + p[3:6] for p in media.demux(data)] == [(1, 15, 2, False, 0), (1, 55, 2, False, 1)]


def test_damage_raises():
    with pytest.raises(ValueError):
        media.demux(media.mux(media.pad(b"x" * 900))[:-300])


def test_columns(spark):
    rows = [(1, "hello", 1), (2, None, 2), (None, "", 3), (1, "hello", 1), (5, "é" * 50_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload int")
    held = media.read(media.parse(media.store(docs)))
    for r in held.collect():
        want = media.pad((next(t for i, t, _ in rows if i == r.doc_id) or "").encode())
        assert r.payload == want == b"".join(r.media[p.offset : p.offset + p.size] for p in r.packets)
    assert media.read(media.store(docs.limit(0))).count() == 0
    null = media.read(media.parse(spark.createDataFrame([(1, None)], "doc_id long, media binary"))).first()
    assert (null.packets, null.payload, null.n_packets) == ([], b"", 0)


def test_query(spark):
    from tests.conftest import SF

    got = {r.doc_id: r for r in media.op10_matroska(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        body = (r.text or "").encode()
        q, want = got[r.doc_id], media.pad(body)
        assert (q.n_bytes, q.payload_bytes, q.payload_sha256, q.tail_crc32) == (len(body), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
