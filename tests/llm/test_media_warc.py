import base64
import gzip
import hashlib
import os
import random
import zlib

import pytest

from partita.llm import media, warc


def test_containers_give_back_payload_and_keyframes():
    for n in (0, 1, 575, 576, 577, 576 * 64, 576 * 64 * 3 + 9, 200_000):
        raw = os.urandom(n)
        payload = raw + b"\xff" * (-n % 576 or (0 if n else 576))
        data = media.pack_media(payload)
        (d,) = media.describe(data)
        assert b"".join(data[a : a + s] for a, s in d["chunks"]) == payload
        assert [data[a : a + s] for a, s in d["keyframes"]] == [payload[k : k + 576] for k in range(0, len(payload), 576 * 16)]
        assert d["codec"] == "raw" and d["duration"] == len(payload) / 8000 and d["samples"] == len(payload) // 576
    with pytest.raises(ValueError):
        media.describe(data[:-1])


def test_media_query_columns(spark, sf):
    rows = [(1, None), (2, ""), (3, "é" * 288), (4, "x" * 576), (5, "x" * 577), (5, "x" * 577), (None, "y" * 300_000)]
    docs = spark.createDataFrame([(*r, b"m", "f") for r in rows], "doc_id long, text string, media binary, feature string")
    got = media.media_index(media.media_column(docs)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        data = media.pack_media(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert media.media_index(media.media_column(docs.limit(0))).count() == 0


def test_damaged_values_and_several_tracks(spark):
    one, two = media.pack_media(b"a" * 576), media.pack_media(b"b" * 1152)
    # a container with both tracks: the second file's boxes follow, its chunk offsets moved
    (a,), (b,) = media.describe(one), media.describe(two)
    moved = bytearray(two)
    for kind, start, _ in media.boxes(two, 0, len(two)):
        if kind == b"co64":
            moved[start + 8 : start + 16] = (b["chunks"][0][0] + len(one)).to_bytes(8, "big")
    both = media.describe(one + bytes(moved))
    assert [t["samples"] for t in both] == [1, 2] and both[0] == a
    rows = [(1, 576, one), (2, 0, None), (3, 9, b"not media"), (4, 576, one[:-600]), (5, 1728, one + bytes(moved))]
    got = {r["doc_id"]: r for r in media.media_index(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["error"] is None and all(got[i]["error"] and got[i]["payload_sha256"] is None for i in (2, 3, 4))
    assert got[5]["payload_sha256"] == hashlib.sha256(b"a" * 576 + b"b" * 1152).hexdigest() and len(got[5]["tracks"]) == 2
    with pytest.raises(ValueError, match="fragments"):
        media.describe(media._box(b"moof") + one)


def test_deep_boxes_and_huge_counts_are_errors_not_crashes(spark):
    deep = b""
    for _ in range(20_000):
        deep = (8 + len(deep)).to_bytes(4, "big") + b"moov" + deep
    good = media.pack_media(b"ab" * 288)
    at = good.index(b"stsz") + 8
    many = good[:at] + (1).to_bytes(4, "big") + (2**32 - 1).to_bytes(4, "big") + good[at + 8 :]
    few_bits = good[: at - 8] + b"stz2" + bytes(7) + b"\x04" + (2**32 - 1).to_bytes(4, "big") + good[at + 8 :]
    df = spark.createDataFrame([(1, 5, bytearray(deep)), (2, 5, bytearray(many)), (3, 576, bytearray(good)), (4, 5, bytearray(few_bits))], "doc_id long, n_bytes long, media binary")
    rows = {r["doc_id"]: r for r in media.media_index(df).collect()}
    assert "no track" in rows[1]["error"] and "do not fit" in rows[2]["error"] and rows[3]["error"] is None and rows[4]["error"]
    assert [k for k, _, _ in media.boxes(deep, 0, len(deep))] == [b"moov"] * 20_000


def test_sizes_in_few_bits():
    data = media.pack_media(bytes(1152))
    where = {kind: (a, b) for kind, a, b in media.boxes(data, 0, len(data))}
    a, _ = where[b"stsz"]
    changed = bytearray(data)
    changed[a - 4 : a] = b"stz2"
    changed[a : a + 12] = bytes(7) + bytes([4]) + (2).to_bytes(4, "big")
    track = media._track(bytes(changed), {k: v for k, v in where.items() if k != b"stsz"} | {b"stz2": (a, a + 14)})
    assert track["samples"] == 2 and all(size < 16 for _, size in track["keyframes"])


def test_loser_tree_merges_runs():
    rng = random.Random(10)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 50),) * 2 for _ in range(rng.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x[1] for r in runs for x in r)


def test_history_of_pages(spark):
    rows = [(1, "http://B.com/x?b=2&a=1", "<p>é</p>"), (2, "http://a.com", None), (3, "http://a.com/", ""), (7, "http://a.com/", "<p>é</p>"), (5, None, "r\r\n\r\nWARC/1.1\r\n\r\n"), (5, None, "r\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://[bad", "<p>é</p>"), (9, "not a url\n", "z" * 100_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, position int")
    got = warc.capture_history(pages).collect()
    html = {}
    for i, _, h in rows:
        html[i] = (h or "").encode()
    assert len(got) == len(rows)
    for r in got:
        h = html[r["page_id"]]
        top = max(i for i, v in html.items() if v == h and i is not None)
        assert r["payload_bytes"] == len(h) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == top else ("revisit", top))
    ordered = sorted(got, key=lambda r: r["position"])
    assert [r["position"] for r in ordered] == list(range(len(rows)))
    keys = [(r["url_key"], r["captured_at"]) for r in ordered]
    assert keys == sorted(keys)
    assert {r["url_key"] for r in got} >= {"com,b)/x?a=1&b=2", "com,a)/"}
    assert warc.capture_history(pages.limit(0)).count() == 0


def test_records_can_be_fetched_by_their_offsets(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(40)
    warc.write_archives(pages, str(tmp_path / "w"))
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(str(tmp_path / "w"))
    for r in warc.capture_runs(archives).limit(20).collect():
        with open(r["archive"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            (fields, payload, at, size), = warc.read_records(f.read(r["length"]) + b"\r\n\r\n")
        assert fields["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>" and size == r["length"]
        assert r["record_type"] == "revisit" or warc.payload_digest(payload) == r["payload_digest"]


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.capture_history(pages, min_bytes=4).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_parts_keep_the_order(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    runs = warc.capture_history(pages).drop("position", "seen")
    got = sorted(warc.merge_runs(runs, rows_each=17).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(pages.count()))
    keys = [(r["url_key"], r["captured_at"], r["page_id"]) for r in got]
    assert keys == sorted(keys)


def test_damage_is_found():
    good = warc._record("response", 1, "http://a", "2024-01-01T00:00:00Z", warc.payload_digest(b"x"), 1, None, "x") + "\r\n\r\n"
    (fields, payload, at, size), = warc.read_records(gzip.compress(good.encode()))
    assert payload == b"x" and (at, size) == (0, len(good) - 4) and fields["WARC-Type"] == "response"
    with pytest.raises(ValueError):
        list(warc.read_records(good.replace("Length: 1", "Length: 0").encode()))
