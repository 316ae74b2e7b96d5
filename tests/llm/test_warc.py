import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest
import zstandard

from faultline.llm import queries
from faultline.llm.warc import DICTIONARY, MARK, Frames, dictionary_frame, information, read_archives, record, records, unpacked, write_archives
from tests.llm.corpus import prose


def page_rows(seed=4):
    rng = random.Random(seed)
    long = ["<p>" + prose(rng, rng.randint(30, 200)) + "</p>" for _ in range(40)]
    odd = [None, "", "x" * 99, "x" * 100, "é" * 50, "é" * 49, "a\r\n\r\nb" * 40, MARK.decode() * 30, "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9, "long " * 300_000]
    htmls = long + odd * 3 + [long[0]] * 60 + long[:10] * 2
    rows = [(i if i % 11 else None, f"http://a.b/{i}?q=ü", h) for i, h in enumerate(htmls)]
    rows += [rows[3]] * 4 + [(7, None, long[7]), (7, "x\r\ny", long[7]), (None, None, long[8]), (None, None, long[8])] + [(50, "u", "same " * 30)] * 5
    rng.shuffle(rows)
    return rows


def expected(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = Counter()
    for payload, pages in groups.items():
        known = (len(payload), hashlib.sha256(payload).hexdigest())
        pages.sort(key=lambda p: (p is None, p or 0))
        for k, page in enumerate(pages):
            revisit = k > 0 and len(payload) >= 100
            out[(page, *known, "revisit" if revisit else "response", pages[0] if revisit else None)] += 1
    return out


NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
SCHEMA = "page_id long, url string, html string"


def test_query(spark, tmp_path):
    rows = page_rows()
    path = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/pages.parquet")
    got = Counter(tuple(r[n] for n in NAMES) for r in queries.op11_warc(spark, path).collect())
    assert got == expected(rows)


def test_archives(spark, written, tmp_path):
    """Archives are streams of Zstandard frames under a dictionary, each record a frame of its own, and give the texts again."""
    rows = page_rows(6)
    pages = written([(*r, 1, "x", b"y") for r in rows], SCHEMA + ", size int, digest string, payload binary", 4)
    path = f"{tmp_path}/archives"
    write_archives(pages, f"file://{path}")
    files = [f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-")]
    found = []
    for name in files:
        with open(name, "rb") as f:
            data = f.read()
        assert data[:4] == DICTIONARY
        size = int.from_bytes(data[4:8], "little")
        dictionary, frames = data[8 : 8 + size], data[8 + size :]
        assert dictionary and zstandard.get_frame_parameters(frames.split(MARK)[1]).dict_id == zstandard.ZstdCompressionDict(dictionary).dict_id()
        pieces = [p for p in frames.split(MARK) if p]
        streams = [list(records(unpacked(p, dictionary))) for p in pieces]
        assert all(len(s) == 1 for s in streams)  # each piece by itself is one whole record
        assert streams[0][0][0]["WARC-Type"] == "warcinfo"
        assert list(records(unpacked(data, b""))) == [s[0] for s in streams]  # and the file is one stream, read with its own dictionary
        found += [s[0] for s in streams[1:]]
    for fields, block in found:
        assert int(fields["Content-Length"]) == len(block) and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    assert len(found) == len(rows)
    plain = sum(len(b) for _, b in found)
    assert sum(os.path.getsize(f) for f in files) < plain / 2
    # each revisit refers to a response
    ids = {f["WARC-Record-ID"] for f, _ in found if f["WARC-Type"] == "response"}
    assert all(f["WARC-Refers-To"] in ids for f, _ in found if f["WARC-Type"] == "revisit")
    back = read_archives(spark, f"file://{path}").collect()
    texts = {r.payload_digest: bytes(r.payload) for r in back if r.record_type == "response"}
    shown = lambda u: u and u.replace("\r", "%0D").replace("\n", "%0A")
    assert Counter((r.page_id, r.url, texts[r.payload_digest]) for r in back) == Counter((p, shown(u), (h or "").encode()) for p, u, h in rows)


def test_splits_within_an_archive(spark, written, tmp_path):
    """An archive is read by several tasks, none of which starts at its dictionary but the first."""
    rows = [(i, f"http://a.b/{i}", os.urandom(2000).hex()) for i in range(300)]
    path = f"file://{tmp_path}/one"
    write_archives(written(rows, SCHEMA, 1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = read_archives(spark, path)
        assert read.rdd.getNumPartitions() > 4
        assert {r.page_id: bytes(r.payload).decode() for r in read.collect()} == {i: h for i, _, h in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_another_writers_archive(spark, tmp_path):
    """Frames without marks, behind a dictionary that is compressed itself."""
    samples = [f"<p>record {i} of many that are alike {i * 7}</p>".encode() * 4 for i in range(400)]
    dictionary = zstandard.train_dictionary(4000, samples).as_bytes()
    frames = Frames(dictionary)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    body = b"".join(frames(record(i, f"u{i}", s, len(s), digest(s), None, False, "2001-01-01T00:00:00Z")) for i, s in enumerate(samples[:50]))
    with open(f"{tmp_path}/other.warc", "wb") as f:
        f.write(dictionary_frame(zstandard.ZstdCompressor().compress(dictionary)) + frames(information("2001-01-01T00:00:00Z")) + body)
    assert {r.page_id: bytes(r.payload) for r in read_archives(spark, f"file://{tmp_path}/other.warc").collect()} == dict(enumerate(samples[:50]))


def test_no_frame_holds_the_mark():
    frames = Frames(b"")
    for data in (MARK, MARK * 5, b"ab" + MARK + os.urandom(300) + MARK, os.urandom(5) + MARK * 2 + b"P*M\x18\0\0"):
        assert MARK not in frames(data) and unpacked(frames(data), b"") == data


def test_damage_is_noticed(spark, written, tmp_path):
    path = f"{tmp_path}/a"
    write_archives(written([(1, "u", "text")], SCHEMA, 1), f"file://{path}")
    name = next(f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-"))
    with open(name, "rb") as f:
        data = bytearray(f.read())
    data[-30] ^= 1
    os.makedirs(f"{path}-bad")
    with open(f"{path}-bad/x.txt", "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="PythonException|Zstd|zstd|digest|checksum"):
        read_archives(spark, f"file://{path}-bad").collect()


def test_empty_table(spark, written, tmp_path):
    write_archives(written([], SCHEMA, 1), f"file://{tmp_path}/none")
    assert read_archives(spark, f"file://{tmp_path}/none").count() == 0
