import base64
import gzip
import hashlib
import random

import pytest

from lexweave.llm import warc
from tests.llm.odd import docs, none

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (7, "http://a/7", "<p>same</p>"), (3, "http://b/\r\nX: y", "<p>same</p>"), (4, None, None), (5, "http://c", ""), (6, "http://d", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\nä"),
    (8, "http://big", "x" * 700_000), (None, "http://n", "null key"),
]


@pytest.fixture(scope="module", params=["none", "gzip"])
def archive(spark, tmp_path_factory, request):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_warc(pages, path, "page_id", "url", "html", compression=request.param)
    return path


def key(r):
    return r["headers"].get("x-row-key")


def test_round_trip(spark, archive):
    got = {key(r): r for r in warc.read_warc(spark, archive, verify="true").collect()}
    assert len(got) == len(PAGES)
    for k, _, html in PAGES:
        r, payload = got[None if k is None else str(k)], (html or "").encode()
        assert r["payload_length"] == len(payload)
        assert r["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if k in (1, 3):
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("revisit", "<urn:row:7>", b"")
        elif k == 4:
            assert (r["record_type"], r["refers_to"]) == ("revisit", "<urn:row:5>")
        else:
            assert r["record_type"] == "response" and bytes(r["payload"]) == payload
    assert got["3"]["target_uri"] == "http://b/%0D%0AX: y" and got["4"]["target_uri"] is None


def test_pushdown_and_skipping(spark, archive):
    df = warc.read_warc(spark, archive, payload="false")
    got = df.where("record_type = 'response' AND target_uri LIKE 'http://%' AND headers['x-row-key'] > 5").collect()
    assert {key(r) for r in got} == {"6", "7", "8"} and all(r["payload"] is None for r in got)
    reader = warc.WarcReader({"path": archive})
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("headers", "x"), "1")]))
    assert len(rest) == 1 and len(reader.filters) == 1
    seen = []
    original = warc._Buffered.take
    warc._Buffered.take = lambda self, n: (seen.append(n), original(self, n))[1]
    try:
        rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    finally:
        warc._Buffered.take = original
    assert rows == 3 and max(seen) < 1000, "only the blocks of revisits are read"


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "a"), "page_id", "url", "html", revisit_bytes=5)
    kinds = {key(r): r["record_type"] for r in warc.read_warc(spark, str(tmp_path / "a")).collect()}
    assert kinds["4"] == kinds["5"] == "response" and kinds["1"] == "revisit"


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("options", [{"verify": "true"}, {"payload": "false"}, {"payload": "true"}, {"payload": "false", "skip": "all"}])
def test_bad_archives(tmp_path, packed, options):
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 600007\r\n\r\nHTTP\r\n\r\n" + b"x" * 599_999 + b"\r\n\r\n"
    bad = {
        "cut off": (whole[:-6], whole[:300], whole[:-200_000]),
        "no length": (whole.replace(b"Content-Length: 600007\r\n", b""),),
        "no type": (whole.replace(b"WARC-Type: response\r\n", b""),),
        "no WARC": (b"hello\r\n\r\n", whole + b"hello\r\n\r\n"),
        "no empty line": (whole.replace(b"HTTP\r\n\r\n", b"HTTP----") + whole,),
    }
    for match, datas in bad.items():
        if match == "no empty line" and "skip" in options:
            continue  # a block that is passed over isn't looked into
        for data in datas:
            path = tmp_path / ("a.warc.gz" if packed else "a.warc")
            path.write_bytes(gzip.compress(data) if packed else data)
            reader = warc.WarcReader({"path": str(path), **options})
            if "skip" in options:
                list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
            with pytest.raises(ValueError, match=match):
                [list(reader.read(p)) for p in reader.partitions()]


def test_bad_digest_length_and_stream(tmp_path):
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:WRONG\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for name, data, match in (("digest", whole, "digest"), ("number", whole.replace(b"3", b"x"), "invalid literal")):
        (tmp_path / name).write_bytes(data)
        reader = warc.WarcReader({"path": str(tmp_path / name), "verify": "true"})
        with pytest.raises(ValueError, match=match):
            [list(reader.read(p)) for p in reader.partitions()]
    (tmp_path / "half.gz").write_bytes(gzip.compress(whole)[:-12])
    with pytest.raises(ValueError, match="cut off"):
        reader = warc.WarcReader({"path": str(tmp_path / "half.gz"), "payload": "false"})
        [list(reader.read(p)) for p in reader.partitions()]
    with pytest.raises(FileNotFoundError):
        warc.WarcReader({"path": str(tmp_path / "nowhere")}).partitions()


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    pages = [(i, f"http://h/{i}", rng.choice(["", None, "<p>hot</p>", "ä" * 50, f"<p>{rng.randrange(40)}</p>", f"own {i}"])) for i in rng.sample(range(-500, 5000), 400)] + [(None, None, "<p>hot</p>"), (4999999, "u", "<p>hot</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    top = {}
    for i, _, t in pages:
        if i is not None:
            top[t or ""] = max(top.get(t or "", i), i)
    want = []
    for i, _, t in pages:
        data = (t or "").encode()
        first = i == top[t or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top[t or ""]))
    got = warc.op5_warc(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_query_takes_no_block_of_a_revisit(archive):
    sizes = {}
    for kind, options in (("response", {"payload": "false", "verify": "true"}), ("revisit", {"payload": "false"})):
        seen, original = [], warc._Buffered.take
        warc._Buffered.take = lambda self, n, seen=seen: (seen.append(n), original(self, n))[1]
        try:
            reader = warc.WarcReader({"path": archive, **options})
            assert not list(reader.pushFilters([warc.EqualTo(("record_type",), kind)]))
            rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        finally:
            warc._Buffered.take = original
        sizes[kind] = rows, len(seen)
    assert sizes == {"response": (5, 5), "revisit": (3, 0)}


def test_members_and_folded_headers(tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: a\r\n  b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "m.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    reader = warc.WarcReader({"path": str(tmp_path / "m.warc.gz")})
    (batch,) = [b for p in reader.partitions() for b in reader.read(p)]
    assert batch.num_rows == 2 and dict(batch.column("headers")[0].as_py())["x-long"] == "a b"


def test_odd_rows(spark, tmp_path):
    warc.write_warc(docs(spark), str(tmp_path / "a"), "doc_id", "source", "text")
    assert warc.read_warc(spark, str(tmp_path / "a"), verify="true").count() == docs(spark).count()
    warc.write_warc(none(spark), str(tmp_path / "b"), "doc_id", "source", "text")
    assert warc.read_warc(spark, str(tmp_path / "b")).count() == 0
