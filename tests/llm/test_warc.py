import gzip
import hashlib
import json
import re
from pathlib import Path

import pytest
from pyspark.errors import PythonException

from scorelake.llm import warc_shards as W
from scorelake.llm.common import fresh_dir, shared_dir

PAGES = "page_id bigint, url string, html string, key string, shard bigint, range int"


def rows_():
    big = "<p>é" + "x" * 2000
    rows = [(k, f"http://h/{k} ü", f"page {k} " + "y" * (k % 50) * 40, "k", 5, 1) for k in range(200)]
    rows += [(1000 + k, None, big, None, None, None) for k in range(20)] + [(1019, None, big, None, None, None)]
    return rows + [(-5, "u", big, "", 0, 0), (300, "u", "short", "", 0, 0), (301, "u", "short", "", 0, 0), (302, "u", None, "", 0, 0), (303, "u", "", "", 0, 0), (None, "n", "no id", "", 0, 0), (None, "n", big, "", 0, 0), (2**63 - 1, "far", "far", "", 0, 0), (-(2**63), None, "far", "", 0, 0), (2**60 + 1, "u", big, "", 0, 0)]


def brute(rows):
    keep = {}
    for i, _, h, *_ in rows:
        if i is not None:
            keep[h or ""] = max(i, keep.get(h or "", i))
    out = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and (h or "") in keep and i != keep[h or ""]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", keep[h or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000, "roll": 400}])
def test_round_trip_and_same_files_again(spark, options):
    df = spark.createDataFrame(rows_(), PAGES)
    sums = []
    for part in (df, df.repartition(7)):
        uri = W.write_archives(part, fresh_dir(spark, "warc-test"), **options)
        got = [tuple(r) for r in W.read_archives(spark, uri).collect()]
        assert sorted(got, key=str) == brute(rows_())
        home = Path(uri.removeprefix("file://"))
        files = sorted(home.glob("*.warc.gz"))
        sums.append([(f.name, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files])
        listed = [json.loads(x) for f in (home / "manifest").glob("*.json") for x in f.read_text().splitlines()]
        assert sorted((m["name"], m["sha256"]) for m in listed) == sums[-1] and not list((home / "_temp").iterdir())
        if options:
            assert len(files) > 5 and all(m["bytes"] < 400 + 1500 for m in listed)
        with gzip.open(files[0]) as f:
            assert f.readline() == b"WARC/1.1\r\n"
        sizes = {}
        for m in listed:
            sizes[m["shard"]] = sizes.get(m["shard"], 0) + m["payload_bytes"] + W.HEAD * m["records"]
        assert max(sizes.values()) < 2 * options.get("shard_bytes", W.SHARD)  # no id or gap between ids makes a shard long
        (home / "part-99999999-00000.warc.gz").write_bytes(files[0].read_bytes())  # not in the manifest
        assert W.read_archives(spark, uri).count() == len(rows_())
    assert sums[0] == sums[1]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000, "roll": 400}])
def test_equal_rows_over_many_shards_with_ids_of_their_own(spark, options):
    big = "z" * 1500
    rows = [(None, None, None)] * 300 + [(None, "u", big)] * 40 + [(7, "u", big)] * 30 + [(7, "w", big)] * 3 + [(None, "w", None)] * 2 + [(k, "u", big) for k in range(7)] + [(None, f"n{k}", f"{k}" + big) for k in range(40)] + [(9, "u", f"{k}" + big) for k in range(20)]
    made = []
    for parts in (1, 6):
        uri = W.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts), fresh_dir(spark, "warc-test"), **options)
        assert sorted([tuple(r) for r in W.read_archives(spark, uri).collect()], key=str) == brute(rows)
        files = sorted(Path(uri.removeprefix("file://")).glob("*.warc.gz"))
        text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
        ids = re.findall(rb"WARC-Record-ID: (\S+)", text)
        assert len(ids) == len(set(ids)) == len(rows) and set(re.findall(rb"WARC-Refers-To: (\S+)", text)) <= set(ids)
        made.append([(f.name, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files])
        listed = [json.loads(x) for f in (Path(uri.removeprefix("file://")) / "manifest").glob("*.json") for x in f.read_text().splitlines()]
        if options:
            sizes = {}
            for m in listed:
                sizes[m["shard"]] = sizes.get(m["shard"], 0) + m["payload_bytes"] + W.HEAD * m["records"]
            assert len(sizes) > 30 and max(sizes.values()) < 2 * options["shard_bytes"]
    assert made[0] == made[1]


def test_damage_is_found():
    data = W.record(1, "u", b"payload", None)
    with pytest.raises(ValueError):
        list(W.parse(gzip.compress(data.replace(b"payload", b"payloaf"))))
    assert list(W.parse(gzip.compress(data) + gzip.compress(W.record(None, None, b"x", 7)))) == [(1, 7, hashlib.sha1(b"payload").hexdigest(), "response", None), (None, 1, hashlib.sha1(b"x").hexdigest(), "revisit", 7)]


def test_a_missing_or_changed_archive_fails(spark):
    df = spark.createDataFrame(rows_(), PAGES)
    uri = W.write_archives(df, fresh_dir(spark, "warc-test"))
    file = next(Path(uri.removeprefix("file://")).glob("*.warc.gz"))
    data = file.read_bytes()
    for change in (lambda: file.write_bytes(data + gzip.compress(b"")), file.unlink):
        change()
        with pytest.raises(PythonException):
            W.read_archives(spark, uri).collect()


def test_archives_of_a_query_are_deleted(spark):
    home = Path(shared_dir(spark).removeprefix("file://"))
    before = set(home.glob("warc-*"))
    assert W.round_trip(spark.createDataFrame(rows_(), PAGES)).count() == len(rows_())
    assert set(home.glob("warc-*")) == before


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], PAGES)).count() == 0
