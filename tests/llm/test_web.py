"""URL filters and WARC archives."""

import base64
import gzip
import hashlib
import re
from collections import Counter

import pytest

from codelake.llm.queries import RULES
from codelake.llm.url_filter import Rule, propagate, url_filter
from codelake.llm.warc import WarcConfig, parse_record, read_manifest, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, host string, id int, rule string, kind int, shard int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x", 1, 1) for r in rows], SCHEMA)


def test_rules(spark):
    rows = [
        (1, "http://A.Example.com/en/5", ""), (2, "http://a.example.com/en/71?x", None), (3, "https://x.net/de/1", ""), (4, "https://example.net/de/81", ""), (5, "https://b.example.net/de/9#x", ""),
        (6, "http://foo.org/es/x", ""), (7, "http://foo.org/fr/x", ""), (8, None, ""), (9, "no scheme", ""), (10, "http://notexample.com/en/7", ""), (11, "http://com?/en/", ""), (11, "http://com?/en/", ""), (None, "http://x.net", ""),
    ]
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(pages(spark, rows), RULES).collect())
    assert got == Counter(
        [
            (1, "a.example.com", "/en/5", "com/en/", "block"), (2, "a.example.com", "/en/71", "example.com/en/7", "allow"), (3, "x.net", "/de/1", "net/de/", "allow"), (4, "example.net", "/de/81", "example.net/de/8", "block"),
            (5, "b.example.net", "/de/9", "net/de/", "allow"), (6, "foo.org", "/es/x", "org/es/", "block"), (7, "foo.org", "/fr/x", None, "block"), (8, "", "", None, "allow"), (9, "", "", None, "allow"),
            (10, "notexample.com", "/en/7", "com/en/", "block"), (11, "com", "", None, "allow"), (11, "com", "", None, "allow"), (None, "x.net", "", None, "allow"),
        ]
    )
    assert url_filter(pages(spark, []), RULES).count() == 0


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a class="l" href="http://{h}/x">y</a>' for h in hosts) + '<a href="/own">z</a>'
    rows = [(1, "http://good/a", link("near")), (2, "http://near/x", link("far")), (3, "http://far/x", link("far")), (4, "http://bad/a", ""), (5, "http://fan/x", link("bad")), (6, "http://lone/x", None)]
    rules = (Rule("allow", "good", "/a"), Rule("block", "bad", "/a"))
    got = {r.host: (r.verdict, r.trust, r.distrust) for r in url_filter(pages(spark, rows), rules).collect()}
    assert {h: v[0] for h, v in got.items()} == {"good": "allow", "near": "allow", "far": "allow", "bad": "block", "fan": "block", "lone": "allow"}
    assert got["good"][1] == pytest.approx(0.15) and got["near"][1] == pytest.approx(0.15 * 0.85) and got["far"][1] == pytest.approx(0.15 * 0.85**2)
    assert got["fan"][2] == pytest.approx(0.15 * 0.85) and got["far"][2] == 0


def test_ranks_are_those_of_matrices(spark):
    import numpy as np

    links = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 1.0), ("c", "a", 1.0)]
    edges = spark.createDataFrame(links, "src string, dst string, share double")
    seeds = spark.createDataFrame([("a", 3, 0), ("c", 0, 2)], "host string, allowed long, blocked long")
    got = {r.host: (r.trust, r.distrust) for r in propagate(edges, seeds, 0.85, 12).collect()}
    names = "abc"
    m = np.zeros((3, 3))
    for s, d, w in links:
        m[names.index(d), names.index(s)] = w
    back = m.T / np.where(m.sum(1) > 0, m.sum(1), 1)
    start, dis = np.array([3, 0, 0]) * 0.15, np.array([0, 0, 2]) * 0.15
    t, d = start, dis
    for _ in range(12):
        t, d = start + 0.85 * m @ t, dis + 0.85 * back @ d
    for i, h in enumerate(names):
        assert got[h] == (pytest.approx(t[i], abs=1e-8), pytest.approx(d[i], abs=1e-8))


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected_records(rows, least=0):
    out = []
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "")]
        keep = max(same, key=lambda j: (j is not None, j or 0))
        revisit = len((h or "").encode()) >= least and i != keep
        out.append((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", keep if revisit else None))
    return Counter(out)


ROWS = [(5, "http://a/1", "<p>same</p>"), (9, "http://b/2", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c/\r\nX: y", ""), (4, "http://d", None), (None, "http://e", "null id é"), (7, "http://f", "x" * 300_000), (8, "http://g", "WARC/1.1\r\n\r\n"), (9, "http://b/2", "<p>same</p>"), (-3, "http://n", "<p>other</p>")]


@pytest.mark.parametrize("config", [WarcConfig(), WarcConfig(file_bytes=400, shard_bytes=2_000), WarcConfig(revisit_bytes=5)])
def test_archive_round_trip(spark, tmp_path, config):
    root = f"file://{tmp_path}/a"
    manifest = write_warc(pages(spark, ROWS), root, config)
    got = read_warc(manifest, root).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected_records(ROWS, config.revisit_bytes)
    for r in got:
        if r.record_type == "response":
            assert any((h or "").encode() == bytes(r.payload) and i == r.page_id for i, _, h in ROWS)
    files = {f.name for f in (tmp_path / "a").iterdir()}
    assert {f for f in files if not f.endswith(".crc")} == {r.name for r in manifest.collect()} | {"manifest"}
    assert sorted(read_manifest(spark, root).collect()) == sorted(manifest.collect())
    with pytest.raises(FileExistsError):
        write_warc(pages(spark, ROWS), root, config)


def test_shards_of_outlying_and_crowded_ids(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i}") for i in range(300)] + [(2**62, "http://far", "far"), (-(2**63), "http://low", "low"), (None, "http://n", "x")]
    rows += [(150, f"http://same/{i}", f"payload {i}") for i in range(300)] + [(7, "http://h/7", "page 7")] * 3
    root = f"file://{tmp_path}/a"
    manifest = write_warc(pages(spark, rows), root, WarcConfig(shard_bytes=20_000)).collect()
    assert len({r.shard for r in manifest}) >= 12 and max(r.records for r in manifest) < 120
    got = read_warc(read_manifest(spark, root), root).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected_records(rows)
    ids = []
    for r in manifest:
        with gzip.open(tmp_path / "a" / r.name) as f:
            ids += re.findall(rb"WARC-Record-ID: (\S+)", f.read())
    assert len(ids) == len(set(ids))


def test_archives_are_the_same_in_every_run(spark, tmp_path):
    config = WarcConfig(file_bytes=400, shard_bytes=2_000)
    sums = [sorted((r.name, r.sha256) for r in write_warc(pages(spark, rows).repartition(n), f"file://{tmp_path}/{n}", config).collect()) for n, rows in ((1, ROWS), (3, ROWS[::-1]))]
    assert sums[0] == sums[1] and len(sums[0]) > 3


def test_empty_archive_and_damage(spark, tmp_path):
    manifest = write_warc(pages(spark, []), f"file://{tmp_path}/e")
    assert read_warc(manifest, f"file://{tmp_path}/e").count() == 0
    with pytest.raises((ValueError, KeyError)):
        parse_record(b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Block-Digest: sha1:X\r\n\r\nabc\r\n\r\n")
    root = f"file://{tmp_path}/d"
    manifest = write_warc(pages(spark, ROWS), root)
    name = manifest.first().name
    path = tmp_path / "d" / name
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(Exception, match="ends within a record|damaged|records"):
        read_warc(manifest, root).collect()
