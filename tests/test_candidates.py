"""Paged listings as a data source, and candidates against a plain walk over pages."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from tessera.operators import candidates
from tessera.sources.paged import FIELDS, ListingPages, PageReader

IN, OUT = "1710000000", "1500000000"


def row(code, id_, published=IN, detail=None, date=IN, question="What?", reply="That."):
    return dict(zip(FIELDS, (code, id_, published, detail or code, date, question, reply)))


PAGES = {
    "A": [[row("A", "1"), row("B", "2"), row("A", "1"), row("A", "3", OUT), row("A", "3")], [row("A", "4", question="<p>What?</p>"), row("A", "5", question="Who?", reply=" <br>")], [row("A", "6", question="Q &amp; A", date=1710000000000)]],
    "B": [[row("B", "6", question="again"), row("B", None), row("B", "7", published="soon"), row("B", "8", detail="A"), row("B", "9", question="Why?", date="1400000000")], None, [row("B", "10", question="beyond the gap")]],
    "C": ["broken"],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("listing")
    for stock, pages in PAGES.items():
        (root / stock).mkdir()
        for i, rows in enumerate(pages, 1):
            if rows is not None:
                (root / stock / f"{i}.json").write_text(json.dumps(rows), encoding="utf-8")
    return str(root)


@pytest.fixture(scope="module")
def listing(spark, folder):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    spark.dataSource.register(ListingPages)
    yield spark.read.format("listing_pages").load(folder)
    spark.conf.set(name, before)


def test_pages_are_partitions_up_to_the_first_gap(listing):
    rows = listing.collect()
    assert {(r["stock_code"], r["page"]) for r in rows} == {("A", 1), ("A", 2), ("A", 3), ("B", 1), ("C", 1)} and listing.rdd.getNumPartitions() == 5
    bad = [r for r in rows if r["stock_code"] == "C"]
    assert len(bad) == 1 and "no list of objects" in bad[0]["error"] and bad[0]["place"] is None


def test_filters_choose_the_pages_that_are_read(spark, folder, listing):
    read = lambda limit=0: spark.read.format("listing_pages").option("pages_per_stock", limit).load(folder)
    assert read().filter("stock_code = 'A' AND page >= 2").rdd.getNumPartitions() == 2
    assert read().filter("stock_code = 'A' AND page >= 2").count() == 3
    assert read().filter("stock_code IN ('A', 'B') AND page < 2").rdd.getNumPartitions() == 2
    assert read(1).filter("stock_code IN ('A', 'nobody')").count() == 5
    assert [(p.stock, p.page) for p in PageReader(folder, 2).partitions()] == [("A", 1), ("A", 2), ("B", 1), ("C", 1)]


def test_rejections_against_a_plain_walk(listing):
    seen, hashes, want = set(), set(), {}
    clean = lambda t: " ".join(t.replace("<p>", "").replace("</p>", "").replace("<br>", "").replace("&amp;", "&").split())
    inside = lambda s: s.isdigit() and 1704038400 <= (int(s) // 1000 if int(s) > 10**10 else int(s)) < 1767196800
    for stock in ("A", "B"):
        for page, rows in enumerate(PAGES[stock][: 3 if stock == "A" else 1], 1):
            for place, r in enumerate(rows):
                code, id_, published, detail, date, question, reply = (r[k] for k in FIELDS)
                digest = hashlib.sha256(f"{clean(question)}\n{clean(reply)}".encode()).hexdigest()
                if code != stock:
                    reason = "other_stock"
                elif not id_ or id_ in seen:
                    reason = "duplicate_question"
                elif not inside(published):
                    reason = "out_of_window"
                else:
                    seen.add(id_)
                    reason = "detail_rejected" if detail != stock or not inside(str(date)) or not clean(question) or not clean(reply) else "duplicate_content" if digest in hashes else None
                    hashes |= set() if reason else {digest}
                want[stock, page, place] = reason
    rows = candidates.judged(listing.filter("error IS NULL"), "2024-01-01", "2025-12-31")
    assert {(r["stock_code"], r["page"], r["place"]): r["reason"] for r in rows.collect()} == want
    assert set(want.values()) == {None, *candidates.REASONS}
    counts = {r["reason"]: r["n"] for r in candidates.rejections(rows).collect()}
    assert sum(counts.values()) == len(want) and counts["candidate"] == sum(v is None for v in want.values())
    assert [r[0] for r in candidates.mismatched_stocks(listing.filter("stock_code = 'A'"), "2020-01-01", "2020-12-31").collect()] == ["A"]


def test_days_of_odd_stamps(spark):
    stamps = ["0", "-5", "", None, "x", "1704038399", "1704038400", "1704038400000", "99999999999999999999"]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, s string").select("i", candidates.local_day(F.col("s")).cast("string").alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == [None, None, None, None, None, "2023-12-31", "2024-01-01", "2024-01-01", None]
