import os
import uuid
from datetime import datetime

import pytest

from hindcast.plans.feed_to_events import feed_to_events
from hindcast.sources import feeds
from hindcast.streaming.feeds import feed_micro_batch, stream_feed_documents


def item(title="Up", link="https://example.org/1", guid="g1", date="Mon, 14 Jul 2025 15:30:00 GMT"):
    tag = lambda n, v, a="": "" if v is None else f"<{n}{a}>{v}</{n}>"
    return "<item>" + tag("title", title) + tag("link", link) + tag("guid", guid, ' isPermaLink="false"') + tag("pubDate", date) + "</item>"


def rss(*items):
    return '<?xml version="1.0" encoding="UTF-8"?>\n<!-- c -->\n<rss version="2.0"><channel><title>T</title>' + "".join(items) + "</channel></rss>"


THREE_AND_ONE = rss(
    item(" One ", guid="g1"), item("Two", guid=None, link="https://example.org/2"), item("Three &amp; more", guid=None, link=None),
    item(None, guid="bad"),
)


def parse(spark, xml, ticker="AAPL", **options):
    docs = spark.createDataFrame([(ticker, "d", xml)], "ticker string, document string, xml string")
    return feeds.parse_feeds(docs, **options)


def test_items_ids_and_skips(spark):
    parsed = parse(spark, THREE_AND_ONE)
    row = parsed.first()
    assert (row.error, row.n_items, row.skipped) == (None, 3, 1)
    events = {e.headline: e for e in feeds.feed_events(parsed, "p").collect()}
    name = lambda key: str(uuid.uuid5(uuid.NAMESPACE_URL, f"p:rss:AAPL:{key}"))
    assert events["One"].event_id == name("g1")
    assert events["Two"].event_id == name("https://example.org/2")
    assert events["Three & more"].url is None
    assert events["One"].published_at == datetime(2025, 7, 14, 15, 30)
    again = {e.event_id for e in feeds.feed_events(parse(spark, THREE_AND_ONE), "p").collect()}
    assert again == {e.event_id for e in events.values()}


@pytest.mark.parametrize(
    "xml, ticker, error",
    [
        ("<html><body>busy</body></html>", "AAPL", "channel not found"),
        ("<rss><channel><item>", "AAPL", "invalid XML"),
        ("not xml", "AAPL", "invalid XML"),
        (rss(), "TSLA", "out of universe"),
        (rss(), " aapl ", None),
        ("<rss version='2.0'><channel/></rss>", "AAPL", None),
        ("<channel>" + item() + "</channel>", "AAPL", None),
        ('<r:rss xmlns:r="urn:x"><r:channel>' + item().replace("<item>", "<r:item>").replace("</item>", "</r:item>") + "</r:channel></r:rss>", "AAPL", None),
        ("<rss><other/></rss>", "AAPL", "channel not found"),
    ],
)
def test_documents(spark, xml, ticker, error):
    assert parse(spark, xml, ticker).first().error == error


def test_namespaced_and_bare_channels_keep_items(spark):
    bare = "<channel>" + item() + "</channel>"
    spaced = '<r:rss xmlns:r="urn:x"><r:channel>' + item().replace("<item>", "<r:item>").replace("</item>", "</r:item>") + "</r:channel></r:rss>"
    for xml in (bare, spaced):
        assert parse(spark, xml).first().n_items == 1


def test_cap_keeps_feed_order(spark):
    xml = rss(*[item(f"t{i}", guid=f"g{i}") for i in range(5)])
    row = parse(spark, xml, max_items=2).first()
    assert [i.title for i in row["items"]] == ["t0", "t1"] and row.n_items == 5
    with pytest.raises(ValueError):
        parse(spark, xml, max_items=0)


def test_one_bad_document_stops_nothing(spark, folder):
    docs = spark.createDataFrame(
        [("AAPL", "a", THREE_AND_ONE), ("MSFT", "b", "<html/>"), ("NVDA", "c", rss(item()))], "ticker string, document string, xml string"
    )
    summary = feed_to_events(docs, f"{folder}/records").first()
    assert (summary.fetched, summary.produced, summary.skipped_items, summary.errors, summary.ok) == (3, 4, 1, 1, False)
    assert spark.read.parquet(f"{folder}/records").count() == 4


def test_landed_files_in_micro_batches(spark, folder):
    def land(ticker, name, xml):
        os.makedirs(f"{folder}/in/ticker={ticker}", exist_ok=True)
        open(f"{folder}/in/ticker={ticker}/{name}.xml", "w").write(xml)

    def run():
        stream = stream_feed_documents(spark, f"{folder}/in")
        feed_micro_batch(stream, f"{folder}/out", f"{folder}/sum", f"{folder}/ck", available_now=True).awaitTermination()
        return spark.read.parquet(f"{folder}/out")

    land("AAPL", "one", THREE_AND_ONE)
    land("MSFT", "one", "<html/>")
    assert run().count() == 3
    # The same feed lands again: more records, no new ids.
    land("AAPL", "two", THREE_AND_ONE)
    out = run()
    assert out.count() == 6 and out.select("key").distinct().count() == 3
    assert spark.read.parquet(f"{folder}/sum").filter("ticker = 'MSFT'").first().errors == 1
    assert feeds.scan_feed_documents(spark, f"{folder}/in").count() == 3
