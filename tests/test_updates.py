"""Updates across batches, repeated ids, and limits that follow their input."""

import pytest
from pyspark.sql import functions as F

from termwell.operators import bm25, catalog, querylog, ranking, segments
from termwell.plans.stream_queries import _stream, _timestamps
from termwell.plans.tables import frame
from termwell.session import run_dir
from termwell.streaming import jobs


def test_enrichment_takes_as_many_rows_as_asked(spark):
    ranked = spark.createDataFrame([(q, k, 120 if q == 1 else 3) for q in (1, 2) for k in range(200)], "query_id int, position int, top_n int")
    out = ranking.enrich_select(ranked, F.col("top_n"), [F.asc("position")])
    assert {r["query_id"]: r["count"] for r in out.groupBy("query_id").count().collect()} == {1: 120, 2: 3}
    assert ranking.enrich_select(ranked.limit(0), F.col("top_n"), [F.asc("position")]).count() == 0


@pytest.mark.parametrize("files", [1, 2, 3])
def test_ingest_keeps_the_latest_version_in_any_batching(spark, sf, files):
    listing = _timestamps(frame(spark, sf, "listing"), "stored_at")
    path = run_dir(spark, "test-ingest")
    jobs.stream_ingest(_stream(listing, "listing", files, "ord"), path)
    columns = ["chunk_id", "ord", "text", "date_sortable"]
    got = catalog.chunk_upsert(spark.read.parquet(f"{path}/chunks").drop("batch", "expires_at")).select(columns)
    want = catalog.chunk_upsert(catalog.make_chunks(listing, F.col("stored_at"))).select(columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    index = segments.open_index(spark, f"{path}/index")
    indexed = segments.documents(index)
    assert index.n_docs == want.count() and len(index.segments) == files
    assert indexed.count() == indexed.select("chunk_id").distinct().count() == want.count()


def test_repeated_chunk_ids_count_once(spark):
    rows = [(1, "n", "s", "r", "c", ["t"], "alpha beta", 2), (1, "n", "s", "r", "c", ["t"], "gamma", 1), (2, "n", "s", "r", "c", ["t"], "alpha", 3)]
    chunks = spark.createDataFrame(rows, "chunk_id int, name string, section string, region string, category string, tags array<string>, text string, ord int")
    index = bm25.build_index(chunks, order="ord")
    assert index.stats.first()["n_docs"] == 2 and index.doc_len.count() == 2
    assert {r["term"] for r in index.postings.filter("chunk_id = 1").collect()} >= {"gamma"}
    grown = bm25.add_to_index(bm25.build_index(chunks.filter("chunk_id = 1"), order="ord"), chunks.union(chunks))
    assert grown.stats.first()["n_docs"] == 2


def test_near_duplicates_of_text_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six seven"), ("c", "nothing alike here at all")]
    log = spark.createDataFrame([(i, k, t) for k, (i, t) in enumerate(rows)], "query_id string, second int, text string").select(
        "query_id", F.timestamp_seconds(F.col("second") + F.lit(1_700_000_000)).cast("timestamp_ntz").alias("ts"), "text")
    got = {r["query_id"]: r["match_id"] for r in querylog.near_dup_queries(log).collect()}
    assert got == {"a": "b"}


def test_run_progress_state_ends(spark):
    """Two batches of runs far apart: totals go on over batches, and the state of runs that are over goes."""
    from termwell.operators import traces
    from termwell.streaming import runner

    path = run_dir(spark, "test-progress")
    kinds = ["click", "purchase", "error"]
    day = 86_400
    batches = [
        [(1, "click", 0, 1), (1, "purchase", 5, 2), (2, "error", 7, 3)] + [(10 + k, "click", k, 10 + k) for k in range(20)],
        [(1, "click", 50, 40), (2, "click", 60, 41), (3, "click", 3 * day, 42)],
        [(3, "purchase", 3 * day + 5, 43)], [(4, "click", 9 * day, 44)], [(4, "click", 9 * day + 1, 45)],
    ]
    everything = []
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "run_id long, event_type string, s long, event_id long").select(
            "run_id", "event_type", F.timestamp_seconds(F.col("s") + F.lit(1_700_000_000)).alias("ts"), "event_id")
        frame.coalesce(1).write.mode("append").parquet(f"{path}/events")
        everything.append(frame)
        runner.use_rocksdb(spark)
        progress = jobs.stream_events(runner.table_stream(spark, f"{path}/events"), kinds, "click", "purchase", idle="1 day")
        query = progress.writeStream.foreachBatch(lambda batch, n: runner.replace_rows(batch, n, f"{path}/rows", ["run_id"], every=3)).outputMode(
            "update").option("checkpointLocation", f"{path}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
        state = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
        if number == 0:
            first = state
    assert first >= 22 and state < first / 2
    whole = everything[0]
    for frame in everything[1:]:
        whole = whole.unionByName(frame)
    want = traces.run_progress(whole, kinds, "click", "purchase")
    got = runner.current_rows(spark, f"{path}/rows", ["run_id"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    folders = [f.name for f in __import__("pathlib").Path(f"{path}/rows/updates").iterdir() if f.name.startswith("batch=")]
    assert len(folders) < len(batches) * 2
