"""Derivations, payloads, ranking and resolution on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from termwell.functions import text as T
from termwell.operators import freshness, ranking, resolve, traces
from termwell.sources import frames, logs, payloads


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("date,expected", [
    ("May 2025", "2025-05"), ("Year Round", None), ("Rolling", None), ("2025-05-04", "2025"), ("Nov / Jan 2026", "2026-01"),
    ("Market 2026", "2026-03"), ("", None), ("soon", None),
])
def test_date_sortable(spark, date, expected):
    assert value(spark, T.date_sortable(F.lit(date))) == expected


def test_ids(spark):
    assert value(spark, T.stable_id(F.lit("GRE General Test"), F.lit("ETS"))) == "gre-general-test-ets-42e8ce"
    assert value(spark, T.slug(F.lit("--A  b!"))) == "a-b"


def test_undated_rule_beats_year(spark):
    assert value(spark, T.date_sortable(F.lit("TBA 2025"))) is None


def stale(spark, date, stored, year_round=False, as_of="2026-11-30"):
    column = freshness.stale(
        F.lit(date).cast("string"), F.lit(stored).cast("timestamp"), F.lit(year_round), F.lit(as_of).cast("timestamp")
    )
    return value(spark, column)


@pytest.mark.parametrize("date,stored,year_round,expected", [
    ("2025-05", "2026-09-30", False, True), ("2025-05", "2026-10-02", False, False), ("2026-11", "2020-01-01", False, False),
    ("2025-05", "2020-01-01", True, False), ("2026", "2026-09-01", False, True), ("2025-05", None, False, True), (None, None, False, False),
])
def test_stale(spark, date, stored, year_round, expected):
    assert stale(spark, date, stored, year_round) is expected


@pytest.mark.parametrize("confidence,relevance,position,total,expected", [(0.97, 1.0, 0, 1, 0.9835), (0.8, 0.5, 2, 4, 0.6725)])
def test_hybrid_score(spark, confidence, relevance, position, total, expected):
    column = ranking.hybrid_score(F.lit(confidence), F.lit(relevance), F.lit(position), F.lit(total))
    assert value(spark, column) == expected


def test_position_score(spark):
    frame = spark.createDataFrame([("q", n) for n in range(5)], "query_id string, ord long")
    out = ranking.position_score(frame, ["query_id"], ["ord"]).orderBy("ord").collect()
    assert [r["final_score"] for r in out] == [1.0, 0.82, 0.64, 0.46, 0.28]


@pytest.mark.parametrize("tokens_in,tokens_out,model,cost", [
    (1000, 500, "claude-sonnet-4-20250514", 0.0105), (1_000_000, 0, "", 3.0), (0, 1_000_000, "Claude-Opus-4-20250514-x", 75.0),
    (1_000_000, 0, "claude-3-5-haiku", 0.8), (1_000_000, 0, "unheard-of", 3.0),
])
def test_token_cost(spark, tokens_in, tokens_out, model, cost):
    assert value(spark, traces.token_cost(F.lit(tokens_in), F.lit(tokens_out), F.lit(model))) == pytest.approx(cost)


def test_nearest_rank(spark):
    frame = spark.createDataFrame([("g", v) for v in range(1, 21)], "g string, value long")
    assert traces.nearest_rank(frame, ["g"], "value").first()["value"] == 20


def test_payload_edges(spark):
    item = (
        '{"name":"A","category":"c","region":"Asia","countries":["x"],"date":"d","deadline":"e","difficulty":"Hard","duration":"1h",'
        '"cost":"$1","org":"o","subjects":["s"],"tags":["t"],"confidence":"bad"}'
    )
    raws = {
        "fenced": f"```json\n[{item}]\n```", "object": item, "text": "no data", "empty": "[]", "mixed": f'[{item}, 5, "x", null, {{"name": "B"}}]',
        "trailing": f"[{item}] and more", "cut": f"[{item}",
    }
    frame = spark.createDataFrame(list(raws.items()), "payload_id string, raw string")
    items = payloads.payload_parse(frame)
    counts = {r["payload_id"]: r["count"] for r in items.groupBy("payload_id").count().collect()}
    assert counts == {"fenced": 1, "mixed": 2}
    rejected = {r["payload_id"] for r in payloads.rejected_payloads(frame).collect()}
    assert rejected == {"object", "text", "empty", "trailing", "cut"}
    assert payloads.payload_rows(items).count() == 2
    assert payloads.skipped_rows(items).count() == 1
    assert [r["confidence"] for r in payloads.payload_enriched(items).collect()] == [None, None]


def test_frames_read_from_file(spark, tmp_path):
    text = 'event: plan_ready\ndata: {"n": 1}\n\nevent: broken\ndata: {"n": \n\nevent: done\ndata: {"n": 2}\n\n'
    (tmp_path / "events.txt").write_text(text)
    out = frames.event_frames(frames.read_frames(spark, str(tmp_path))).collect()
    assert [(r["event"], r["data"]) for r in out] == [("plan_ready", '{"n": 1}'), ("done", '{"n": 2}')]


def test_log_context_wins(spark):
    lines = [
        '{"ts":"2025-01-01T00:00:00","level":"INFO","logger":"a","msg":"m","agent":"x","path":"/p","other":1,"context":{"agent":"ctx","path":""}}',
        "not json",
    ]
    out = logs.log_ingest(spark.createDataFrame([(line,) for line in lines], "value string")).collect()
    assert len(out) == 1 and out[0]["agent"] == "ctx" and out[0]["path"] == "/p" and "other" not in out[0].asDict()


RECORDS = "ord long, name string, org string, cost string, deadline string, date string, website string, description string, difficulty string, score double, match_reasons array<string>"


def test_resolution(spark):
    rows = [
        (1, "GRE", "ETS", "Unknown", "Rolling", "May 2025", "www.x", "short", "Hard", 0.9, ["a"]),
        (2, "gre ", "ets", "$220", "March 2025", "", "https://x", "much longer text", "Medium", 0.5, ["b"]),
        (3, "Gre", "ETS", "", "Rolling", None, None, None, "Medium", 0.4, ["a"]),
        (4, "Solo", "X", "tbd", "n/a", "d", None, None, "Hard", 0.95, []),
    ]
    frame = spark.createDataFrame(rows, RECORDS)
    chosen = {r["field"]: (r["resolved"], r["strategy"], r["confidence"], r["flagged"]) for r in resolve.conflicts(frame).collect()}
    assert chosen == {
        "cost": ("$220", "prefer_known_cost", 0.75, False), "deadline": ("March 2025", "prefer_specific_deadline", 0.70, False),
        "website": ("https://x", "prefer_valid_url", 0.90, False), "description": ("much longer text", "longest_description", 0.85, False),
        "difficulty": ("Medium", "majority_vote", 0.667, False),
    }
    merged = resolve.resolve_conflicts(frame).collect()
    assert [(r["ord"], r["cost"], r["records"], r["n_reasons"]) for r in merged] == [(4, "tbd", 1, 0), (1, "$220", 3, 2)]


def test_rerank(spark):
    ranked = spark.createDataFrame([("q", p) for p in range(14)] + [("s", p) for p in range(3)], "query_id string, position long")
    picks = spark.createDataFrame([("q", 0, 3), ("q", 1, 3), ("q", 2, 99), ("q", 3, 0), ("q", 4, 13), ("s", 0, 2)], "query_id string, pick_no long, position long")
    out = {(r["query_id"], r["position"]): (r["new_position"], r["rank_source"]) for r in ranking.rerank_merge(ranked, picks).collect()}
    order = sorted((new, old) for (q, old), (new, _) in out.items() if q == "q")
    assert [old for _, old in order] == [3, 0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]
    assert out[("q", 0)][1] == "bm25+llm" and out[("s", 0)] == (0, "bm25")


def test_filters_with_unknowns(spark):
    schema = "date string, date_sortable string, countries array<string>, cost_usd double"
    frame = spark.createDataFrame([("May 2025", None, ["USA"], None), ("Year Round", "2024", ["India"], 0.0)], schema).coalesce(1)
    row = {c: F.col(c) for c in frame.columns}
    none = F.array().cast("array<string>")

    def passed(year=0, month=None, countries=none, free=False):
        keep = ranking.passes_filters(row, F.lit(year), F.lit(month).cast("string"), countries, F.lit(free))
        return [r["v"] for r in frame.select(keep.alias("v")).collect()]

    assert passed() == [True, True]
    assert passed(free=True) == [False, True]
    assert passed(year=2025) == [True, False]
    assert passed(month="June") == [False, True]
    assert passed(countries=F.array(F.lit("usa"))) == [True, False]


def test_store_is_read_by_bucket(spark):
    from termwell.operators import catalog
    from termwell.session import run_dir

    rows = [(f"id{k}", f"Exam No {k % 40}", k) for k in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, name string, ord int")
    path = run_dir(spark, "test-store")
    catalog.write_store(chunks, path, 8)
    store = catalog.open_store(spark, path, 8)
    names = spark.createDataFrame([("exam no 3!",), ("EXAM NO 17",), ("unknown",)], "name string")
    found = catalog.chunks_for_exam(store, names)
    assert sorted(r.chunk_id for r in found.collect()) == sorted(i for i, n, _ in rows if n in ("Exam No 3", "Exam No 17"))
    plan = found._jdf.queryExecution().sparkPlan()
    assert 1 <= plan.collectLeaves().head().optionalBucketSet().get().cardinality() <= 3  # buckets read
    assert "regexp_replace" not in plan.toString()
    many = names.union(spark.createDataFrame([(f"Exam No {k}",) for k in range(5)], "name string"))
    catalog_limit, catalog.LOOKUP_NAMES = catalog.LOOKUP_NAMES, 2
    try:
        joined = catalog.chunks_for_exam(store, many)
        assert joined.count() == 30
    finally:
        catalog.LOOKUP_NAMES = catalog_limit
    assert sorted(r.chunk_id for r in catalog.evict_exams(store, store.filter("slug = 'exam-no-3'")).collect()) == sorted(i for i, n, _ in rows if n != "Exam No 3")
