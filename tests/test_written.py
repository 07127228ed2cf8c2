"""Logs that retries do not double, versions that replace days, phrase search, and replays that read once."""

import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.operators import actions, compliance, recalls
from depotlens.plans.actions import Loops
from depotlens.plans.adapters import EVENTS, Inputs, compliance_of, document_columns, readings_of
from depotlens.sources import action_log
from depotlens.sources.scratch import exists, materialise, new_path, shared_dir, workspace
from depotlens.streaming import alerts, sinks, sources, windows


def rows(df):
    return sorted(map(str, df.collect()))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# action log

def test_appending_again_adds_nothing(spark, small):
    path, loops = new_path(spark, "log"), Loops(Inputs(spark, small))
    frames = [loops.dispatches, loops.quarantines, loops.markdowns]
    for frame in frames:
        action_log.append_actions(frame, path)
    once = rows(action_log.read_actions(spark, path))
    for frame in frames:
        action_log.append_actions(frame, path)
        action_log.append_actions(frame.unionByName(frame), path)
    assert rows(action_log.read_actions(spark, path)) == once and once


def test_an_append_adds_what_is_new(spark, small):
    path, loops = new_path(spark, "log"), Loops(Inputs(spark, small))
    some = loops.markdowns.where(F.pmod(F.xxhash64("action_id"), F.lit(2)) == 0)
    action_log.append_actions(some, path)
    action_log.append_actions(loops.markdowns, path)
    whole = new_path(spark, "log")
    action_log.append_actions(loops.markdowns, whole)
    assert 0 < some.count() < loops.markdowns.count()
    assert rows(action_log.read_actions(spark, path)) == rows(action_log.read_actions(spark, whole))


def test_an_append_reads_the_days_it_writes(spark, small):
    path, loops = new_path(spark, "log"), Loops(Inputs(spark, small))
    action_log.append_actions(loops.dispatches, path)
    action_log.append_actions(loops.markdowns, path)
    text = plan(action_log.known_entries(spark, path, [dt.date(2024, 1, 2)]).select("action_id"))
    assert "PartitionFilters: [isnotnull(day" in text and "2024-01-02" in text


def some_actions(spark, data):
    """Actions of (action_id, loop, timestamp, sku_id); all else is null."""
    given = spark.createDataFrame(data, "action_id string, loop string, timestamp timestamp, sku_id string")
    return given.select(*[F.col(c) if c in given.columns else F.lit(None).cast(schemas.ACTION_LOG[c].dataType).alias(c) for c in actions.ACTION_COLUMNS])


def test_entries_of_repeated_and_null_ids(spark):
    """One entry for each id and place, whatever repeats: rows that are the same, ids with several loops, and ids, loops and times that are null."""
    day = lambda n: dt.datetime(2024, 1, n, 5)
    data = [(f"a{n}", "pos_markdown", day(1 + n % 3), f"s{n}") for n in range(40)]
    data += data[:7] + [("b", "pos_markdown", day(1), "x"), ("b", "equipment_dispatch", day(1), None), ("c", None, day(2), "y"), ("d", "wms_quarantine", None, "z"),
                        (None, "pos_markdown", day(2), "n"), (None, "equipment_dispatch", day(2), None), (None, "pos_markdown", day(2), "n")]
    path, frame = new_path(spark, "log"), some_actions(spark, data)
    for _ in range(2):
        action_log.append_actions(frame, path)
        got = action_log.read_actions(spark, path).select("action_id", "seq", "type", "sku_id").collect()
        assert len(got) == len({(r.action_id, r.seq) for r in got}) == 2 * 40 + 2 + 1 + 2 + 2
        assert {(r.action_id, r.seq) for r in got} == {(a, n) for a, loop, *_ in data for n in (0, 1) if n or loop not in (None, "equipment_dispatch")}
        assert all((r.type, r.sku_id is not None) == ({"d": "quarantine"}.get(r.action_id, "markdown"), True) if r.seq == 0 else (r.type, r.sku_id) == (None, None) for r in got)
    assert files_by_day(spark, path) == {"2024-01-01", "2024-01-02", "2024-01-03", "__HIVE_DEFAULT_PARTITION__"}


def files_by_day(spark, path):
    return {f.split("day=")[1].split("/")[0] for f in spark.read.parquet(path).inputFiles()}


@pytest.mark.parametrize("at", [dt.datetime(2024, 1, 1, 5), None])
def test_actions_of_one_day_are_written_where_they_are_read(spark, monkeypatch, at):
    """No exchange moves whole entries, and actions are evaluated once for both their entries."""
    path, plans, parquet = new_path(spark, "log"), {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, to, *a, **k: (plans.update({to: plan(self._df)}), parquet(self, to, *a, **k))[1])
    action_log.append_actions(some_actions(spark, [(f"a{n}", "pos_markdown", at, f"s{n}") for n in range(30)]), path)
    assert plans[path].count("FileScan") == 1 and "Exchange" not in plans[path] and "Sort" not in plans[path]
    assert action_log.read_actions(spark, path).count() == 60 and len(files_by_day(spark, path)) == 1


def test_an_append_leaves_no_copy(spark, tmp_path):
    held = lambda: {str(f) for f in pathlib.Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet")}
    before = held()
    action_log.append_actions(some_actions(spark, [("a", "pos_markdown", dt.datetime(2024, 1, 1), "s")]), str(tmp_path / "log"))
    assert held() == before and list((tmp_path / "log").rglob("*.parquet"))


# document log

@pytest.fixture(scope="module")
def log(spark, small):
    path, i = new_path(spark, "documents"), Inputs(spark, small)
    # Recalls of few documents, so that months without a hit remain.
    named = recalls.recall_match(i.recalls, i.documents).orderBy("bol_id").limit(3).select(F.col("matched_recall").alias("recall_number")).distinct()
    few = materialise(i.recalls.join(named, "recall_number", "left_semi"), "few")
    i.documents.withColumn("month", F.trunc("received_date", "month")).repartition("month").write.partitionBy("month").parquet(path)
    return path, few


def files_by_part(spark, path):
    out = {}
    for f in spark.read.parquet(path).inputFiles():
        out.setdefault(f.split("month=")[1].split("/")[0], set()).add(f)
    return out


def test_only_folders_with_hits_are_replaced(spark, log):
    path, few = log
    before = spark.read.parquet(path)
    expected, old = rows(recalls.apply_quarantine(few, before).select(before.columns)), files_by_part(spark, path)
    days = recalls.write_quarantine(few, path, part="month")
    new = files_by_part(spark, path)
    touched = {str(d) if d else "__HIVE_DEFAULT_PARTITION__" for d in days}
    assert rows(spark.read.parquet(path).select(before.columns)) == expected
    assert 0 < len(touched) < len(old) and set(new) == set(old)
    assert all((new[d] == old[d]) == (d not in touched) for d in old)


def test_folders_are_written_once(spark, small, tmp_path, monkeypatch):
    """Beside the new folders no copy of their rows is stored, and the rows are those of the SQL's terms."""
    i, path, stored = Inputs(spark, small), str(tmp_path / "log"), []
    i.documents.withColumn("month", F.trunc("received_date", "month")).repartition("month").write.partitionBy("month").parquet(path)
    before = spark.read.parquet(path)
    expected = rows(recalls.apply_quarantine(i.recalls, before).select(before.columns))
    monkeypatch.setattr(recalls, "materialise", lambda df, name, **options: (stored.append(name), materialise(df, name, **options))[1])
    recalls.write_quarantine(i.recalls, path, part="month")
    assert rows(spark.read.parquet(path).select(before.columns)) == expected and stored == []
    recalls.write_quarantine(i.recalls, path, part="month")
    assert rows(spark.read.parquet(path).select(before.columns)) == expected


def test_rows_without_a_recalled_lot_stay_where_they_are(spark, small, tmp_path, monkeypatch):
    """Only rows whose lot may be named go to the join and to their folder again; the rest is written from the scan, without a sort."""
    i, path, moved = Inputs(spark, small), str(tmp_path / "log"), []
    i.documents.withColumn("month", F.trunc("received_date", "month")).repartition("month").write.partitionBy("month").parquet(path)
    before = spark.read.parquet(path)
    hits, all_rows = recalls.affected_documents(i.recalls, before).count(), before.count()
    apply = recalls.apply_quarantine
    expected = rows(apply(i.recalls, before).select(before.columns))
    monkeypatch.setattr(recalls, "apply_quarantine", lambda r, d, s: (moved.append(d.count()), apply(r, d, s))[1])
    recalls.write_quarantine(i.recalls, path, part="month")
    assert rows(spark.read.parquet(path).select(before.columns)) == expected
    assert len(moved) == 1 and 0 < hits <= moved[0] <= hits + all_rows // 50 < all_rows // 2
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_marks_miss_no_lot(spark):
    lots = spark.range(20_000).select(F.concat(F.lit("LOT-"), F.col("id") * 2).alias("lot"))
    shipped = spark.range(40_000).select(F.when(F.col("id") > 0, F.concat(F.lit("LOT-"), "id")).alias("_lot"), "id")
    shipped = shipped.unionByName(shipped.where("id < 9"))
    odd, even, none = (recalls.marked_lots(shipped, lots.union(spark.sql("select cast(null as string)")), "lot").where(w)
                       for w in ("id % 2 = 1", "id % 2 = 0 and id > 0", "id = 0"))
    assert even.count() == even.where("_maybe").count() == 20_003 and odd.count() == 20_004
    assert odd.where("_maybe").count() < 400 and [r._maybe for r in none.collect()] == [False, False]
    assert recalls.marked_lots(shipped, lots.limit(0), "lot").where("_maybe").count() == 0


def test_document_rows_are_narrower_and_make_the_same_documents(spark, small):
    i = Inputs(spark, small)
    assert document_columns(i.document_rows).columns == i.documents.columns and len(i.document_rows.columns) < len(i.documents.columns)
    assert rows(document_columns(i.document_rows)) == rows(i.documents)


def test_without_hits_nothing_is_written(spark, log):
    path, few = log
    old = files_by_part(spark, path)
    assert recalls.write_quarantine(few.withColumn("lot_numbers", F.lit("none")), path, part="month") == [] and files_by_part(spark, path) == old


# phrase search

PRODUCTS = ["Smoked Salmon", "salmonella test kit", "Pink Salmon 2kg", "Tuna", "ab", "b", "", "Öl extra", "aaaa", "banana bread", "Bananas"]
PHRASES = ["salmon", "on", "a", "aaa", "bana", "ananas", "öl", "smoked salmon x", "nothing", "tuna", "kg"]


def test_phrases_are_found_as_by_substring(spark):
    catalogue = spark.createDataFrame([(v, p) for v in ("v", "w") for p in PRODUCTS] + [(None, "Tuna")], "vendor string, product string")
    phrases = spark.createDataFrame([(v, p) for v in ("v", "x", None) for p in PHRASES], "vendor string, phrase string")
    got = sorted((r.vendor, r.phrase, r["product"]) for r in recalls.phrase_hits(phrases, catalogue).collect())
    assert got == sorted(("v", f, p) for f in PHRASES for p in PRODUCTS if f in p.lower())


def test_random_phrases(spark):
    r = random.Random(3)
    products = sorted({"".join(r.choice("abc ") for _ in range(r.randint(0, 9))) for _ in range(300)})
    asked = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(60)})
    got = recalls.phrase_hits(spark.createDataFrame([("v", p) for p in asked], "vendor string, phrase string"),
                              spark.createDataFrame([("v", p) for p in products], "vendor string, product string"))
    assert sorted((x.phrase, x["product"]) for x in got.collect()) == sorted((f, p) for f in asked for p in products if f in p)


def test_a_vendor_with_many_products_and_recalls_makes_no_pairs(spark):
    """Each phrase shares its rarest run with few products, so the join makes few rows where vendor alone would make 400 times 300."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    products = [f"{word()} {word()} frozen" for _ in range(400)]
    asked = [p.split()[r.randint(0, 1)] for p in r.sample(products, 200)] + [word() for _ in range(100)]
    hits = recalls.phrase_hits(spark.createDataFrame([("hot", p) for p in asked], "vendor string, phrase string"),
                               spark.createDataFrame([("hot", p) for p in products], "vendor string, product string"))
    condition = [line for line in plan(hits).splitlines() if "Join" in line and "_gram" in line]
    assert condition and all("_gram" in line for line in plan(hits).splitlines() if "Join" in line and "vendor" in line)
    found = hits.collect()
    assert sorted((x.phrase, x["product"]) for x in found) == sorted((f, p) for f in asked for p in products if f in p) and len(found) >= 200


def test_stored_runs_are_not_broadcast(spark):
    """A few kilobytes of file hold all runs of all products, so the size of the file says little."""
    products = [(f"v{v}", f"{a} {b}") for v in range(50) for a in ("large", "small", "hot") for b in ("ring", "bolt", "gear")]
    hits = recalls.phrase_hits(spark.createDataFrame([(f"v{v}", "ring") for v in range(50)], "vendor string, phrase string"),
                               spark.createDataFrame(products, "vendor string, product string"))
    assert hits.count() == 150
    hits.collect()
    assert "Join" in plan(hits) and "Broadcast" not in plan(hits)


# replay

@pytest.fixture
def written(monkeypatch):
    """The sources that each write reads."""
    seen, parquet = [], DataFrameWriter.parquet

    def watched(self, path, *args, **kwargs):
        seen.append(self._df.inputFiles())
        return parquet(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    return seen


@pytest.mark.parametrize("slices", [1, 4])
def test_a_replay_reads_the_table_once(spark, small, written, slices):
    events = Inputs(spark, small).raw_events
    build = lambda opened: windows.breach_counts_tumbling(readings_of(opened()))
    got = sinks.replay_in_order(events, "ts", build, new_path(spark, "replay"), slices, bytes_per_slice=1 << 20)
    reads = sum(any(f in files for f in events.inputFiles()) for files in written)
    assert reads == 1 and len(written) == 1 + slices
    batch = windows.breach_counts_tumbling(Inputs(spark, small).readings)
    newest = Inputs(spark, small).readings.agg(F.max("timestamp")).head()[0]
    assert rows(got) == rows(batch.where(F.col("window_end") <= F.lit(newest) - F.expr("interval 10 minutes")))


def test_slices_follow_each_other_and_hold_every_row(spark, small):
    events = Inputs(spark, small).raw_events.select("event_id", "ts")
    odd = events.unionByName(spark.createDataFrame([(-1, None), (-2, None)], events.schema))
    folders = sinks.cut_by_time(odd, "ts", new_path(spark, "cut"), 5, 256 << 20)
    spans = [spark.read.schema(odd.schema).parquet(f).agg(F.min("ts"), F.max("ts"), F.count("*"), F.count("ts")).first() for f in folders]
    assert len(folders) == 5 and sum(s[2] for s in spans) == odd.count() and spans[0][2] - spans[0][3] == 2
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sinks.cut_by_time(odd.limit(0), "ts", new_path(spark, "cut"), 3) == []


# escalations

def late_breaches(spark, small, hours):
    events = Inputs(spark, small).events
    seen = F.when(F.col("status") == "RESOLVED", F.coalesce("resolved_at", "timestamp")).otherwise(F.col("timestamp"))
    newest = events.where("status = 'RESOLVED' or event_type = 'temperature_breach'").agg(F.max(seen)).head()[0]
    closed = F.col("timestamp") + F.expr(f"interval {hours} hours") < F.lit(newest.replace(microsecond=newest.microsecond // 1000 * 1000) - dt.timedelta(minutes=10))
    return rows(compliance.unresolved_after(events, hours).where(closed).select("asset_id", "event_id", "timestamp", "status"))


@pytest.mark.parametrize("hours", [1, 6])
@pytest.mark.parametrize("order", ["one file", "by time", "shuffled"])
def test_escalations_equal_the_batch_form(spark, small, order, hours):
    events, root = Inputs(spark, small).raw_events, new_path(spark, "escalations")
    if order == "by time":
        got = sinks.replay_in_order(events, "ts", lambda opened: alerts.escalations(compliance_of(opened()), hours), root, 6)
    else:
        (events.coalesce(1) if order == "one file" else events.repartition(7, F.xxhash64("event_id"))).write.parquet(f"{root}/landing")
        opened = sources.file_stream(spark, f"{root}/landing", EVENTS)  # all files are one micro-batch
        got = sinks.drain_to_table(alerts.escalations(compliance_of(opened), hours), f"{root}/t", f"{root}/c")
    expected = late_breaches(spark, small, hours)
    assert rows(got.select("asset_id", "event_id", "timestamp", "status")) == expected and expected


def test_an_escalation_fires_without_further_events_of_its_asset(spark):
    root, start = new_path(spark, "timer"), dt.datetime(2024, 1, 1)
    schema = "event_id string, asset_id string, event_type string, status string, timestamp timestamp, resolved_at timestamp"
    at = lambda minutes: start + dt.timedelta(minutes=minutes)
    waves = [[("b1", "x", "temperature_breach", "OPEN", at(0), None), ("b2", "y", "temperature_breach", "OPEN", at(1), None)],
             [("r2", "y", "audit", "RESOLVED", at(40), at(50))], [("o1", "z", "audit", "RESOLVED", at(100), None)], [("o2", "z", "audit", "RESOLVED", at(101), None)]]
    found = []
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{root}/landing")
        opened = spark.readStream.schema(schema).parquet(f"{root}/landing")
        found.append([r.event_id for r in sinks.drain_to_table(alerts.escalations(opened), f"{root}/t", f"{root}/c").collect()])
    assert found[0] == found[1] == [] and found[-1] == ["b1"]


# scratch

def test_a_workspace_keeps_its_result_alone(spark):
    paths = []

    def work():
        paths.append(new_path(spark, "inner"))
        first = materialise(spark.range(5), "first")
        paths.extend(first.inputFiles())
        return workspace(spark, "nested", lambda: materialise(first.where("id > 1"), "second")).union(first)

    result = workspace(spark, "outer", work)
    assert sorted(r.id for r in result.collect()) == [0, 1, 2, 2, 3, 3, 4, 4]
    assert not any(exists(spark, p) for p in paths) and all(f.split(":", 1)[-1].lstrip("/").startswith(shared_dir(spark).split(":", 1)[-1].lstrip("/")) for f in result.inputFiles())


def test_a_workspace_is_removed_when_work_fails(spark):
    paths = []

    def work():
        paths.extend(materialise(spark.range(3), "table").inputFiles())
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError, match="stop"):
        workspace(spark, "failing", work)
    assert paths and not any(exists(spark, p) for p in paths)
