"""Operators on small frames with known answers."""

import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import actions, ledger, records, reports
from ledgerloom.operators.scope import Scope, ScopeError, sync_gate
from ledgerloom.plans import run
from ledgerloom.sources import files, sinks
from ledgerloom.streaming import sync


def test_scopes_fail_closed(spark):
    for args in (("clerk",), ("manager",), ("facilitator", 1)):
        with pytest.raises(ScopeError):
            Scope(*args)
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 1)], "l int, s int")
    may = Scope("facilitator", 1, 1).may_write(F.col("l"), F.col("s"))
    assert [r[0] for r in df.select(may).collect()] == [True, False, False, False]
    stamped = Scope("manager", 9).stamp(spark.createDataFrame([(1,)], "location_id int"))
    assert stamped.first()["location_id"] == 9


def test_sync_gate(spark):
    df = spark.createDataFrame([("player", None), ("session", "lounge"), ("session", "lesson"), ("other", None)], "e string, t string")
    gate = lambda s: [r[0] for r in df.select(sync_gate(s, F.col("e"), ("player", "session"), F.col("t"))).collect()]
    assert gate(Scope("facilitator", 1, 1)) == ["forbidden_entity", "forbidden_session_type", None, "forbidden_entity"]
    assert gate(Scope("founder")) == [None, None, None, "unknown_entity"]


def test_founding_dataset(spark):
    """73 learners, 12 regulars and 16 repeats make 85 players."""
    people = [(f"Learner{i:02d}", "Mokoena", f"{2008 + i % 6}-01-01") for i in range(73)] + [(f"Lounge{i:02d}", "Dlamini", None) for i in range(12)]
    repeats = people[:10] + [(f"  {a.upper()} ", f"{b} ", c) for a, b, c in people[10:13]] + people[73:76]
    from ledgerloom.functions import text

    df = spark.createDataFrame(people + repeats, "f string, l string, b string")
    keyed = df.select(text.name_key(F.col("f"), F.col("l")).alias("name_key"), text.dedup_key(F.col("f"), F.col("l"), F.col("b")).alias("dedup_key"))
    assert keyed.count() == 101
    none = keyed.where("false")
    out = records.identity_outcomes(keyed, none)
    assert out.select("dedup_key").distinct().count() == 85
    assert out.where("outcome <> 'new'").count() == 0


def test_ambiguous_names_flag_everyone(spark):
    df = spark.createDataFrame([("a|b", "a|b|1"), ("a|b", "a|b|2"), ("c|d", "c|d|"), ("|", "||")], "name_key string, dedup_key string")
    out = {r["dedup_key"]: r["outcome"] for r in records.identity_outcomes(df, df.where("false")).collect()}
    assert out == {"a|b|1": "AMBIGUOUS_MERGE", "a|b|2": "AMBIGUOUS_MERGE", "c|d|": "new", "||": "MISSING_NAME"}


def test_merge_prefers_confidence_then_presence(spark):
    df = spark.createDataFrame([("k", 0, 0.4, "3", None), ("k", 1, 0.95, " ", "Smith")], "k string, ord int, conf double, grade string, last string")
    r = records.merge_attributes(df, "k", ["grade", "last"], "conf", "ord").first()
    assert (r["grade"], r["last"]) == ("3", "Smith")


def test_last_write_any_order(spark):
    rows = [("k", datetime(2024, 1, d), f"c{d}", i, float(d)) for i, d in enumerate((3, 9, 1, 7))] + [("k", None, "z", 9, 99.0)]
    df = spark.createDataFrame(rows, "k string, created_at timestamp_ntz, client_id string, seq int, value double")
    assert ledger.last_write(df, "k", ["value"], "seq").first()["value"] == 9.0
    got = [r["outcome"] for r in ledger.edit_outcomes(df.where("created_at is not null"), "k", "seq").orderBy("seq").collect()]
    assert got == ["insert", "update", "skip", "skip"]


def test_rejected_draws_take_nothing(spark):
    start = spark.createDataFrame([(1, 100), (2, None)], "entitlement_id long, remaining_units long")
    rows = [(1, f"c{i}", datetime(2024, 1, i + 1), a) for i, a in enumerate((60, 50, 40, 1))] + [(2, "x", datetime(2024, 1, 1), 10**6), (1, "c0", datetime(2024, 2, 1), 60)]
    draws = spark.createDataFrame(rows, "entitlement_id long, client_id string, created_at timestamp_ntz, amount long")
    got = {r[0]: tuple(r)[1:] for r in ledger.fold_draws(start, draws).collect()}
    assert got == {1: (0, 2, 2), 2: (None, 1, 0)}


def test_revenue_of_nothing_is_zero(spark):
    pay = spark.createDataFrame([], "product_id long, player_id long, amount_cents long, location_id int")
    prod = spark.createDataFrame([], "id long, type string")
    people = spark.createDataFrame([], "id long, school_id int")
    assert tuple(reports.revenue_summary(pay, prod, people, Scope("manager", 1)).first()) == (0, 0, 0)


def test_validation_bounds(spark):
    rows = [("a", "sessions", {"player_name": "x", "started_at": "2024-01-02"}, 0.7), ("b", "players", {"birth_date": "2022-01-01"}, 0.69), ("c", "lessons", {}, 0.9)]
    df = spark.createDataFrame(rows, "record_id string, target_table string, payload map<string,string>, confidence_score double")
    out = records.validate(df, None, F.array().cast("array<bigint>"), F.lit("2024-01-01").cast("date"))
    got = {r["record_id"]: list(r["reasons"]) for r in out.collect()}
    assert got == {"a": ["IMPOSSIBLE_DATE"], "b": ["LOW_CONFIDENCE", "IMPOSSIBLE_DATE"], "c": []}


def test_stages_and_retry():
    assert run.stages_to_run("archive") == ("collect", "archive")
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert run.Retry().call(flaky, waits.append) == "done"
    assert waits == [0.5, 1.0]


def _docx(path, body):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")


def test_batch_run_end_to_end(spark, tmp_path):
    """One image and one document: parsed, validated, loaded and archived."""
    source = tmp_path / "source"
    for r in files.ROUTES:
        (source / r.subfolder).mkdir(parents=True)
    (source / "cards" / "one.png").write_bytes(b"png")
    (source / "cards" / "notes.txt").write_text("x")
    p = lambda s: f"<w:p><w:r><w:t>{s}</w:t></w:r></w:p>"
    _docx(source / "lessons" / "week1.docx", "".join(map(p, ("LESSON: Home Row Basics", "TOPIC: Keyboarding", "Intro", "METRIC: Kabelo | WPM | 42"))))
    players = spark.createDataFrame([(1, "Kabelo", "M")], "id long, first_name string, last_name string")
    answer = '{"records":[{"target_table":"payments","confidence":0.9,"payload":{"player_name":"Kabelo M","amount":"R30","paid_at":"2023-12-01"}}]}'
    providers = run.Providers({"stub": lambda: lambda request: answer})
    tables = run.run_batch(spark, run.Settings(f"file://{source}", f"file://{tmp_path}/state"), providers, players)
    counts = run.summary(tables)
    assert counts["collected"] == 2 and counts["extracted"] == 3 and counts["archived"] == 2
    # the metric names its player by a bare first name, which the validator flags
    assert counts["flagged"] == 1 and counts["inserted"] == 2
    assert tables["collect"].where("skip_reason like 'unsupported%'").count() == 1
    assert {r[0] for r in files.absent_folders(tables["collect"]).collect()} == {"registers", "consents", "payments"}
    csvs = spark.read.option("header", True).csv(f"file://{tmp_path}/state/run-1/csv/lessons")
    assert csvs.first()["title"] == "Home Row Basics"


def test_csv_headers_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "record_id string, target_table string, payload map<string,string>, confidence_score double, source_file string")
    for path in sinks.write_record_csvs(empty, str(tmp_path)):
        names = spark.read.option("header", True).csv(path).columns
        assert "record_id" in names


def test_ledger_only_grows(spark, tmp_path):
    book = sinks.AppendOnly(str(tmp_path / "consents"))
    rows = spark.createDataFrame([(1, "photo", True, datetime(2024, 1, 1))], "player_id int, consent_type string, granted boolean, granted_at timestamp")
    book.append(rows)
    book.revoke(rows, F.lit("2024-02-01").cast("timestamp"))
    assert [r["granted"] for r in book.read(spark).orderBy("granted_at").collect()] == [True, False]


def test_manifest_and_resume(spark):
    ev = spark.createDataFrame([("r", "extract", "file", "a", 1, "pending", None), ("r", "extract", "file", "a", 2, "done", None), ("r", "extract", "file", "b", 3, "failed", "x")],
                               "run_id string, stage string, kind string, target string, seq int, status string, reason string")
    todo = sinks.remaining_files(spark.createDataFrame([("a",), ("b",), ("c",)], "path string"), sinks.manifest_state(ev), "extract")
    assert sorted(r[0] for r in todo.collect()) == ["b", "c"]


def test_approvals_in_both_forms(spark, tmp_path):
    (tmp_path / "a.csv").write_text("record_id,note\nx,1\ny,2\n")
    (tmp_path / "b.txt").write_text("x\n\ny\n")
    for name in ("a.csv", "b.txt"):
        assert sorted(r[0] for r in files.read_approvals(spark, str(tmp_path / name)).collect()) == ["x", "y"]


def test_batch_output_lines(spark, tmp_path):
    (tmp_path / "o.out").write_text('{"recordId":"a","modelOutput":{"content":[{"type":"text","text":"x"},{"type":"tool"},{"type":"text","text":"y"}],"stop_reason":"end"}}\n\n')
    assert tuple(files.read_batch_output(spark, str(tmp_path / "*.out")).first()) == ("a", "xy", "end")


def test_roles_along_a_chain(spark):
    grants = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 0)], "member int, role int")
    assert actions.reachable_roles(grants.where("member < 40")).count() == 40 * 41 // 2
    assert actions.reachable_roles(grants).count() == 41 * 41


def test_second_run_loads_nothing_again(spark, tmp_path):
    """Players first, then their payments; a second run finds all of them stored."""
    source = tmp_path / "src"
    (source / "cards").mkdir(parents=True)
    (source / "cards" / "a.png").write_bytes(b"x")
    (source / "notes.txt").write_text("n")
    answer = (
        '{"records":['
        '{"target_table":"players","confidence":0.9,"payload":{"first_name":"Kabelo","last_name":"M","birth_date":"2012-03-04"}},'
        '{"target_table":"players","confidence":0.8,"payload":{"first_name":"kabelo","last_name":"m","birth_date":"2012-03-04","grade":"5"}},'
        '{"target_table":"players","confidence":0.9,"payload":{"first_name":"Thandi","last_name":"N","birth_date":"2011-01-01"}},'
        '{"target_table":"players","confidence":0.9,"payload":{"first_name":"Thandi","last_name":"N","birth_date":"2010-01-01"}},'
        '{"target_table":"payments","confidence":0.9,"payload":{"player_name":"Kabelo M","amount":"R30","paid_at":"2023-12-01"}}]}'
    )
    providers = run.Providers({"stub": lambda: lambda request: answer})
    nobody = spark.createDataFrame([], "id long, first_name string, last_name string")
    settings = run.Settings(f"file://{source}", f"file://{tmp_path}/state")
    first = run.run_batch(spark, settings, providers, nobody, run_id="one")
    counts = run.summary(first)
    assert (counts["inserted"], counts["duplicate"], counts["AMBIGUOUS_MERGE"], counts["archived"]) == (2, 1, 2, 1)
    people = first["players"].collect()
    assert [(r["first_name"].lower(), r["grade"]) for r in people] == [("kabelo", "5")]
    assert first["load"].where("target_table = 'payments'").first()["player_id"] == people[0]["id"]
    again = run.run_batch(spark, settings, providers, nobody, run_id="two")
    counts = run.summary(again)
    assert "inserted" not in counts and counts["merged"] == 2 and counts["duplicate"] == 1 and counts["archived"] == 0
    assert [tuple(r) for r in again["players"].collect()] == [tuple(r) for r in people]


def test_keyless_rows_and_audit_actions(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), ("k", "c"), ("k", "d"), ("old", "e")], "natural_key string, record_id string")
    old = spark.createDataFrame([("old",), (None,)], "natural_key string")
    got = {r["record_id"]: r["disposition"] for r in records.insert_if_absent(rows, "natural_key", ["record_id"], old).collect()}
    assert got == {"a": "no_key", "b": "no_key", "c": "inserted", "d": "duplicate", "e": "duplicate"}
    bad = spark.createDataFrame([("truncate",)], "action string")
    with pytest.raises(Exception, match="no audit action"):
        sinks.checked_actions(bad).collect()


def _answers(*records):
    return '{"records":[' + ",".join(records) + "]}"


def test_run_loads_references_and_consents(spark, tmp_path):
    """Schools, products and consents are resolved, else flagged with their reasons; a table's metrics are read."""
    source = tmp_path / "src"
    (source / "cards").mkdir(parents=True)
    (source / "lessons").mkdir()
    (source / "cards" / "a.png").write_bytes(b"x")
    cell = lambda s: f"<w:tc><w:p><w:r><w:t>{s}</w:t></w:r></w:p></w:tc>"
    row = lambda *c: "<w:tr>" + "".join(map(cell, c)) + "</w:tr>"
    table = "<w:tbl>" + row("Student", "Quiz 1", "Quiz 2") + row("Kabelo M", "7", "8") + "</w:tbl>"
    _docx(source / "lessons" / "week.docx", table + table)
    session = '{"target_table":"sessions","confidence":0.9,"payload":{"player_name":"Kabelo M","session_type":"%s","started_at":"2023-12-01","school_name":"%s"}}'
    payment = '{"target_table":"payments","confidence":0.9,"payload":{"player_name":"Kabelo M","amount":"R30","paid_at":"2023-12-0%d","product_name":"%s"}}'
    consent = '{"target_table":"consents","confidence":0.9,"payload":{"player_name":"%s","consent_type":"%s","granted":"%s"}}'
    answer = _answers(
        session % ("lesson", "hill  SIDE"), session % ("kit", "nowhere"), session % ("party", "nowhere"), payment % (1, "Pass"), payment % (2, "twice"), payment % (3, ""),
        consent % ("Kabelo M", "photo", "no"), consent % ("Kabelo M", "", "no"), consent % ("", "photo", "yes"),
    )
    players = spark.createDataFrame([(1, "Kabelo", "M")], "id long, first_name string, last_name string")
    schools = spark.createDataFrame([(5, "Hill Side")], "id long, name string")
    products = spark.createDataFrame([(7, "pass"), (8, "Twice"), (9, "twice")], "id long, name string")
    providers = run.Providers({"stub": lambda: lambda request: answer})
    settings = run.Settings(f"file://{source}", f"file://{tmp_path}/state")
    go = lambda name: run.run_batch(spark, settings, providers, players, run_id=name, schools=schools, products=products)
    first = go("one")
    counts = run.summary(first)
    assert {k: counts.get(k) for k in ("UNRESOLVED_SCHOOL", "BAD_SESSION_TYPE", "UNRESOLVED_PRODUCT", "MISSING_CONSENT_TYPE", "MISSING_PLAYER", "appended")} == {
        "UNRESOLVED_SCHOOL": 1, "BAD_SESSION_TYPE": 1, "UNRESOLVED_PRODUCT": 1, "MISSING_CONSENT_TYPE": 1, "MISSING_PLAYER": 1, "appended": 1,
    }
    rows = {(r["target_table"], r["disposition"], r["school_id"], r["product_id"]) for r in first["load"].collect()}
    assert ("sessions", "inserted", 5, None) in rows and ("payments", "inserted", None, 7) in rows and ("payments", "inserted", None, None) in rows
    # two tables of two quizzes: four records, of which two have the key of another
    metrics = [r["disposition"] for r in first["load"].where("target_table = 'student_metrics'").collect()]
    assert sorted(metrics) == ["duplicate", "duplicate", "inserted", "inserted"]
    book = sinks.AppendOnly(f"file://{tmp_path}/state/consents")
    assert [(r["player_id"], r["consent_type"], r["granted"]) for r in book.read(spark).collect()] == [(1, "photo", False)]
    assert "appended" not in run.summary(go("two")) and book.read(spark).count() == 1


def test_resume_goes_on_with_what_is_left(spark, tmp_path):
    """A call that fails is a failed file; a resumed run asks for it alone and keeps the rest."""
    source = tmp_path / "src"
    (source / "cards").mkdir(parents=True)
    (source / "cards" / "a.png").write_bytes(b"a")
    asked = tmp_path / "asked"

    def client():
        def call(request):
            with open(asked, "a") as f:
                f.write(request["path"].rsplit("/", 1)[1] + "\n")
            if (tmp_path / "down").exists():
                raise RuntimeError("the service is down")
            return _answers('{"target_table":"lessons","confidence":0.9,"payload":{"title":"%s"}}' % request["path"][-5:])

        return call

    providers = run.Providers({"stub": lambda: client()})
    nobody = spark.createDataFrame([], "id long, first_name string, last_name string")
    settings = run.Settings(f"file://{source}", f"file://{tmp_path}/state")
    go = lambda **more: run.run_batch(spark, settings, providers, nobody, "validate", "r", **more)
    with pytest.raises(FileNotFoundError):
        go(resume=True)
    assert go()["extract"].count() == 1
    (source / "cards" / "b.png").write_bytes(b"b")
    (tmp_path / "down").write_text("")
    halted = go(resume=True)
    assert [r["reason"] for r in halted["failures"].collect()] == ["extract_failed: RuntimeError: the service is down"]
    manifest = sinks.Manifest(spark, f"file://{tmp_path}/state/r/manifest", "r")
    assert manifest.stage_status("extract") == "completed" and manifest.stage_status("load") == "pending"
    status = {r["target"].rsplit("/", 1)[1]: r["status"] for r in manifest.state().where("stage = 'extract' and kind = 'file'").collect()}
    assert status == {"a.png": "done", "b.png": "failed"}
    (tmp_path / "down").unlink()
    asked.unlink()
    whole = go(resume=True)["extract"]
    assert sorted(r["payload"]["title"] for r in whole.collect()) == ["a.png", "b.png"]
    assert set(asked.read_text().split()) == {"b.png"}
    manifest = sinks.Manifest(spark, f"file://{tmp_path}/state/r/manifest", "r")
    assert [manifest.stage_status(s) for s in ("collect", "extract", "validate")] == ["completed"] * 3
    manifest.record_skip("archive", "x", "why")
    manifest.record_skip("archive", "x", "why")
    assert manifest.events().where("kind = 'skip' and stage = 'archive'").count() == 2 and manifest.state().where("target = 'x'").isEmpty()


def test_command_line_reads_answers(spark, tmp_path, capsys):
    source, state = tmp_path / "src", tmp_path / "state"
    (source / "cards").mkdir(parents=True)
    (source / "cards" / "a.png").write_bytes(b"a")
    path = files.list_files(spark, f"file://{source}").first()["path"]
    said = _answers('{"target_table":"lessons","confidence":0.9,"payload":{"title":"T"}}')
    line = {"recordId": path, "modelOutput": {"content": [{"type": "text", "text": said}]}}
    (tmp_path / "out.jsonl").write_text(json.dumps(line) + "\n")
    at = ["--source-folder", f"file://{source}", "--state-dir", f"file://{state}"]
    assert run.main([*at, "--answers", f"file://{tmp_path}/out.jsonl"]) == 0
    assert "inserted: 1" in capsys.readouterr().out
    assert run.main([*at, "--resume", "unknown"]) == 1
    assert run.main([*at, "--reference-date", "today"]) == 2
    assert run.main([*at, "--config", str(tmp_path / "none.json")]) == 2


def test_settings_from_file_and_environment(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"llm_provider": "Batch", "confidence_threshold": 0.5}')
    got = run.load_settings("s", "t", str(path), env={"CONFIDENCE_THRESHOLD": "0.9", "LLM_PROVIDER": ""})
    assert (got.provider, got.threshold) == ("batch", 0.9)
    path.write_text("[1]")
    with pytest.raises(run.ConfigError):
        run.load_settings("s", "t", str(path), env={})
    for wrong in ("2", "high"):
        with pytest.raises(run.ConfigError):
            run.load_settings("s", "t", env={"CONFIDENCE_THRESHOLD": wrong})


def test_batch_jobs_end_or_fail(spark, tmp_path):
    states, waits = iter(["Submitted", "InProgress", "Completed"]), []
    run.await_job(lambda: next(states), 30, sleep=waits.append)
    assert waits == [30, 30]
    with pytest.raises(run.BatchFailed):
        run.await_job(lambda: "Stopped")
    with pytest.raises(run.BatchFailed):
        run.await_job(lambda: "InProgress", 30, 60, sleep=waits.append)
    asked = spark.createDataFrame([("a", "image/png", "x"), ("b", "image/png", "y")], "path string, media_type string, data string")

    def submit(given, out):
        assert spark.read.text(given).count() == 2
        spark.createDataFrame([('{"recordId":"b","modelOutput":{"content":[{"type":"text","text":"yes"}]}}',)], "value string").write.text(out)
        return lambda: "Completed"

    got = run.generate_in_batch(asked, f"file://{tmp_path}/job", submit)
    assert sorted((tuple(r) for r in got.collect()), key=str) == [("a", None), ("b", "yes")]


def test_draws_in_order_with_resets_and_signatures(spark):
    """A fold in plain Python gives the same status, reason and units for every draw."""
    import random

    rng = random.Random(5)
    day = lambda: datetime(2024, 1, rng.randint(1, 28), rng.randint(0, 23))
    rules = [None, {"reset": "monday", "hours_per_week": "1"}, {"units": "9"}]
    held = [(k, rng.choice([None, 0, 50, 90]), rng.choice(["active", "active", "expired"]), rng.choice([None, datetime(2024, 1, 1).date()]), rules[k % 3]) for k in range(9)]
    asked = [(rng.randrange(11), f"c{rng.randrange(150)}", day(), rng.choice([None, -1, 10, 20, 40]), rng.random() < 0.8) for _ in range(400)]
    e = spark.createDataFrame(held, "entitlement_id long, remaining_units long, status string, valid_from date, rules map<string,string>")
    d = spark.createDataFrame(asked, "entitlement_id long, client_id string, created_at timestamp_ntz, amount long, signed boolean")
    got = sorted(((r[0], r[2], r[1], r[3], r[4], r[5]) for r in ledger.draw_results(e, d).collect()), key=str)

    least = {}
    for key, client, at, amount, _ in asked:
        order = (at, -(10**9) if amount is None else amount)
        least[key, client] = min(least.get((key, client), order), order)
    want, taken = [], set()
    state = {h[0]: [h[1], h[3]] for h in held}
    info = {h[0]: h for h in held}
    for key, client, at, amount, signed in sorted(asked, key=lambda x: (x[0], x[2], x[1], x[3] is not None, x[3] or 0)):
        left, since = state.get(key, (None, None))
        first = (key, client) not in taken and (at, -(10**9) if amount is None else amount) == least[key, client]
        taken |= {(key, client)} if first else set()
        if amount is None or amount <= 0:
            want.append((key, at, client, "rejected", "invalid_amount", left))
        elif key not in info:
            want.append((key, at, client, "rejected", "not_found", None))
        elif not first:
            want.append((key, at, client, "skipped", None, left))
        else:
            if key % 3 == 1:
                monday = at.date() - timedelta(days=at.weekday())
                if since is not None and monday > since:
                    left = 60
                since = monday if since is None else max(since, monday)
            status, reason = "applied", None
            if info[key][2] != "active":
                status, reason = "rejected", "inactive"
            elif left is not None and left < amount:
                status, reason = "rejected", "insufficient_units"
            elif left is not None and not signed:
                status, reason = "rejected", "signature_failed"
            elif left is not None:
                left -= amount
            state[key] = [left, since]
            want.append((key, at, client, status, reason, left))
    assert sorted(want, key=str) == got


def test_changes_and_compaction_give_the_same_table(spark, tmp_path):
    schema = "k string, created_at timestamp, client_id string, value int"
    table = sync.LastWriteTable(spark, f"file://{tmp_path}/t", "k", ["value"], spark.createDataFrame([], schema).schema)
    batch = lambda *rows: spark.createDataFrame([(k, datetime(2024, 1, d), c, v, i) for i, (k, d, c, v) in enumerate(rows)], f"{schema}, seq int")
    table.apply(batch(("a", 2, "x", 1), ("a", 1, "z", 9), ("b", 1, "x", 2)), 0)
    table.apply(batch(("a", 1, "y", 5), ("c", 1, "x", 3)), 1)
    rows = lambda: sorted((r["k"], r["value"]) for r in table.read().collect())
    assert rows() == [("a", 1), ("b", 2), ("c", 3)]
    table.compact()
    table.apply(batch(("b", 3, "x", 7)), 2)
    table.apply(batch(("b", 3, "x", 7)), 2)
    assert rows() == [("a", 1), ("b", 7), ("c", 3)]


def test_stream_of_draws_with_nulls_newlines_and_old_receipts(spark):
    day = lambda n: datetime(2024, 1, n)
    schema = "entitlement_id long, client_id string, created_at timestamp, amount long, start_units long"
    waves = [
        [(1, "a", day(1), 4, 10), (1, "b\nc", day(2), 4, 10), (1, None, day(3), 1, 10), (2, "a", day(1), 5, None)],
        [(1, "a", day(4), 4, 10), (1, "b", day(5), 1, 10), (1, None, day(5), 1, 10), (2, "x", day(2), 5, None)],
        [(1, "b\nc", day(6), 1, 10), (1, "d", day(7), 1, 10), (2, "x", day(8), 0, None), (2, "y", day(9), 0, None)],
    ]
    draws = spark.createDataFrame([r for w in waves for r in w], schema).coalesce(1)
    told = sync.stateful_draws(draws, old_receipts=spark.createDataFrame([(2, day(2))], "entitlement_id long, created_at timestamp"))
    got = sorted((r["entitlement_id"], str(r["client_id"]), r["status"], r["remaining"] if r["remaining"] is not None else -1) for r in told.collect())
    assert got == sorted([
        (1, "a", "applied", 6), (1, "b\nc", "applied", 2), (1, "None", "applied", 1), (2, "a", "applied", -1),
        (1, "a", "skipped", 1), (1, "b", "applied", 0), (1, "None", "rejected", 0), (2, "x", "skipped", -1),
        (1, "b\nc", "skipped", 0), (1, "d", "rejected", 0), (2, "x", "skipped", -1), (2, "y", "rejected", -1),
    ])


def test_receipts_and_balances_last_over_batches(spark):
    """The same client ids in every file: one counts, whichever batch comes first."""
    schema = "entitlement_id long, client_id string, created_at timestamp, amount long, start_units long"
    rows = [(k, f"c{i}", datetime(2024, 1, 1) + timedelta(hours=i), 1, 30) for _ in range(3) for k in range(4) for i in range(20)]
    told = sync.stateful_draws(spark.createDataFrame(rows, schema).repartition(3), 1)
    counts = {(r["entitlement_id"], r["status"]): r["count"] for r in told.groupBy("entitlement_id", "status").count().collect()}
    assert counts == {(k, s): n for k in range(4) for s, n in (("applied", 20), ("skipped", 40))}
    assert {r["m"] for r in told.groupBy("entitlement_id").agg(F.min("remaining").alias("m")).collect()} == {10}
