"""The batch run: collect, extract, validate, load and archive as Spark stages."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import records
from ledgerloom.sources import files, sinks
from ledgerloom.sources.shared import Store, written

#: The stages and those before each.
STAGES = ("collect", "extract", "validate", "load", "archive")
NEEDS = {
    "collect": (), "extract": ("collect",), "validate": ("collect", "extract"),
    "load": ("collect", "extract", "validate"), "archive": ("collect",),
}


def stages_to_run(stage: str | None) -> tuple[str, ...]:
    """All stages, or one behind those that it needs."""
    return STAGES if stage is None else (*NEEDS[stage], stage)


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    first_delay: float = 0.5
    factor: float = 2.0
    longest: float = 30.0

    def delay(self, attempt: int) -> float:
        return min(self.longest, self.first_delay * self.factor ** (attempt - 1))

    def call(self, f: Callable, sleep: Callable[[float], None] = time.sleep, on: tuple = (OSError,)):
        for attempt in range(1, self.attempts + 1):
            try:
                return f()
            except on:
                if attempt == self.attempts:
                    raise
                sleep(self.delay(attempt))

    def tried(self, f: Callable, sleep: Callable[[float], None] = time.sleep) -> tuple[object, str | None, int]:
        """(result, error, attempts): what fails to the end is told, not raised."""
        for attempt in range(1, self.attempts + 1):
            try:
                return f(), None, attempt
            except Exception as e:  # noqa: BLE001 - one call's failure is a row of the result
                error = f"{type(e).__name__}: {e}"[:500]
                if attempt < self.attempts:
                    sleep(self.delay(attempt))
        return None, error, self.attempts


@dataclass
class Providers:
    """Model clients by name: a factory makes one inside the task that uses it."""

    factories: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, factory: Callable) -> None:
        self.factories[name] = factory

    def unregister(self, name: str) -> None:
        self.factories.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self.factories)

    def generate(self, name: str, requests: DataFrame, retry: Retry = Retry()) -> DataFrame:
        """path, content, error, attempts of requests (path, ...) through the named client.

        One call a row, in tasks, each retried by itself; a call that fails to the end is
        a row with its error and no content, and the others go on.  A client that can't be
        made fails the calls that need it.  Write the result before reading it twice.
        """
        if name not in self.factories:
            raise KeyError(f"no provider {name!r}; known: {', '.join(self.names())}")
        factory = self.factories[name]

        def answer(batches):
            clients = []

            def call(request):
                if not clients:
                    clients.append(factory())
                return clients[0](request)

            for pdf in batches:
                told = [retry.tried(lambda r=r: call(r)) for r in pdf.to_dict("records")]
                names = ("content", "error", "attempts")
                yield pdf[["path"]].assign(**{n: [t[k] for t in told] for k, n in enumerate(names)})

        return requests.mapInPandas(answer, "path string, content string, error string, attempts int")


class BatchFailed(RuntimeError):
    """A batch job that ended in another state than success, or not in time."""


#: States in which a batch job ends.
SUCCEEDED = "Completed"
FAILED = ("Failed", "Stopped", "Expired")


def await_job(poll: Callable[[], str], interval: float = 30.0, longest: float = 86400.0, sleep: Callable[[float], None] = time.sleep) -> None:
    """Ask for a job's state until it ends; any end but success is an error."""
    waited = 0.0
    while (state := poll()) != SUCCEEDED:
        if state in FAILED:
            raise BatchFailed(f"the job ended as {state}")
        if waited >= longest:
            raise BatchFailed(f"the job has not ended within {longest} s; its last state is {state}")
        sleep(interval)
        waited += interval


def generate_in_batch(
    requests: DataFrame, folder: str, submit: Callable[[str, str], Callable[[], str]], system: str = "",
    one_by_one: Callable[[DataFrame], DataFrame] | None = None, **waiting,
) -> DataFrame:
    """Answers (path, content) of a batch service to requests (path, media_type, data).

    The requests are written as JSON lines, ``submit(input, output)`` starts the job and
    returns what tells its state, and the output's lines meet the requests by id; a request
    without an answer has null content.  ``one_by_one`` (as ``Providers.generate``) is
    asked for these by themselves, and its errors come with them.
    """
    sinks.write_batch_input(requests, f"{folder}/input", system)
    await_job(submit(f"{folder}/input", f"{folder}/output"), **waiting)
    told = answers_by_path(requests, files.read_batch_output(requests.sparkSession, f"{folder}/output/*"))
    if one_by_one is None:
        return told
    left = requests.join(told.where("content is null").select("path"), "path", "left_semi")
    answered = told.where("content is not null")
    return answered.unionByName(one_by_one(left).select("path", "content", "error"), allowMissingColumns=True)


def answers_by_path(requests: DataFrame, outputs: DataFrame) -> DataFrame:
    """(path, content) of every request; null where no output has its id."""
    key, said = outputs.columns[:2]
    told = outputs.groupBy(F.col(key).alias("path")).agg(F.min(said).alias("content"))
    return requests.select("path").join(told, "path", "left")


class ConfigError(ValueError):
    """A configuration that is missing, malformed or out of range."""


@dataclass(frozen=True)
class Settings:
    source: str
    state: str
    provider: str = "stub"
    reference_date: str = "2024-01-01"
    threshold: float = 0.7
    #: The amounts in cents that the price list has.
    known_cents: tuple[int, ...] = (1000, 3000, 5000, 35000, 25000)
    retry: Retry = Retry()
    #: Who is written down as the one that loads.
    user: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ConfigError("threshold must lie in [0, 1]")
        try:
            date.fromisoformat(self.reference_date)
        except ValueError as e:
            raise ConfigError(f"reference date {self.reference_date!r} is not YYYY-MM-DD") from e


#: Names in the configuration file and in the environment.
CONFIG_NAMES = {"provider": ("llm_provider", "LLM_PROVIDER"), "threshold": ("confidence_threshold", "CONFIDENCE_THRESHOLD")}


def load_settings(source: str, state: str, path: str | None = None, env: Mapping[str, str] | None = None, **given) -> Settings:
    """Settings from a file (JSON, or YAML where a reader for it is installed), overlaid
    by the environment's filled variables, then by what the caller gives."""
    env = os.environ if env is None else env
    values = {}
    told = _read_config(path) if path else {}
    for name, (own, variable) in CONFIG_NAMES.items():
        if env.get(variable):
            values[name] = env[variable]
        elif told.get(own) is not None:
            values[name] = told[own]
    values |= {k: v for k, v in given.items() if v is not None}
    if "provider" in values:
        values["provider"] = str(values["provider"]).lower()
    if "threshold" in values:
        try:
            values["threshold"] = float(values["threshold"])
        except (TypeError, ValueError) as e:
            raise ConfigError(f"confidence_threshold {values['threshold']!r} is no number") from e
    return Settings(source, state, **values)


def _read_config(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            content = f.read()
    except OSError as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    try:
        if path.endswith(".json"):
            told = json.loads(content)
        else:
            try:
                import yaml
            except ImportError as e:
                raise ConfigError("no reader for YAML is installed; give a .json file") from e
            try:
                told = yaml.safe_load(content)
            except yaml.YAMLError as e:
                raise ConfigError(f"{path} is malformed: {e}") from e
    except json.JSONDecodeError as e:
        raise ConfigError(f"{path} is malformed: {e}") from e
    if not isinstance(told or {}, dict):
        raise ConfigError(f"{path} must hold a mapping")
    return told or {}


def run_batch(
    spark: SparkSession,
    settings: Settings,
    providers: Providers,
    players: DataFrame,
    stage: str | None = None,
    run_id: str = "run-1",
    *,
    schools: DataFrame | None = None,
    products: DataFrame | None = None,
    answers: DataFrame | None = None,
    resume: bool = False,
) -> dict[str, DataFrame]:
    """Tables of the stages that ran, by name; files land below ``settings.state``.

    ``players`` has id, first_name, last_name; ``schools`` and ``products`` have id
    and name.  ``answers`` (path, content) stands for the provider's, where a batch
    service has written them.  The manifest says what was done: a resumed run goes
    on with the files that it lacks, and keeps what was extracted of the others.  A file
    that can't be read, or whose call fails to the end, is told in the manifest and in
    the table ``failures`` and asked again on resume; the run goes on without it.
    Nothing is collected but the summary, which the caller may ask for.
    """
    base = f"{settings.state}/{run_id}"
    manifest = sinks.Manifest(spark, f"{base}/manifest", run_id)
    if resume and not manifest.exists():
        raise FileNotFoundError(f"no manifest of run {run_id!r} below {settings.state}")
    out: dict[str, DataFrame] = {}
    nobody = spark.createDataFrame([], "id long, name string")
    known = (schools if schools is not None else nobody, products if products is not None else nobody)
    doing = {
        "collect": lambda: _collect(spark, settings, manifest),
        "extract": lambda: _extract(spark, settings, providers, answers, out["collect"], base, manifest, resume),
        "validate": lambda: _validate(spark, settings, out["extract"], players, run_id, base, manifest),
        "load": lambda: _load(spark, settings, out["validate"], players, known, base, manifest),
        "archive": lambda: _archive(spark, settings, out["collect"], base, manifest),
    }
    for name in stages_to_run(stage):
        manifest.start_stage(name)
        try:
            out |= doing[name]()
        except Exception as e:
            manifest.fail_stage(name, f"{type(e).__name__}: {e}"[:500])
            raise
        manifest.complete_stage(name)
    return out


def _collect(spark: SparkSession, settings: Settings, manifest: sinks.Manifest) -> dict[str, DataFrame]:
    routed = files.route_files(files.list_files(spark, settings.source))
    taken = F.col("handler").isNotNull()
    told = routed.select(F.col("path").alias("target"), F.when(taken, "done").otherwise("skipped").alias("status"), F.col("skip_reason").alias("reason"))
    manifest.mark("collect", "file", told)
    absent = files.absent_folders(routed)
    manifest.mark("collect", "skip", absent.select(F.col("subfolder").alias("target"), F.lit("skipped").alias("status"), F.lit("subfolder absent").alias("reason")))
    return {"collect": routed}


def _done(rows: DataFrame, path: str) -> DataFrame:
    return rows.select(F.col(path).alias("target"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("reason")).distinct()


def _marked(paths: DataFrame, failures: DataFrame) -> DataFrame:
    """target, status and reason of every path: failed, or done."""
    wrong = failures.groupBy("path").agg(F.min("reason").alias("reason"))
    status = F.when(F.col("reason").isNotNull(), "failed").otherwise("done")
    return paths.distinct().join(wrong, "path", "left").select(F.col("path").alias("target"), status.alias("status"), "reason")


def _extract(spark, settings, providers, answers, routed, base, manifest, resume) -> dict[str, DataFrame]:
    folder = f"{base}/extract"
    kept = routed.where("handler is not null").select("path")
    if resume:
        before = sinks.stored(spark, folder, EXTRACTED).select(F.col("source_file").alias("path")).distinct()
        kept = sinks.remaining_files(kept, manifest.state(), "extract").join(before, "path", "left_anti")
        kept.write.mode("overwrite").parquet(f"{base}/extract-todo")
        kept = spark.read.parquet(f"{base}/extract-todo")
    images = files.image_requests(spark, settings.source).join(kept, "path", "left_semi")
    if answers is None:
        # written once: the calls cost, and their outcome is read for records and for failures
        said = written(providers.generate(settings.provider, images, settings.retry), "answers")
    else:
        unanswered = F.when(F.col("content").isNull(), "no answer")
        said = written(answers_by_path(images, answers).withColumn("error", unanswered), "answers")
    parsed = records.explode_model_output(said.where("error is null").select("path", "content"))
    from_images = parsed.select(
        text.record_id(F.col("path"), F.coalesce("target_table", F.lit("")), F.col("pos")).alias("record_id"),
        "target_table", "payload", F.col("confidence").alias("confidence_score"), F.col("path").alias("source_file"),
        F.lit(settings.provider).alias("provider"),
    )
    items = written(files.read_docx(spark, settings.source).join(kept.select(F.col("path").alias("source_file")), "source_file", "left_semi"), "documents")
    failed = lambda why, error: F.concat(F.lit(f"{why}: "), error).alias("reason")
    unread = items.where("kind = 'unreadable'").select(F.col("source_file").alias("path"), failed("docx parse error", F.col("text")))
    failures = said.where("error is not null").select("path", failed("extract_failed", F.col("error"))).unionByName(unread)
    lines = files.docx_lines(items)
    as_map = lambda *c: F.map_from_arrays(F.array(*[F.lit(x) for x in c]), F.array(*[F.col(x).cast("string") for x in c]))

    def parsed_rows(rows: DataFrame, table: str, part: str, index: str, *columns: str) -> DataFrame:
        return rows.select(
            text.record_id(F.col("source_file"), F.lit(part), F.col(index)).alias("record_id"), F.lit(table).alias("target_table"),
            as_map(*columns).alias("payload"), F.lit(1.0).alias("confidence_score"), "source_file", F.lit("docx-parser").alias("provider"),
        )

    metric = ("player_name", "metric_type", "value")
    extracted = (
        from_images.unionByName(parsed_rows(records.lesson_blocks(lines), "lessons", "lessons", "block", "title", "topic", "phenomenon", "content"))
        .unionByName(parsed_rows(records.metric_lines(lines), "student_metrics", "student_metrics", "index", *metric))
        .unionByName(parsed_rows(records.table_metrics(files.docx_tables(items)), "student_metrics", "metric_tables", "cell", *metric))
    )
    extracted.write.mode("append" if resume else "overwrite").parquet(folder)
    manifest.mark("extract", "file", _marked(kept, failures))
    manifest.mark("extract", "failure", failures.select(F.col("path").alias("target"), F.lit("failed").alias("status"), "reason"))
    whole = spark.read.schema(EXTRACTED).parquet(folder)
    sinks.write_record_csvs(whole, f"{base}/csv")
    return {"extract": whole, "failures": failures}


EXTRACTED = (
    "record_id string, target_table string, payload map<string,string>, confidence_score double, source_file string, provider string"
)


def _validate(spark, settings, extracted, players, run_id, base, manifest) -> dict[str, DataFrame]:
    names = _stored_players(spark, players, settings.state).select(text.slug(F.concat_ws(" ", "first_name", "last_name")).alias("slug"))
    day = F.lit(settings.reference_date).cast("date")
    checked = records.validate(extracted, names, _cents(settings), day, settings.threshold)
    checked.write.mode("overwrite").parquet(f"{base}/validate")
    checked = spark.read.parquet(f"{base}/validate")
    sinks.write_review(checked, run_id, base)
    manifest.mark("validate", "record", checked.select(F.col("record_id").alias("target"), "status", F.array_join("reasons", ";").alias("reason")))
    return {"validate": checked}


def _cents(settings: Settings):
    return F.array(*[F.lit(c).cast("long") for c in settings.known_cents])


def _archive(spark, settings, routed, base, manifest) -> dict[str, DataFrame]:
    taken = routed.where("handler is not null").select("path")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(settings.source)
    content = content.select("path", "content").join(taken, "path", "left_semi")
    archive = sinks.Archive(spark, f"{settings.state}/archive")
    archive.plan(content).write.mode("overwrite").parquet(f"{base}/archive-plan")
    plan = spark.read.parquet(f"{base}/archive-plan")
    archive.upload(plan, content)
    manifest.mark("archive", "file", _done(plan, "path"))
    return {"archive": plan}


#: The load tables' rows of all runs.
LOADED = "natural_key string, record_id string, target_table string, player_id long"


CONSENTS = "record_id string, player_id long, consent_type string, granted boolean, granted_at string, method string"


AUDITED = ("inserted", "merged", "appended", "duplicate")


def _load(spark, settings, validated, players, references, base, manifest) -> dict[str, DataFrame]:
    """Load the clean records against what earlier runs have stored below the state folder.

    Players come first, so that the batch's own names resolve; ``players`` seeds the
    first run.  Rows inserted, consents appended (a record that their ledger holds is a
    duplicate), the players and an audit row for each outcome are one commit: later runs
    see all of it or nothing.
    """
    store = Store(spark, settings.state)
    clean = records.privacy_filter(validated.where("status = 'clean'").drop("reasons", "status"))
    people, told = records.load_players(clean.where("target_table = 'players'"), _stored_players(spark, players, settings.state))
    people, told = written(people, "load-players"), written(told, "load-told")
    key = F.lit(None).cast("string")
    for table in text.LOAD_KEY_FIELDS:
        own = text.load_key(table, lambda f: records.field(F.col("payload"), f), F.col("source_file"))
        key = F.when(F.col("target_table") == table, own).otherwise(key)
    index = records.name_index(people)
    schools, products = (records.reference_index(r) for r in references)
    rest = clean.where(~F.col("target_table").isin("players", "consents"))
    keyed = written(records.resolve_references(rest, index, schools, products, _cents(settings)).withColumn("natural_key", key), "load-keyed")
    done = records.insert_if_absent(keyed.where("load_reason is null"), "natural_key", ["record_id"], store.table("loaded", LOADED))
    flagged = keyed.where("load_reason is not null").withColumn("disposition", F.col("load_reason"))
    consents = written(records.consent_outcomes(clean, index), "load-consents")
    given = records.insert_if_absent(consents.where("reason is null"), "record_id", ["record_id"], store.table("consents", CONSENTS))
    given = given.withColumn("disposition", F.when(F.col("disposition") == "inserted", "appended").otherwise(F.col("disposition")))
    refused = consents.where("reason is not null").withColumn("disposition", F.col("reason"))
    result = done.unionByName(flagged)
    for more in (told, given, refused):
        result = result.unionByName(more, allowMissingColumns=True)
    result.write.mode("overwrite").parquet(f"{base}/load")
    result = spark.read.parquet(f"{base}/load")
    new = result.where("disposition = 'inserted' and target_table <> 'players'")
    appended = result.where("disposition = 'appended'")
    audited = result.where(F.col("disposition").isin(*AUDITED))
    nobody = F.lit(None).cast("string")
    tables = {
        "loaded": new.select("natural_key", "record_id", "target_table", F.col("player_id").cast("long")),
        "consents": appended.select("record_id", F.col("player_id").cast("long"), "consent_type", "granted", "granted_at", "method"),
        "players": people,
        "audit": sinks.audit_rows(audited, F.col("target_table"), "record_id", nobody, F.lit(settings.user), F.current_timestamp()),
    }
    store.commit(tables, f"{manifest.run_id}:{manifest.number()}", whole=("players",))
    at = F.when(F.col("disposition").isin("inserted", "merged", "appended"), "loaded").when(F.col("disposition") == "duplicate", "skipped").otherwise("flagged")
    marks = result.select(F.col("record_id").alias("target"), at.alias("status"), F.col("disposition").alias("reason"))
    manifest.mark("load", "record", marks)
    manifest.mark("load", "skip", marks.where("status <> 'loaded'").withColumn("status", F.lit("skipped")))
    return {"load": result, "players": spark.read.parquet(*store.parts("players"))}


def _stored_players(spark: SparkSession, players: DataFrame, state: str) -> DataFrame:
    """The players of the last commit, or the seed."""
    parts = Store(spark, state).parts("players")
    return spark.read.parquet(*parts) if parts else players


def summary(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Counters of a run: one aggregate per table."""
    counts = {}
    if "collect" in tables:
        counts["collected"] = tables["collect"].where("handler is not null").count()
    if "extract" in tables:
        counts["extracted"] = tables["extract"].count()
        if failed := tables["failures"].select("path").distinct().count():
            counts["failed"] = failed
    if "validate" in tables:
        counts["flagged"] = tables["validate"].where("status = 'flagged'").count()
    if "load" in tables:
        for row in tables["load"].groupBy("disposition").count().collect():
            counts[row["disposition"]] = row["count"]
    if "archive" in tables:
        counts["archived"] = tables["archive"].where("action = 'uploaded'").count()
    return counts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom", description="Run the batch stages over a source folder.")
    p.add_argument("--source-folder", required=True)
    p.add_argument("--state-dir", required=True)
    p.add_argument("--config", help="JSON or YAML; the environment goes before it")
    p.add_argument("--stage", choices=STAGES)
    p.add_argument("--run-id", default="run-1")
    p.add_argument("--resume", metavar="RUN_ID", help="go on with an earlier run")
    p.add_argument("--reference-date")
    p.add_argument("--answers", help="JSON lines of a batch service, a path or pattern")
    for name in ("players", "schools", "products"):
        p.add_argument(f"--{name}", help="a Parquet table")
    return p


def main(argv: list[str] | None = None) -> int:
    """0 when the run is done, 1 when it halts, 2 when it is not configured."""
    args = parser().parse_args(argv)
    try:
        settings = load_settings(args.source_folder, args.state_dir, args.config, reference_date=args.reference_date)
    except ConfigError as e:
        print(f"Configuration error: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    read = lambda path: spark.read.parquet(path) if path else None
    people = read(args.players)
    if people is None:
        people = spark.createDataFrame([], "id long, first_name string, last_name string")
    said = files.read_batch_output(spark, args.answers) if args.answers else None
    providers = Providers({settings.provider: lambda: lambda request: '{"records": []}'})
    try:
        tables = run_batch(
            spark, settings, providers, people, args.stage, args.resume or args.run_id,
            schools=read(args.schools), products=read(args.products), answers=said, resume=args.resume is not None,
        )
        counts = summary(tables)
    except Exception as e:  # noqa: BLE001 - the command's exit code says it
        print(f"Run halted: {e}", file=sys.stderr)
        return 1
    for name, count in counts.items():
        print(f"{name}: {count}")
    return 0
