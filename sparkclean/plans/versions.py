"""Immutable versions of a cleaned table, verification, rollback and gated export."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID, Inverse, schema_of
from sparkclean.operators.catalogue import apply_inverse, get_op
from sparkclean.operators.checks import Check, CheckResult, generate_checks, run_checks
from sparkclean.operators.guards import neutralise_formulas
from sparkclean.operators.identity import content_hash, fingerprint, row_hash
from sparkclean.operators.profile import TableProfile
from sparkclean.operators.reconcile import Reconciliation, reconcile
from sparkclean.operators.tree import HashTree, frame_difference
from sparkclean.plans.plan import Plan

# --- fixed values -----------------------------------------------------------------------
MIN_REASON_CHARS = 10
# ------------------------------------------------------------------------------------------
VERSION_SCHEMA = (
    "plan_id string, version_no int, step_no int, path string, children map<string,string>, "
    "inverse string, row_count bigint, hash_xor bigint, hash_sum decimal(38,0), "
    "child_marks map<string,string>, note string, created_at timestamp_ntz"
)
Mark = tuple[int, int, int]  # rows, xor and sum of the row hashes
RUN_SCHEMA = "id string, version_no int, name string, phase string, result string, detail string, run_at timestamp_ntz"


class ExportBlocked(Exception):
    """Checks or reconciliation of the current version did not all pass."""


@dataclass
class Verification:
    before: list[CheckResult]
    after: list[CheckResult]
    reconciliation: list[Reconciliation] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        """At least one check and one reconciliation, and all of them good."""
        return (
            bool(self.after)
            and all(r.passed for r in self.after)
            and bool(self.reconciliation)
            and all(r.ok for r in self.reconciliation)
        )


class VersionStore:
    """Versions of one plan below ``root``.

    A version is a directory that is written once; rolling back adds a record that points
    at the same directory, so identity needs no copy. Child tables that a step did not
    produce again are carried forward as pointers.
    """

    def __init__(self, spark: SparkSession, root: str, plan_id: str = "plan"):
        self.spark, self.root, self.plan_id = spark, root.rstrip("/"), plan_id
        for path, schema in ((self._log, VERSION_SCHEMA), (self._runs, RUN_SCHEMA)):
            spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(path)

    # --- records ----------------------------------------------------------------------
    @property
    def _log(self) -> str:
        return f"{self.root}/_versions"

    @property
    def _runs(self) -> str:
        return f"{self.root}/_runs"

    def records(self) -> DataFrame:
        return self.spark.read.schema(VERSION_SCHEMA).parquet(self._log).where(F.col("plan_id") == self.plan_id)

    def record(self, number: int):
        row = self.records().where(F.col("version_no") == number).first()
        if row is None:
            raise ValueError(f"version {number} does not exist")
        return row

    def current(self) -> int | None:
        return self.records().agg(F.max("version_no")).first()[0]

    def _add(self, number, step, path, mark: Mark, children: dict, marks: dict, inverse: Inverse | None, note) -> None:
        n, x, s = mark
        inv = json.dumps({"op": inverse.op, "parameters": inverse.parameters}) if inverse else None
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = [(self.plan_id, number, step, path, children, inv, n, x, Decimal(s), marks, note, now)]
        self.spark.createDataFrame(row, VERSION_SCHEMA).coalesce(1).write.mode("append").parquet(self._log)
        saved = self.file_marks([path, *children.values()])
        saved.write.mode("overwrite").parquet(f"{self.root}/_files/v{number}")

    # --- content ------------------------------------------------------------------------
    def read(self, number: int | None = None) -> DataFrame:
        number = self.current() if number is None else number
        return self.spark.read.parquet(self.record(number)["path"])

    def read_children(self, number: int | None = None) -> dict[str, DataFrame]:
        number = self.current() if number is None else number
        return {n: self.spark.read.parquet(p) for n, p in (self.record(number)["children"] or {}).items()}

    def tree(self, number: int) -> HashTree:
        """The hash tree of a version's table, built when it is first asked for and stored beside it."""
        path, built = f"{self.root}/_tree/v{number}", f"{self.root}/_trees"
        self.spark.createDataFrame([], "version_no int").coalesce(1).write.mode("ignore").parquet(built)
        if self.spark.read.schema("version_no int").parquet(built).where(F.col("version_no") == number).isEmpty():
            HashTree.build(self.read(number), path)
            self.spark.createDataFrame([(number,)], "version_no int").coalesce(1).write.mode("append").parquet(built)
        return HashTree(self.spark, path)

    def difference(self, a: int, b: int) -> DataFrame:
        """(_rid, kind) of the rows in which two versions differ: added, gone or changed in the second."""
        return frame_difference(self.read(a), self.read(b), self.tree(a), self.tree(b))

    def same_rows(self, a: int, b: int) -> bool:
        """Two versions hold the same rows with the same ids: only the roots are compared."""
        return self.read(a).schema == self.read(b).schema and self.tree(a).root() == self.tree(b).root()

    def _listing(self, paths: list[str]) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths)
        return files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.col("length").alias("bytes"))

    def file_marks(self, paths: list[str]) -> DataFrame:
        """(file, bytes, rows and row hashes): one rule for files of any size, computed where the rows are read."""
        marks = None
        for path in paths:
            df = self.spark.read.parquet(path)
            file = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_file")
            hashed = df.select(file, row_hash(df).alias("_h")).groupBy("_file").agg(
                F.count("*").alias("n"), F.bit_xor("_h").alias("x"), F.sum(F.col("_h").cast("decimal(28,0)")).alias("s")
            )
            marks = hashed if marks is None else marks.unionByName(hashed)
        return self._listing(paths).join(marks, F.col("path") == F.col("_file"), "left").drop("_file")

    def verify_files(self, number: int) -> bool:
        """The files of a version, child tables included, have the lengths and rows that were written."""
        row = self.record(number)
        paths = [row["path"], *(row["children"] or {}).values()]
        saved = self.spark.read.parquet(f"{self.root}/_files/v{number}")

        def same(a: DataFrame, b: DataFrame) -> bool:
            tagged = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
            return tagged.groupBy(*a.columns).agg(F.sum("side").alias("d")).where("d <> 0").isEmpty()

        if not same(saved.select("path", "bytes"), self._listing(paths)):
            return False
        try:
            return same(saved, self.file_marks(paths))
        except PySparkException:  # a file that cannot be read is not the one that was written
            return False

    # --- execution ----------------------------------------------------------------------
    def _write(self, df: DataFrame, name: str) -> tuple[str, Mark]:
        """Write a table; its fingerprint is observed on the way, without another pass."""
        path, seen = f"{self.root}/{name}", Observation("fingerprint")
        # a crashed earlier attempt may have left an unregistered directory
        df.observe(seen, *fingerprint(df)).write.mode("overwrite").parquet(path)
        got = seen.get
        return path, (int(got["n"]), int(got["x"]), int(got["s"]))

    def _write_children(self, tables: dict[str, DataFrame], step: int) -> tuple[dict[str, str], dict[str, str]]:
        """Paths and marks of child tables."""
        done = {n: self._write(c, f"v{step}__{n}") for n, c in tables.items()}
        return {n: path for n, (path, _) in done.items()}, {n: json.dumps(mark) for n, (_, mark) in done.items()}

    def execute(self, plan: Plan, df: DataFrame, every_step: bool = False) -> int:
        """Write version 0 (the table as it came) and the result of the decided steps.

        By default the steps stay one lazy chain and only the final table is written, so
        Catalyst fuses them; ``every_step`` writes a version and an inverse per step.
        Running again after completion changes nothing.
        """
        if plan.status != "approved":
            raise ValueError("plan is not approved")
        steps = plan.decided()
        last = steps[-1].step_no if steps else 0
        done = self.current()
        if done is not None and done >= last:
            return done
        if done is None:
            self._add(0, 0, *self._write(df, "v0"), {}, {}, None, "source")
            done = 0
        if every_step:
            return self._execute_each(steps, done)
        main, children = plan.run(self.read(0))
        paths, marks = self._write_children(children, last)
        if last:
            self._add(last, last, *self._write(main, f"v{last}"), paths, marks, None, "final")
        return last

    def _execute_each(self, steps, done: int) -> int:
        frame = self.read(done)
        before = self.record(done)
        children, marks = dict(before["children"] or {}), dict(before["child_marks"] or {})
        for s in steps:
            if s.step_no <= done:
                continue
            op = get_op(s.operation)
            op.validate(s.parameters, schema_of(frame))
            paths, new = self._write_children(op.child_tables(frame, s.parameters), s.step_no)
            children, marks = children | paths, marks | new
            path, mark = self._write(op.apply(frame, s.parameters), f"v{s.step_no}")
            after = self.spark.read.parquet(path)
            inverse = op.inverse(frame, after, s.parameters)
            if inverse.delta is not None:
                self._write(inverse.delta, f"_inverse/v{s.step_no}")
            self._add(s.step_no, s.step_no, path, mark, children, marks, inverse, s.operation)
            frame, done = after, s.step_no
        return done

    def undo_step(self, number: int) -> DataFrame:
        """The frame before the step, rebuilt from the version and its inverse."""
        saved = json.loads(self.record(number)["inverse"])
        derived = saved["op"] == "drop_columns"  # the only inverse without a delta
        delta = None if derived else self.spark.read.parquet(f"{self.root}/_inverse/v{number}")
        return apply_inverse(self.read(number), Inverse(saved["op"], saved["parameters"], delta))

    def rollback(self, number: int, reason: str) -> int:
        """A new version with the content of an old one, after its files were verified."""
        if len(reason.strip()) < MIN_REASON_CHARS:
            raise ValueError(f"reason must have at least {MIN_REASON_CHARS} characters")
        row = self.record(number)
        if not self.verify_files(number):
            raise ValueError(f"files of version {number} were changed after they were written")
        new = self.current() + 1
        mark = (row["row_count"], row["hash_xor"], row["hash_sum"])
        if content_hash(self.spark.read.parquet(row["path"])) != mark:
            raise ValueError(f"content of version {number} differs from what was recorded")
        marks = dict(row["child_marks"] or {})
        for name, child in self.read_children(number).items():
            if list(content_hash(child)) != json.loads(marks[name]):
                raise ValueError(f"child table {name} of version {number} differs from what was recorded")
        note = f"rollback to {number}: {reason}"
        self._add(new, row["step_no"], row["path"], mark, dict(row["children"] or {}), marks, None, note)
        return new

    # --- verification and export ----------------------------------------------------------
    def verify(self, plan: Plan, profile: TableProfile, number: int | None = None) -> Verification:
        number = self.current() if number is None else number
        steps = plan.executed_steps()
        checks: list[Check] = generate_checks(steps, profile)
        before, after, children = self.read(0), self.read(number), self.read_children(number)
        result = Verification(
            run_checks(checks, before), run_checks(checks, after, children), reconcile(before, after, children, steps)
        )
        self._save_runs(number, result)
        return result

    def _save_runs(self, number: int, v: Verification) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        rows = [
            (f"{now:%Y%m%d%H%M%S%f}-{i:05d}-{phase}", number, name, phase, "passed" if ok else "failed", detail, now)
            for phase, items in (
                ("before", [(r.name, r.passed, r.detail) for r in v.before]),
                ("after", [(r.name, r.passed, r.detail) for r in v.after]),
                ("reconcile", [(r.check_name, r.ok, f"{r.source_value} / {r.output_value}") for r in v.reconciliation]),
            )
            for i, (name, ok, detail) in enumerate(items)
        ]
        if rows:
            self.spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(self._runs)

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(self._runs)

    def gate_open(self, number: int | None = None) -> bool:
        """Latest "after" run of every check and every reconciliation of this version passed."""
        number = self.current() if number is None else number
        runs = self.runs().where(F.col("version_no") == number)
        decisive = runs.where("phase <> 'before'").groupBy("phase", "name").agg(
            F.max_by("result", F.struct("run_at", "id")).alias("result")
        )
        r = decisive.agg(
            F.count_if(F.col("phase") == "after").alias("checks"),
            F.count_if(F.col("phase") == "reconcile").alias("recs"),
            F.coalesce(F.bool_and(F.col("result") == "passed"), F.lit(False)).alias("ok"),
        ).first()
        return bool(r["checks"] and r["recs"] and r["ok"])

    def export(self, path: str, fmt: str = "csv", table: str | None = None, plan: Plan | None = None) -> DataFrame:
        """One directory per table behind the gate; returns the manifest (table, path, rows).

        ``csv`` and ``parquet`` write the tables with formulas made inert, ``pipeline`` the
        executed steps as JSON.
        """
        if fmt not in ("csv", "parquet", "pipeline"):
            raise ValueError("format must be csv, parquet or pipeline")
        number = self.current()
        if not number:
            raise ValueError("no executed version")
        if not self.gate_open(number):
            raise ExportBlocked(f"checks or reconciliation of version {number} did not pass")
        if fmt == "pipeline":
            if plan is None:
                raise ValueError("the pipeline format needs the plan")
            target = f"{path}/pipeline"
            self.spark.createDataFrame([(plan.to_json(),)], "value string").coalesce(1).write.text(target)
            return self.spark.createDataFrame([("pipeline", target, 1)], "table string, path string, rows bigint")
        tables = {"main": self.read(number).drop(ROW_ID), **self.read_children(number)}
        if table is not None:
            if table not in tables:
                raise ValueError(f"table '{table}' not found")
            tables = {table: tables[table]}
        manifest = []
        for name, df in tables.items():
            target = f"{path}/{name}"
            writer = neutralise_formulas(df).write
            if fmt == "csv":
                writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(target)
            else:
                writer.parquet(target)
            manifest.append((name, target, df.count()))
        out = self.spark.createDataFrame(manifest, "table string, path string, rows bigint")
        out.coalesce(1).write.json(f"{path}/_manifest")
        return out
