"""A plan on a source that changed: only what the change touches is computed again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID, data_columns, q, schema_of
from sparkclean.operators.catalogue import get_op
from sparkclean.operators.identity import row_hash
from sparkclean.operators.tree import frame_difference
from sparkclean.plans.plan import Plan, Step
from sparkclean.plans.versions import VersionStore
from sparkclean.session import scratch_dir

SOURCE, RESULTS = "source", ("final", "incremental")


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _apply(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Steps that work on each row by itself."""
    for s in steps:
        op = get_op(s.operation)
        op.validate(s.parameters, schema_of(df))
        df = op.apply(df, s.parameters)
    return df


def _with_keys(rows: DataFrame, keys: list[str], touched: DataFrame) -> DataFrame:
    """Rows whose key columns, nulls included, are among ``touched`` (columns k0, k1, ...; their hash)."""
    same = [rows["_hash"] == touched["_hash"], *[q(c).eqNullSafe(touched[f"k{i}"]) for i, c in enumerate(keys)]]
    return rows.join(touched, reduce(lambda x, y: x & y, same), "left_semi").drop("_hash")


def _hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("_hash", row_hash(rows.select(*[q(c) for c in keys])))


def _main(plan_steps: list[Step], old: DataFrame, new: DataFrame, result: DataFrame, changes: DataFrame) -> DataFrame:
    """The result table: rows that nothing touched from ``result``, the others computed again."""
    here = changes.where("kind <> 'gone'").select(ROW_ID)
    at = next((i for i, s in enumerate(plan_steps) if s.operation == "deduplicate"), None)
    if at is None:
        fresh = _apply(new.join(here, ROW_ID, "left_semi"), plan_steps)
        return result.join(changes.select(ROW_ID), ROW_ID, "left_anti").unionByName(fresh)
    first, step, rest = plan_steps[:at], plan_steps[at], plan_steps[at + 1 :]
    there = changes.where("kind <> 'added'").select(ROW_ID)
    before, after = (_apply(d.join(ids, ROW_ID, "left_semi"), first) for d, ids in ((old, there), (new, here)))
    keys = step.parameters.get("subset") or data_columns(before)
    named = [q(c).alias(f"k{i}") for i, c in enumerate(keys)]
    touched = _hashed(before, keys).select("_hash", *named).unionByName(_hashed(after, keys).select("_hash", *named)).distinct()
    # a key that gains or loses a row is decided again, on all its rows
    pool = _kept(_with_keys(_hashed(_apply(new, first), keys), keys, _kept(touched, "touched")), "pool")
    fresh = _apply(pool, [step, *rest])
    decided = pool.select(ROW_ID).unionByName(changes.select(ROW_ID)).distinct()
    return result.join(decided, ROW_ID, "left_anti").unionByName(fresh)


def _children(store: VersionStore, steps: list[Step], old: DataFrame, new: DataFrame, changes: DataFrame, before, number: int):
    """Paths and marks of the child tables: carried forward unless a changed row has another list or another link.

    What type a field of a child table has depends on all lists, so a table with a changed list is expanded as a whole.
    """
    paths, marks = dict(before["children"] or {}), dict(before["child_marks"] or {})
    for i, s in enumerate(steps):
        if s.operation != "expand_nested":
            continue
        link = s.parameters.get("key_column") or "_row"
        own = lambda d, i=i: _apply(d.join(changes.select(ROW_ID), ROW_ID, "left_semi"), steps[:i])
        a, b = own(old), own(new)
        columns = [ROW_ID, s.parameters["column"], *([link] if link in a.columns else [])]
        tagged = a.select(*[q(c) for c in columns], F.lit(1).alias("_side")).unionByName(b.select(*[q(c) for c in columns], F.lit(-1).alias("_side")))
        if not tagged.groupBy(*[q(c) for c in columns]).agg(F.sum("_side").alias("_d")).where("_d <> 0").isEmpty():
            again, seen = store._write_children(get_op(s.operation).child_tables(_apply(new, steps[:i]), s.parameters), number)
            paths, marks = paths | again, marks | seen
    return paths, marks


def execute_incremental(store: VersionStore, plan: Plan, source: DataFrame) -> int:
    """Write the changed source and its result as new versions; the number of the result.

    The source has the row ids of the one before (new rows have new ones) and the same columns. What changed is found
    by the hash trees of both sources. All operations but ``deduplicate`` work row by row, so they run on changed and
    added rows only; for ``deduplicate`` all rows whose key a change touches are decided again, on one narrow scan of
    the source. Child tables are carried forward where no list or link changed. An unchanged source gives a version
    that points at the files of the last result. A plan with two ``deduplicate`` steps, or with a step that expands
    lists after one, is run as a whole.
    """
    records = store.records()
    last_source = records.where(F.col("note") == SOURCE).agg(F.max("version_no")).first()[0]
    last_result = records.where(F.col("note").isin(*RESULTS)).agg(F.max("version_no")).first()[0]
    if last_source is None or last_result is None or last_result < last_source:
        raise ValueError("execute the plan on a first source before")
    old, number = store.read(last_source), store.current() + 1
    if sorted(schema_of(old).items()) != sorted(schema_of(source).items()):
        raise ValueError("the source has other columns or types than before: execute the plan as a whole")
    store._add(number, 0, *store._write(source.select(*[q(c) for c in old.columns]), f"v{number}"), {}, {}, None, SOURCE)
    new, before, steps = store.read(number), store.record(last_result), plan.decided()
    changes = _kept(frame_difference(old, new, store.tree(last_source), store.tree(number)), "changes")
    number += 1
    if changes.isEmpty():
        mark = (before["row_count"], before["hash_xor"], before["hash_sum"])
        store._add(number, before["step_no"], before["path"], mark, dict(before["children"] or {}), dict(before["child_marks"] or {}), None, "incremental")
        return number
    at = [i for i, s in enumerate(steps) if s.operation == "deduplicate"]
    if len(at) > 1 or at and any(s.operation == "expand_nested" for s in steps[at[0] :]):
        main, tables = plan.run(new)
        paths, marks = store._write_children(tables, number)
    else:
        main = _main(steps, old, new, store.read(last_result), changes)
        paths, marks = _children(store, steps, old, new, changes, before, number)
    store._add(number, before["step_no"], *store._write(main, f"v{number}"), paths, marks, None, "incremental")
    return number
