"""Runs operations over generated data and records timings, digests and verdicts as JSON lines.

python -m larkspur.runner gen|verify|run|report ... ; see --help.
"""

from __future__ import annotations

import argparse
import json
import os
import platform
import random
import resource
import statistics
import time
import uuid
from pathlib import Path

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from larkspur import digest
from larkspur.operators.files import COLUMNS, framed
from larkspur.plans.registry import OPERATIONS, Operation
from larkspur.session import session
from larkspur.sources import files
from larkspur.sources.generate import GENERATORS, SEED, Scale, estimated_bytes, label_of, refuse_beyond, rows_of
from larkspur.storage import table_path
from larkspur.streaming import chunks

FINAL = {"ok", "incorrect", "n/a", "not_run"}


def percentile(values: list[float], q: float) -> float:
    return float(np.quantile(values, q))


def summary(times: list[float], noisy_pct: float = 10.0) -> dict:
    """What a record says of its runs' times; the spread is that of the middle half, as a share of the median."""
    low, middle, high, late = np.quantile(times, (0.25, 0.5, 0.75, 0.95)).tolist()
    share = 0.0 if middle == 0 else (high - low) / middle
    return {"runs": list(times), "median_ms": middle, "min_ms": float(np.min(times)), "p95_ms": late, "iqr_pct": round(100 * share, 3), "noisy": 100 * share > noisy_pct}


def environment() -> dict:
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 1e9
    return {"cpu": platform.processor() or platform.machine(), "cores": os.cpu_count(), "ram_gb": round(memory, 2), "os": platform.system(), "kernel": platform.release(), "cache": "warm"}


def generate(spark: SparkSession, table: str, scale: Scale, folder: str, form: str, seed: int = SEED, budget_gb: float = 20) -> dict:
    """Writes one table and its manifest; form null computes the digests and writes nothing."""
    frame = GENERATORS[table](spark, scale, seed)
    path = f"{folder}/{table}/{label_of(scale.rows)}"
    if form != "null":
        refuse_beyond([table], scale, form, budget_gb)
        {"csv": files.write_csv, "parquet": files.write_parquet, "arrow": lambda df, to: files.write_arrow(df, Path(to).absolute().as_uri())}[form](frame, f"{path}/{form}")
    found = digest.column_digests(frame)
    listed = {} if form == "null" else {"hashes": files.file_hashes(spark, f"{path}/{form}"), "counts": files.rows_by_file(read(spark, table, f"{path}/{form}", form))}
    out = files.manifest(table, scale.table_rows(table), seed, found, form, frame.schema.simpleString(), **listed)
    out["table_digest"] = digest.table_digest(found)
    if form != "null":
        Path(f"{path}/manifest-{form}.json").write_text(json.dumps(out, indent=1))
    return out


def read(spark: SparkSession, table: str, path: str, form: str) -> DataFrame:
    if form == "arrow":
        return files.read_arrow(spark, Path(path).absolute().as_uri(), files.SCHEMAS[table])
    return files.read_csv(spark, path, files.SCHEMAS[table]) if form == "csv" else files.read_parquet(spark, path, files.SCHEMAS[table])


def verify(spark: SparkSession, table: str, scale: Scale, folder: str, form: str) -> bool:
    """Whether the files still hold what the manifest says: byte by byte, and as a table."""
    path = f"{folder}/{table}/{label_of(scale.rows)}"
    wanted = json.loads(Path(f"{path}/manifest-{form}.json").read_text())
    if files.file_hashes(spark, f"{path}/{form}") != {f["name"]: f["sha256"] for f in wanted["files"]}:
        return False
    return digest.table_digest(digest.column_digests(read(spark, table, f"{path}/{form}", form))) == wanted["table_digest"]


def timed(operation: Operation, sales: DataFrame, dims: list[DataFrame], mode: str) -> tuple[float, float, tuple[str, int], dict]:
    """load_ms, compute_ms, digest and floats of one run. Materialized: the needed columns are cached before the clock.

    Streaming operations with a form for it run as micro-batches over files, written before the clock. Results are taken in
    and digested where they are; only digests and the floats of one row come to the driver.
    """
    spark = sales.sparkSession
    began = time.perf_counter()
    needed, chunk = sales.select(*operation.columns), None
    streamed = mode == "streaming" and not operation.csv and operation.number in chunks.STREAMED
    if streamed:
        chunk = table_path(spark, "chunks")
        files.write_parquet(needed, chunk)
    elif mode == "materialized" and not operation.csv:
        needed = needed.cache()
        files.write_noop(needed)
    load = 1000 * (time.perf_counter() - began)
    began = time.perf_counter()
    if streamed:
        result = chunks.streamed(operation, spark.readStream.schema(needed.schema).option("maxFilesPerTrigger", 1).parquet(chunk), dims)
    else:
        result = operation.run(needed, *dims)
        files.write_noop(result)
    compute = 1000 * (time.perf_counter() - began)
    found = digest.result_digest(result, operation.floats)
    floats = result.select(*operation.floats).first().asDict() if operation.floats else {}
    needed.unpersist()
    return load, compute, found, floats


def resident_mb() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20


def record(operation: Operation, sales: DataFrame, dims: list[DataFrame], mode: str, rows: int, expected: tuple[str, int] | None, runs: int = 5, run_id: str = "", startup_ms: float | None = None) -> dict:
    """One result record; files.RESULT_SCHEMA has its fields."""
    spark = sales.sparkSession
    out = {"run_id": run_id, "track": "S", "implementation": "spark", "variant": "default", "toolchain": {"name": "pyspark", "version": pyspark.__version__, "flags": ""}, "op": operation.number, "dataset": "ABC"[: 1 + len(operation.dims)], "rows": rows, "mode": mode, "threads": spark.sparkContext.defaultParallelism, "startup_ms": startup_ms, "env": environment()}
    if mode not in operation.modes:
        return valid(out | {"status": "n/a", "skip_reason": f"{operation.number} has no {mode} mode"})
    try:
        timed(operation, sales, dims, mode)  # warm-up
        found = [timed(operation, sales, dims, mode) for _ in range(runs)]
    except Exception as error:  # one failed operation is a record, not the end of the plan
        return valid(out | {"status": "failed", "notes": str(error)[:500]})
    digests = {f[2] for f in found}
    correct = len(digests) == 1 and (expected is None or digests == {expected})
    checksum, count = found[-1][2]
    out |= {"status": "ok" if correct else "incorrect", "correct": correct, "checksum": checksum, "expected_checksum": expected[0] if expected else checksum, "row_count": count, "load_ms": statistics.median(f[0] for f in found)}
    out |= summary([f[1] for f in found])
    seconds = out["median_ms"] / 1000
    out |= {"compute_ms": out["median_ms"], "total_ms": out["load_ms"] + out["median_ms"], "rows_per_s": rows / seconds, "mb_per_s": estimated_bytes("sales_fact", Scale(rows), "arrow") / 1e6 / seconds}
    out |= {"peak_rss_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, "steady_rss_mb": resident_mb()}
    if mode == "streaming":
        parts = sales.rdd.getNumPartitions()
        out |= {"chunk_rows": -(-rows // parts), "chunk_rows_per_s": [rows / (f[1] / 1000) for f in found]}
    return valid(out)


def valid(one: dict) -> dict:
    """The record itself; a field that the schema doesn't have, or a status without its fields, is an error."""
    known = set(StructType.fromDDL(files.RESULT_SCHEMA).names)
    if extra := set(one) - known:
        raise ValueError(f"fields without a place in the schema: {sorted(extra)}")
    needed = {"ok": ("checksum", "row_count", "median_ms"), "incorrect": ("checksum", "expected_checksum"), "failed": ("notes",), "n/a": ("skip_reason",)}[one["status"]]
    if missing := [k for k in needed if one.get(k) is None]:
        raise ValueError(f"{one['status']} without {missing}")
    return one


def key(r: dict) -> tuple:
    return r["op"], r["rows"], r["mode"], r["threads"]


def done(path: Path) -> set[tuple]:
    """What need not be run again; failed and timed-out runs are."""
    if not path.exists():
        return set()
    return {key(r) for r in map(json.loads, path.read_text().splitlines()) if r["status"] in FINAL}


def run(spark: SparkSession, scales: list[int], numbers: list[str], modes: list[str], out: Path, folder: str | None = None, form: str = "parquet", runs: int = 5, expected: dict | None = None, startup_ms: float | None = None) -> list[dict]:
    """Every operation, scale and mode in a shuffled but fixed order; sales come from files or straight from the generator."""
    plan = [(n, o, m) for n in scales for o in numbers for m in modes]
    random.Random(42).shuffle(plan)
    finished, run_id, records = done(out), uuid.uuid4().hex[:12], []
    for n, number, mode in plan:
        operation, scale = OPERATIONS[number], Scale(n)
        if (number, n, mode, spark.sparkContext.defaultParallelism) in finished:
            continue
        frames = {t: read(spark, t, f"{folder}/{t}/{label_of(n)}/{form}", form) if folder else GENERATORS[t](spark, scale) for t in ("sales_fact", *operation.dims)}
        one = record(operation, framed(frames["sales_fact"]), [frames[d] for d in operation.dims], mode, n, (expected or {}).get((number, n)), runs, run_id, startup_ms)
        files.write_jsonl([one], out)
        records.append(one)
    return records


def report(path: Path) -> str:
    """A table of the latest record of each operation, scale and mode."""
    latest = {key(r): r for r in map(json.loads, path.read_text().splitlines())}
    lines = ["| op | rows | mode | threads | status | load ms | compute ms | IQR % |", "|-|-|-|-|-|-|-|-|"]
    for k, r in sorted(latest.items()):
        shown = [f"{r[x]:.1f}" if isinstance(r.get(x), float) else "-" for x in ("load_ms", "compute_ms", "iqr_pct")]
        lines.append("| " + " | ".join([*map(str, k), r["status"], *shown]) + " |")
    return "\n".join(lines)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="larkspur.runner")
    p.add_argument("command", choices=("gen", "verify", "run", "report"))
    p.add_argument("--tables", nargs="+", default=["sales_fact", "dim_customer", "dim_product"], choices=list(GENERATORS))
    p.add_argument("--rows", nargs="+", type=rows_of, default=[1000])
    p.add_argument("--ops", nargs="+", default=[k for k in OPERATIONS])
    p.add_argument("--modes", nargs="+", default=["materialized", "streaming"])
    p.add_argument("--folder")
    p.add_argument("--format", default="parquet", choices=("parquet", "csv", "arrow", "null"))
    p.add_argument("--out", type=Path, default=Path("results.jsonl"))
    p.add_argument("--runs", type=int, default=5)
    p.add_argument("--budget-gb", type=float, default=20)
    p.add_argument("--allow-large-wide", action="store_true", help="wide_numeric beyond 100 million rows")
    a = p.parse_args(args)
    if a.command == "report":
        print(report(a.out))
        return 0
    began = time.perf_counter()
    spark = session()
    startup_ms = 1000 * (time.perf_counter() - began)
    if a.command == "run":
        records = run(spark, a.rows, a.ops, a.modes, a.out, a.folder, a.format, a.runs, startup_ms=startup_ms)
        return int(any(r["status"] in ("failed", "incorrect") for r in records))
    good = True
    for n in a.rows:
        for t in a.tables:
            if a.command == "gen":
                print(json.dumps(generate(spark, t, Scale(n, a.allow_large_wide), a.folder or "data", a.format, budget_gb=a.budget_gb)))
            else:
                good &= (ok := verify(spark, t, Scale(n, a.allow_large_wide), a.folder or "data", a.format))
                print(t, label_of(n), "ok" if ok else "differs")
    return int(not good)


if __name__ == "__main__":
    raise SystemExit(main())
