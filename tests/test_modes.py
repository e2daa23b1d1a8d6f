import json

import pytest

from larkspur import digest, runner
from larkspur.functions.type_probes import PROBES, type_probes
from larkspur.plans.registry import OPERATIONS
from larkspur.sources import files
from larkspur.sources import generate as g
from larkspur.storage import table_path
from larkspur.streaming import chunks

SCALE = g.Scale(1000)


@pytest.fixture(scope="module")
def chunked(spark):
    path = table_path(spark, "chunks")
    files.write_parquet(g.sales_fact(spark, SCALE).repartition(3), path)
    return path


@pytest.mark.parametrize("number", chunks.STREAMED)
def test_micro_batches_give_the_batch_result(spark, chunked, number):
    operation = OPERATIONS[number]
    dims = {t: g.GENERATORS[t](spark, SCALE) for t in operation.dims}
    got = chunks.run_streaming(spark, number, chunked, files.SCHEMAS["sales_fact"], dims)
    batch = operation.run(chunks.framed(spark.read.parquet(chunked)), *[dims[d] for d in operation.dims])
    assert digest.result_digest(got, operation.floats) == digest.result_digest(batch, operation.floats)


def test_a_total_sort_is_refused_as_a_stream(spark, chunked):
    with pytest.raises(chunks.NotStreamable):
        chunks.run_streaming(spark, "OP08", chunked, files.SCHEMAS["sales_fact"])


def test_folded_chunks(spark):
    from larkspur.operators import sales as S

    frames = [chunks.framed(g.sales_fact(spark, SCALE, first=a, count=400)) for a in range(0, 1000, 400)]
    got = chunks.folded(frames, lambda f: f.select("customer_id", "product_id", "store_id", "transaction_date").distinct(), S.distinct_count)
    assert got.first() == S.distinct_count(chunks.framed(g.sales_fact(spark, SCALE))).first()


def test_changed_files_do_not_verify(spark, tmp_path):
    for form in ("parquet", "csv", "arrow"):
        made = runner.generate(spark, "dim_product", SCALE, str(tmp_path), form)
        assert made["files"] and all(f["rows"] is None or f["rows"] > 0 for f in made["files"])
        assert runner.verify(spark, "dim_product", SCALE, str(tmp_path), form)
    one = next(tmp_path.glob("dim_product/*/csv/part-*"))
    one.write_bytes(one.read_bytes().replace(b"brand_", b"bland_", 1))
    for crc in one.parent.glob(".*.crc"):
        crc.unlink()
    assert not runner.verify(spark, "dim_product", SCALE, str(tmp_path), "csv")


def test_records_have_a_form():
    with pytest.raises(ValueError):
        runner.valid({"status": "n/a"})
    with pytest.raises(ValueError):
        runner.valid({"status": "n/a", "skip_reason": "x", "unheard": 1})


def test_late_and_repeated_events(spark):
    path = table_path(spark, "events")
    files.write_parquet(g.events_log(spark, SCALE), path)
    stream = spark.readStream.schema(files.SCHEMAS["events_log"]).parquet(path)
    got = chunks.drained(chunks.latest_events(stream), "append")
    assert got.count() == spark.read.parquet(path).select("event_id").distinct().count()


def test_runner_records_resumes_and_reports(spark, tmp_path):
    out = tmp_path / "r.jsonl"
    records = runner.run(spark, [1000], ["OP01", "OP08"], ["materialized", "streaming"], out, runs=2, expected={("OP01", 1000): ("623409b57c030991623409b57c030991", 1)})
    assert {(r["op"], r["mode"], r["status"]) for r in records} == {("OP01", "materialized", "ok"), ("OP01", "streaming", "ok"), ("OP08", "materialized", "ok"), ("OP08", "streaming", "n/a")}
    assert runner.run(spark, [1000], ["OP01", "OP08"], ["materialized", "streaming"], out, runs=2) == []
    assert "OP01" in runner.report(out)
    assert files.read_jsonl(spark, f"file://{out}").where("correct").count() == 3
    assert all(json.loads(line)["env"]["cores"] for line in out.read_text().splitlines())


def test_wrong_results_are_said_to_be(spark, tmp_path):
    records = runner.run(spark, [1000], ["OP03"], ["streaming"], tmp_path / "r.jsonl", runs=1, expected={("OP03", 1000): ("00", 41)})
    assert records[0]["status"] == "incorrect"


def test_generated_files_verify(spark, tmp_path):
    runner.generate(spark, "dim_customer", SCALE, str(tmp_path), "parquet")
    assert runner.verify(spark, "dim_customer", SCALE, str(tmp_path), "parquet")
    assert runner.generate(spark, "dim_customer", SCALE, str(tmp_path), "null")["table_digest"]


def test_statistics():
    assert runner.percentile([1, 2, 3, 4], 0.5) == 2.5 and runner.percentile([7], 0.9) == 7
    s = runner.summary([10.0, 10.0, 20.0])
    assert s["median_ms"] == 10 and s["min_ms"] == 10 and s["noisy"]


def test_type_probes(spark):
    got = {r.key: r.value for r in type_probes(spark).collect()}
    assert got.keys() == PROBES.keys()
    assert got["int_div_m7_2"] == "-3" and got["int_mod_m7_2"] == "-1" and got["int64_max_plus_1"] == "error" and got["i64_2p53p1_via_f64"] == "9007199254740992"
    assert got["str_e_pre_utf8"] == "2" and got["str_e_comb_scalars"] == "2" and got["date_epoch_day_2015_01_01"] == "16436" and got["decimal_0_1_plus_0_2"] == "0.3"
