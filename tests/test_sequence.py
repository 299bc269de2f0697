"""Batches of one trigger against one batch after another, and identities with odd texts."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerforge.operators import identity as I
from ledgerforge.operators import sequence as SEQ
from ledgerforge.sources import sinks
from ledgerforge.streaming import ingest as ING

BATCH = "batch_id long, position long, business_id string, account_id string, source_system string, source_transaction_id string, currency string, transaction_date date, amount_minor long, direction string, category string, payment_mode string"


def rows_of(*rows, account="acc"):
    return [(b, p, "biz", account, "bank", s, "INR", dt.date(2026, 8, 31), n, "income", None, None) for b, p, s, n in rows]


def plain(batches, stored):
    """(outcome of every row, verdicts): one batch after another; stored and inserted are sets of (account, source, amount)."""
    sources = {(a, s): n for a, s, n in stored if s}
    amounts = {(a, n) for a, _, n in stored}
    outcomes, verdicts = {}, {}
    for b in sorted({r[0] for r in batches}):
        own, seen, ids, new, bad = sorted((r for r in batches if r[0] == b), key=lambda r: r[1]), set(), {}, [], False
        for _, p, _, a, _, s, _, _, n, *_ in own:
            if s and (a, s) in sources:
                out = "DUPLICATE_SOURCE_ID" if sources[a, s] == n else "SOURCE_IDENTITY_CONFLICT"
            else:
                out = "DUPLICATE_CANONICAL_IDENTITY" if (a, n) in amounts else "UNIQUE"
            if s and ids.get(s, (a, n)) != (a, n):
                out = "SOURCE_IDENTITY_CONFLICT"
            elif out == "UNIQUE" and s and s in ids:
                out = "DUPLICATE_SOURCE_ID"
            elif out == "UNIQUE" and (a, n) in seen:
                out = "DUPLICATE_CANONICAL_IDENTITY"
            if s:
                ids.setdefault(s, (a, n))
            seen.add((a, n))
            outcomes[b, p], bad = out, bad or out.endswith("CONFLICT")
            if out == "UNIQUE":
                new.append((a, s, n))
        if not bad:
            sources |= {(a, s): n for a, s, n in new if s}
            amounts |= {(a, n) for a, _, n in new}
        verdicts[b] = (len(own), 0 if bad else len(new), 0 if bad else len(own) - len(new), "failed" if bad else "completed")
    return outcomes, verdicts


def drawn(seed, n_batches, most, sources, amounts):
    dice, rows = random.Random(seed), []
    for b in range(n_batches):
        for p in range(dice.randrange(1, most)):
            rows.append((b, p, dice.choice([None, *[f"S{k}" for k in range(sources)]]), dice.randrange(1, amounts)))
    return [*rows_of(*rows[::2]), *rows_of(*rows[1::2], account="other")]


@pytest.mark.parametrize("seed,shape", [(1, (12, 5, 30, 40)), (2, (25, 4, 12, 30)), (3, (9, 9, 60, 200)), (4, (40, 2, 6, 6))])
def test_one_trigger_is_many(spark, seed, shape):
    rows = drawn(seed, *shape)
    stored = rows_of((-1, 0, "S1", 3), (-1, 1, None, 5))
    state = I.with_hash(spark.createDataFrame(stored, BATCH)).withColumn("identity_id", F.concat(F.lit("idn_"), "canonical_identity_hash"))
    expected, verdicts = plain(rows, [("acc", "S1", 3), ("acc", None, 5)])
    judged = SEQ.classify_sequence(I.with_hash(spark.createDataFrame(rows, BATCH)), state)
    found = {(r["batch_id"], r["position"]): r["outcome"] for r in judged.collect()}
    completed = {b for b, v in verdicts.items() if v[3] == "completed"}
    assert {k: v for k, v in found.items() if k[0] in completed} == {k: v for k, v in expected.items() if k[0] in completed}
    made = {r["batch_id"]: (r["record_count"], r["inserted_count"], r["duplicate_count"], r["status"]) for r in I.batch_verdict(judged).collect()}
    assert made == verdicts and 0 < len(completed) < len(verdicts)


def test_one_trigger_equals_one_each(spark, tmp_path):
    rows = rows_of((1, 0, "A", 10), (2, 0, "A", 10), (3, 0, "A", 11), (3, 1, "C", 30), (4, 0, "C", 31), (5, 0, "B", 10), (6, 0, "B", 99))
    ledgers, verdicts = [], []
    for name, groups in (("once", [[1, 2, 3, 4, 5, 6]]), ("each", [[b] for b in range(1, 7)])):
        incoming, out, check = (str(tmp_path / name / part) for part in ("in", "out", "check"))
        for group in groups:
            for b in group:
                spark.createDataFrame([r for r in rows if r[0] == b], BATCH).coalesce(1).write.mode("append").parquet(incoming)
            ING.ingest_stream(spark, incoming, out, BATCH, check).awaitTermination()
        ledgers.append(sorted((r["transaction_id"], r["amount_minor"]) for r in sinks.committed(spark, out, "ledger").collect()))
        verdicts.append({r["batch_id"]: (r["status"], r["inserted_count"], r["duplicate_count"], r["code"]) for r in spark.read.parquet(out + "/attempts").collect()})
    assert ledgers[0] == ledgers[1] and verdicts[0] == verdicts[1]
    # The third fails, so the fourth meets no holder of C; B was never stored, as its amount was.
    assert [n for _, n in sorted(ledgers[0], key=lambda r: r[1])] == [10, 31, 99]
    assert {b: v[0] for b, v in verdicts[0].items()} == {1: "completed", 2: "completed", 3: "failed", 4: "completed", 5: "completed", 6: "completed"}


def test_identities_are_read_by_account(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [r for k in range(200) for r in rows_of((1, k, f"S{k}", k + 1), account=f"acc{k}")]
    stored = I.with_hash(spark.createDataFrame(rows, BATCH)).withColumns({"attempt_id": F.lit("a"), "transaction_id": F.col("canonical_identity_hash"), "identity_id": F.concat(F.lit("idn_"), "canonical_identity_hash")})
    sinks.append(stored, spark.createDataFrame([("a", "completed")], "attempt_id string, status string"), out)
    lost = stored.filter("account_id = 'acc7'").withColumns({"attempt_id": F.lit("broken"), "identity_id": F.lit("lost")})
    sinks.append(lost, spark.createDataFrame([], "attempt_id string, status string"), out)
    asked = [*rows_of((2, 0, "S7", 999), (2, 1, None, 8), (2, 2, "S9", 10), account="acc7"), *rows_of((2, 3, "S9", 1), account="acc9")]
    batch = I.with_hash(spark.createDataFrame(asked, BATCH))
    met = sinks.identities_met_by(batch, out)
    plan = met._jdf.queryExecution().toString()
    # The source id of one row and the amount of another find the same identity of acc7.
    assert sorted((r["account_id"], r["source_transaction_id"], r["amount_minor"]) for r in met.collect()) == [("acc7", "S7", 8), ("acc9", "S9", 10)]
    assert "bucket" in plan.split("PartitionFilters")[1][:200] and plan.count("BroadcastHashJoin") >= 2
    found = {(r["batch_id"], r["position"]): r["outcome"] for r in I.classify(batch, met).collect()}
    assert found == {(2, 0): "SOURCE_IDENTITY_CONFLICT", (2, 1): "DUPLICATE_CANONICAL_IDENTITY", (2, 2): "UNIQUE", (2, 3): "SOURCE_IDENTITY_CONFLICT"}


def test_order_of_uploads(spark):
    """The batch that was uploaded first wins, whatever its number."""
    rows = spark.createDataFrame(rows_of((1, 0, "A", 10), (2, 0, "A", 11)), BATCH).withColumn("at", -F.col("batch_id"))
    empty = I.with_hash(rows.limit(0)).withColumn("identity_id", F.lit(""))
    assert {r["batch_id"]: r["status"] for r in ING.ingest(rows, empty, order="at")[1].collect()} == {1: "failed", 2: "completed"}


@pytest.mark.parametrize("account", ["acc\t1", "a\x1fb", "\\u001F", "\\\x0b\\\\\x1a", 'quo"te\\', "\x7f é", "\x00\x08\x0c\r\n"])
def test_hash_of_odd_identifiers(spark, account):
    row = I.with_hash(spark.createDataFrame(rows_of((1, 0, None, 1234), account=account), BATCH)).first()
    text = json.dumps(["v1", account, "bank", "INR", "2026-08-31", 1234, "income"], ensure_ascii=False, separators=(",", ":"))
    assert row["canonical_identity_hash"] == hashlib.sha256(text.encode()).hexdigest()


def test_rows_without_identity_are_no_copies(spark):
    rows = [*rows_of((1, 0, None, 5), (1, 1, None, 6), account=""), *rows_of((2, 0, None, 5), (2, 1, None, 6), account="acc\t1")]
    batch = I.with_hash(spark.createDataFrame(rows, BATCH))
    empty = batch.limit(0).withColumn("identity_id", F.lit(""))
    found = {(r["batch_id"], r["position"]): r["outcome"] for r in SEQ.classify_sequence(batch, empty).collect()}
    assert found == {(1, 0): "INVALID_IDENTITY", (1, 1): "INVALID_IDENTITY", (2, 0): "UNIQUE", (2, 1): "UNIQUE"}
    verdicts = {r["batch_id"]: (r["status"], r["inserted_count"], r["code"]) for r in ING.ingest(spark.createDataFrame(rows, BATCH), empty)[1].collect()}
    assert verdicts == {1: ("failed", 0, "IDENTITY_CONFLICT"), 2: ("completed", 2, None)}
