"""Readers, upkeep and the streaming build."""

import os
from decimal import Decimal
from pathlib import Path

import pytest
from helpers import accounts, rows, trades, transactions
from pyspark.sql import functions as F

from tradeweave.operators import maintenance, stored
from tradeweave.operators.edges import trades_with
from tradeweave.session import shared_dir, write_table
from tradeweave.plans import catalog, exports
from tradeweave.sources import files
from tradeweave.streaming.trades import compact, current_trades, stream_trades


@pytest.fixture()
def bank(tmp_path):
    def write(name, *lines):
        (tmp_path / name).write_bytes("\r\n".join(lines).encode() + b"\r\n")
        return str(tmp_path / name)

    entity_head = "customerId,name,registrationNumber,region,segment,status,turnover,riskScore,sicCode"
    tx_head = "transactionId,senderAccountId,receiverAccountId,amount,currency,date,channel,reference"
    return {
        "industries": write("i.csv", "sicCode,name,sector", '1110,"Cereals, growing",Agriculture'),
        "products": write("p.csv", "productId,name,pillar,monthlyFee", "P001,Loan,lend,250.0", "P002,Odd,lend,n/a"),
        "banked": write("b.csv", entity_head, "C1,One,R/1,North,SME,banked,12.5,0.3,1110", "C2,Lost,R/2,North,SME,banked,oops,0.3,9999"),
        "unbanked": write("u.csv", entity_head, "U1,One Ltd,,South,,unbanked,,,1110"),
        "accounts": write("a.csv", "accountId,customerId,accountType,openDate,balance",
                          "A1,C1,cheque,2015-01-31,5.5", "A2,U1,external,2015-02-30,0", "A3,C2,cheque,2015-01-31,1"),
        "eft": write("e.csv", tx_head, "E1,A1,A2,10.25,ZAR,2024-01-05,EFT,x", "E2,A1,A3,1,ZAR,2024-01-05,EFT,x"),
        "nav": write("n.csv", tx_head, "N1,A2,A1,3,ZAR,2024-01-06,NAV,x", "N2,ZZ,A3,1,ZAR,2024-01-05,NAV,x"),
        "holdings": write("h.csv", "customerId,productId,since", "C1,P001,2020-05-01", "C1,P404,2020-05-01"),
        "truth": write("t.csv", "bankedCustomerId,unbankedEntityId,bankedName,unbankedVariantName", "C1,U1,One,One Ltd"),
    }


def test_rejected_payments_are_found_in_one_reading(spark, tmp_path):
    """A payment is rejected once for each account it lacks, and the files are read once for both."""
    lines = ["E1,A1,A2", "E2,A1,A9", "E3,A9,A8", "E3,A9,A8", "E4,,A1"]
    heading = "transactionId,senderAccountId,receiverAccountId,amount,currency,date,channel,reference"
    (tmp_path / "eft.csv").write_text("\n".join([heading, *[f"{line},1.00,ZAR,2024-01-01,EFT,x" for line in lines]]) + "\n")
    known = spark.createDataFrame([("A1",), ("A1",), ("A2",), (None,)], "account_id string")
    paid = files.read_transactions(spark, [str(tmp_path / "eft.csv")], known)
    assert rows(paid.accepted, "transaction_id") == [("E1",)]
    assert rows(paid.rejected, "transaction_id", "missing_parent") == sorted(
        [("E2", "receiver_account_id"), ("E4", "sender_account_id")] + 2 * [("E3", "receiver_account_id"), ("E3", "sender_account_id")]
    )
    assert paid.rejected._jdf.queryExecution().optimizedPlan().toString().count("Relation [transactionId") == 1


def test_loading_drops_and_reports_orphans(spark, bank):
    industries = files.read_industries(spark, bank["industries"])
    assert industries.first().name == "Cereals, growing"
    catalogue = files.read_products(spark, bank["products"])
    assert rows(catalogue.where("monthly_fee is null"), "product_id") == [("P002",)]

    people = files.read_entities(spark, bank["banked"], bank["unbanked"], industries)
    assert rows(people.accepted, "entity_id", "status") == [("C1", "banked"), ("U1", "unbanked")]
    assert rows(people.rejected, "entity_id", "missing_parent") == [("C2", "sic_code")]
    unbanked = people.accepted.where("entity_id = 'U1'").first()
    assert (unbanked.segment, unbanked.turnover, unbanked.registration_number) == (None, None, None)

    owned = files.read_accounts(spark, bank["accounts"], people.accepted)
    assert rows(owned.accepted, "account_id") == [("A1",), ("A2",)]
    assert owned.accepted.where("account_id = 'A2'").first().open_date is None
    assert rows(owned.rejected, "account_id") == [("A3",)]

    paid = files.read_transactions(spark, [bank["eft"], bank["nav"]], owned.accepted)
    assert rows(paid.accepted, "transaction_id", "amount") == [("E1", Decimal("10.25")), ("N1", Decimal("3.00"))]
    assert rows(paid.rejected, "transaction_id", "missing_parent") == [
        ("E2", "receiver_account_id"), ("N2", "receiver_account_id"), ("N2", "sender_account_id"),
    ]
    held = files.read_holdings(spark, bank["holdings"], people.accepted, catalogue)
    assert rows(held.accepted, "product_id") == [("P001",)]
    assert rows(held.rejected, "product_id", "missing_parent") == [("P404", "product_id")]
    assert files.read_ground_truth(spark, bank["truth"]).first().unbanked_name == "One Ltd"
    # Operators do not depend on the kind of id.
    assert rows(trades_with(paid.accepted, owned.accepted), "src", "dst") == [("C1", "U1"), ("U1", "C1")]


def test_quotes_commas_and_backslashes_survive(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_bytes(b'sicCode,name,sector\r\n1,"Bits ""and"" bobs, misc",S\r\n2,"C:\\",T\r\n3,plain \\ text,U\r\n4,"",V\r\n')
    found = rows(files.read_industries(spark, str(path)), "sic_code", "name", "sector")
    assert found[:3] == [("1", 'Bits "and" bobs, misc', "S"), ("2", "C:\\", "T"), ("3", "plain \\ text", "U")]
    again = exports.industries_csv(files.read_industries(spark, str(path)))
    assert rows(files.read_industries(spark, again), "sic_code", "name", "sector")[:3] == found[:3]


def test_unique_keys(spark):
    df = files.inline_rows(spark, [("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert rows(maintenance.check_unique(df, "k"), "k", "count") == [("a", 2)]


def test_upsert_sets_only_named_columns(spark):
    current = files.inline_rows(spark, [(1, "x", 5), (2, "y", 6)], "k int, a string, b int")
    updates = files.inline_rows(spark, [(2, None, 9), (3, "n", 1)], "k int, a string, b int")
    found = maintenance.upsert(current, updates, "k", ["a"]).orderBy("k").collect()
    assert [tuple(r) for r in found] == [(1, "x", 5), (2, None, 6), (3, "n", None)]


def test_accumulation_adds_and_creates(spark):
    found = maintenance.accumulate_trades(trades(spark, [(1, 2, 10, 1)]), trades(spark, [(1, 2, 5, 2), (2, 1, 1, 1)]))
    assert rows(found, "src", "dst", "amount", "tx_count") == [(1, 2, 15, 3), (2, 1, 1, 1)]


def test_replacing_a_folder(spark, tmp_path):
    path = str(tmp_path / "m")
    stored.replace_folder(trades(spark, [(1, 2), (3, 4)]), path)
    stored.replace_folder(trades(spark, [(5, 6)]), path)
    assert rows(spark.read.parquet(path), "src") == [(5,)]
    # A job that fails leaves the old table, and a crash between the renames is mended by the next call.
    with pytest.raises(Exception):
        stored.replace_folder(trades(spark, [(7, 8)]).selectExpr("raise_error('no') AS src"), path)
    assert rows(spark.read.parquet(path), "src") == [(5,)]
    os.rename(path, path + ".old")
    with pytest.raises(Exception):
        stored.replace_folder(trades(spark, [(7, 8)]).selectExpr("raise_error('no') AS src"), path)
    assert rows(spark.read.parquet(path), "src") == [(5,)]
    stored.replace_folder(spark.read.parquet(path).selectExpr("src + 1 AS src"), path)
    assert rows(spark.read.parquet(path), "src") == [(6,)] and sorted(os.listdir(tmp_path)) == ["m"]


def test_an_update_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = stored.StoredTable(spark, path, "k", buckets=8).create(spark.range(100).selectExpr("id AS k", "id * 2 AS v", "'x' AS w"))
    files_of = lambda: {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    before = files_of()
    touched = table.upsert(files.inline_rows(spark, [(3, 0), (1000, 1)], "k long, v long"), ["v"])
    same = {f for f, t in files_of().items() if before.get(f) == t}
    assert len(touched) <= 2 and same == {f for f in before if not any(f"_bucket={b}/" in f for b in touched)}
    assert rows(table.read().where("k IN (3, 4, 1000)"), "k", "v", "w") == [(3, 0, "x"), (4, 8, "x"), (1000, 1, None)]
    table.delete(spark.range(1, 2000).selectExpr("id AS k"))
    assert rows(table.read(), "k") == [(0,)]
    table.insert_if_absent(files.inline_rows(spark, [(0, 9, "y"), (5, 5, "y")], "k long, v long, w string"))
    assert rows(table.read(), "k", "v", "w") == [(0, 0, "x"), (5, 5, "y")]
    assert table.delete(spark.range(0).selectExpr("id AS k")) == []


def test_write_back_keeps_unscored_entities(spark):
    people = files.inline_rows(spark, [(1,), (2,)], "entity_id long")
    scores = files.inline_rows(spark, [(1, 0.5)], "entity_id long, page_rank double")
    assert [tuple(r) for r in maintenance.write_back(people, scores).orderBy("entity_id").collect()] == [(1, 0.5), (2, None)]


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    owners = accounts(spark, {1: 10, 2: 20, 3: 30})
    days = [(1, 2, "1.50", "2024-01-01"), (1, 2, "2", "2024-01-05"), (2, 3, "4", "2024-02-01"), (1, 2, "8", "2024-02-11"), (3, 1, "1", "2024-03-01")]
    source, totals = str(tmp_path / "in"), str(tmp_path / "totals")
    for i, day in enumerate(days):
        transactions(spark, [day]).coalesce(1).write.mode("append").parquet(source)
    layout = transactions(spark, days).schema

    def run(progress):
        stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 2).parquet(source)
        stream_trades(stream, owners, totals, str(tmp_path / progress)).awaitTermination()

    columns = ("src", "dst", "amount", "tx_count")
    run("p1")
    want = trades_with(transactions(spark, days), owners)
    assert rows(current_trades(spark, totals), *columns) == rows(want, *columns)
    assert current_trades(spark, totals).where("src = 10").first().avg_interval == 41 / 2
    # Progress is lost and every batch runs again under the same number.
    run("p2")
    assert rows(current_trades(spark, totals), *columns) == rows(want, *columns)
    # Folding some batches, then the rest, changes nothing; later batches are added to the base.
    assert compact(spark, totals, 0) == 0
    assert rows(current_trades(spark, totals), *columns) == rows(want, *columns)
    last = compact(spark, totals)
    assert last > 0 and compact(spark, totals) is None
    assert rows(current_trades(spark, totals), *columns) == rows(want, *columns)
    more = [(2, 1, "3", "2024-04-01"), (1, 2, "1", "2024-04-02")]
    transactions(spark, more).coalesce(1).write.mode("append").parquet(source)
    run("p2")
    want = trades_with(transactions(spark, days + more), owners)
    assert rows(current_trades(spark, totals), *columns) == rows(want, *columns)
    # A batch that is not written completely is neither read nor folded.
    os.makedirs(f"{totals}/batches/batch_id={last + 2}/_temporary")
    assert compact(spark, totals) == last + 1 and sorted(os.listdir(f"{totals}/bases")) == [str(last), str(last + 1)]
    assert rows(current_trades(spark, totals), *columns) == rows(want, *columns)


def test_files_that_arrive_hold_a_bounded_number_of_payments(spark, tmp_path):
    """Even if most payments are of one day; a small table still arrives in as many files as deliveries."""
    days = [(1, 2, "1", "2024-01-01")] * 60 + [(2, 1, "2", f"2024-02-{d:02d}") for d in range(1, 21)]
    paid = transactions(spark, days).drop("transaction_id").withColumn("transaction_id", F.monotonically_increasing_id().cast("string"))
    paid = write_table(paid, "paid")
    source = str(tmp_path / "in")
    assert catalog.write_arriving(paid, source, 2, rows_per_file=10) == 4
    arrived = spark.read.parquet(source)
    sizes = [r["count"] for r in arrived.groupBy(F.input_file_name().alias("f")).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 20
    assert rows(arrived.select(*paid.columns), *paid.columns) == rows(paid, *paid.columns)
    assert catalog.write_arriving(paid, str(tmp_path / "few"), 2) == 1
    assert len(list((tmp_path / "few").glob("*.parquet"))) == 2


def test_stored_tables_and_exports_are_compressed(spark):
    written = write_table(spark.range(3).toDF("k"), "numbers").inputFiles()
    assert written and all(name.endswith(".zstd.parquet") for name in written)
    path = exports.industries_csv(spark.createDataFrame([("1", 'a "b", c', "s")], "sic_code string, name string, sector string"))
    assert all(name.endswith(".csv.snappy") for name in spark.read.text(path).inputFiles())
    assert [tuple(r) for r in files.read_industries(spark, path).collect()] == [("1", 'a "b", c', "s")]


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir())
    written = write_table(spark.range(3).toDF("k"), "numbers")
    assert all(shared_dir(spark) in f for f in written.inputFiles())
    assert written.count() == 3
