"""Plans over tables small enough to know their rows by hand: what the given tables never show."""

import datetime as dt

import pytest

from tessera.plans import registry

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Supplier 1 is closed: one debtor, a single interest, no subordinated tranche; 11 has three debtors, 21 has a subordinated tranche, 2 is of no single
    interest. All report in the cutoff's month and the one before it."""
    path = str(tmp_path_factory.mktemp("small"))
    lines, orders = [], []

    def line(supplier, customer, flag, value, day):
        key = len(orders) + 1
        orders.append((key, customer, "O", value, dt.datetime(2001, 1, 5), "1-URGENT"))
        lines.append((key, 1, supplier, 1, 10.0, value, 0.0, 0.02, flag, "O", day))

    for month in (5, 6):
        day = dt.datetime(2001, month, 10)
        line(1, 7, "N", 3e4, day)
        for customer in (7, 8, 9):
            line(11, customer, "N", 2e4, day)
        line(21, 7, "N", 3e4, day)
        line(21, 7, "R", 3e4, day)
        line(2, 7, "N", 3e4, day)
    tables = {
        "lineitem": (lines, LINE), "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "supplier": ([(k, f"Supplier#{k}", 0, 100.0) for k in (1, 2, 11, 21)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"), "nation": ([(0, "NATION_0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "EUROPE")], "r_regionkey int, r_name string"), "part": ([(1, "p", "Brand#3", "T", 1, 1.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "customer": ([(k, f"Customer#{k}", 0, -1.0 if k == 8 else 1.0, "SEG") for k in (7, 8, 9)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def of(spark, folder, name):
    return registry.queries()[name](spark, folder)


def test_closed_vehicles(spark, folder):
    got = of(spark, folder, "rf3_single_interest").collect()
    assert [(r.cnpj[-2:], r.pl, r.n_hold, r.interest, r.subord) for r in got] == [("01", 3e4, 1, "S", 0.0)]


def test_release_of_sound_tables(spark, folder):
    got = {r.stage: (r.status, r.n_rows) for r in of(spark, folder, "release_stopped").collect()}
    assert got == {"panel": ("OK", 8), "repeated": ("OK", 0), "sane": ("OK", 8), "market": ("OK", 2), "poor": ("OK", 0), "admins": ("OK", 1), "audit": ("OK", 2), "ranking": ("OK", 4)}


def test_company_view(spark, folder):
    (row,) = of(spark, folder, "company_xray").collect()
    assert (row.ced, row.exposure, row.n_vehicles, row.n_months, row.holder) == ("Brand#3", 1.8e5, 4, 2, False)
    assert row.judicial == "list (2001-05-31); name (2001-05-31)"
    assert row.vehicles == "Supplier#1 (100%); Supplier#2 (100%); Supplier#11 (100%); Supplier#21 (100%)"


def test_holders(spark, folder):
    row = of(spark, folder, "holders_summary").first()
    assert (row.n, row.total, row.outside, row.inside, row.n_outside, row.linked, row.unknown, row.n_unknown) == (7, 1.8e5, 1.8e5, 0.0, 3, 0.0, 0.0, 0)
