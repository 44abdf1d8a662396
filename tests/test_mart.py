import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from gondola.operators import reports
from gondola.sources.mart import PENDING, Refresh, SalesMart, write_slices
from gondola.sources.schema import SCHEMAS
from hand_made import day_key, make_star, product, sale

D = dt.date
DAYS = [D(2024, 1, 30), D(2024, 1, 31), D(2024, 2, 1), D(2024, 3, 5)]
PRODUCTS = [product(1, 10, margin=12.5), product(2, 10, margin=20), product(3, 11), product(4, None)]


def sold(day, extra=0):
    return [sale(day, 1, 2, 30, order=1), sale(day, 2, 1 + extra, 11, order=1), sale(day, 3, 5, 7, order=2),
            sale(day, 4, 1, 1, order=3), sale(day, 3, 0, 9, order=4), sale(day, 3, 5, 7, order=2)]


@pytest.fixture
def stored(spark, tmp_path):
    def put(rows, width=1):
        write_slices(spark.createDataFrame(rows, SCHEMAS["ft_vendas"]), f"{tmp_path}/sales", width)
    return put, SalesMart(spark, f"{tmp_path}/sales", f"{tmp_path}/mart"), tmp_path


def same(spark, mart, sales, **options):
    star = make_star(spark, sales, PRODUCTS, days=DAYS)
    want = reports.monthly_sales(star, **options)
    got = mart.history(star, **options)
    assert got.schema == want.schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_appends_corrections_and_removals_equal_a_full_build(spark, stored):
    put, mart, folder = stored
    first = [r for d in DAYS[:2] for r in sold(d)]
    put(first)
    assert mart.refresh() == Refresh([day_key(d) for d in DAYS[:2]], [])
    same(spark, mart, first)
    assert mart.refresh() == Refresh([], [])
    later = [r for d in DAYS[2:] for r in sold(d)]
    put(later)
    assert mart.refresh().written == [day_key(d) for d in DAYS[2:]]
    same(spark, mart, first + later)
    same(spark, mart, first + later, months=1)
    put(sold(DAYS[1], extra=4))
    assert mart.refresh() == Refresh([day_key(DAYS[1])], [])
    same(spark, mart, sold(DAYS[0]) + sold(DAYS[1], extra=4) + later)
    put([sale(DAYS[1], 3, 0, 9)])  # nothing valid remains of the day
    mart.refresh()
    same(spark, mart, sold(DAYS[0]) + later)
    for file in glob.glob(f"{folder}/sales/slice={day_key(DAYS[0])}/*.parquet"):
        os.remove(file)
    assert mart.refresh() == Refresh([], [day_key(DAYS[0])])
    same(spark, mart, later)


def test_broken_refresh_is_done_again(spark, stored, monkeypatch):
    put, mart, _ = stored
    put(sold(DAYS[0]))
    mart.refresh()
    put(sold(DAYS[0], extra=1) + sold(DAYS[2]))

    def broken(self, slices):
        self._whole(slices)
        raise OSError("lost")

    monkeypatch.setattr(SalesMart, "_whole", SalesMart._add, raising=False)
    monkeypatch.setattr(SalesMart, "_add", broken)
    with pytest.raises(OSError):
        mart.refresh()
    monkeypatch.undo()
    assert mart._stored("log", "n long, slice long, state string").filter(
        F.col("state") == PENDING).count() == 3
    assert mart.refresh().written == [day_key(DAYS[0]), day_key(DAYS[2])]
    same(spark, mart, sold(DAYS[0], extra=1) + sold(DAYS[2]))


def test_months_as_slices_and_rows_without_a_day(spark, stored):
    put, mart, _ = stored
    rows = [r for d in DAYS for r in sold(d)]
    put(rows + [sale(None, 1)], width=100)
    assert mart.refresh().written == [202401, 202402, 202403]
    same(spark, mart, rows)


def test_only_changed_slices_are_read(spark, stored):
    put, mart, folder = stored
    put(sold(DAYS[0]) + sold(DAYS[1]))
    mart.refresh()
    # A slice that is not to be read may as well be unreadable.
    for file in glob.glob(f"{folder}/sales/slice={day_key(DAYS[0])}/*.parquet"):
        times = os.stat(file)
        with open(file, "r+b") as f:
            f.write(b"\0" * times.st_size)
        os.utime(file, ns=(times.st_atime_ns, times.st_mtime_ns))
    put(sold(DAYS[2]))
    assert mart.refresh().written == [day_key(DAYS[2])]
