"""The page index against sorting everything."""

from __future__ import annotations

import pytest
from helpers import tuples

from orderlytics.operators.pages import PageIndex

ROWS = [(n * 7919 % 1000, None if n % 50 == 0 else f"name {n * 31 % 17}", "x" * (n % 5)) for n in range(1000)]
SORTED = sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or "", r[0]))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "id bigint, name string, note string").repartition(5)
    return PageIndex.build(df, ["name", "id"], f"{tmp_path_factory.mktemp('pages')}/index", file_rows=40)


@pytest.mark.parametrize("number, size", [(1, 20), (2, 20), (3, 20), (7, 33), (50, 20), (10, 100), (51, 20), (1000, 1)])
def test_pages_by_number_read_their_files_only(spark, index, number, size):
    found = index.page(number, size)
    assert tuples(found) == SORTED[(number - 1) * size : number * size]
    names = [f.rsplit("/", 1)[1] for f in found.inputFiles()]
    read = spark.read.parquet(*[f"{index.folder}/rows/{n}" for n in names]).count() if names else 0
    assert read <= size + 2 * 40


def test_pages_after_a_key_walk_the_whole_list(index):
    last, seen = None, []
    while rows := tuples(index.page_after(last, 90)):
        seen += rows
        last = (rows[-1][1], rows[-1][0])
    assert seen == SORTED
    assert tuples(index.page_after(("name 3", 10**6), 5)) == [r for r in SORTED if r[1] and r[1] > "name 3"][:5]
    assert len(index.page_after(("name 3", 0), 20).inputFiles()) <= 21


def test_an_index_is_opened_again_without_sorting(spark, index):
    again = PageIndex.open(spark, index.folder)
    assert again.order == ("name", "id")
    assert tuples(again.page(4, 10)) == SORTED[30:40]
    assert tuples(again.totals(30)) == [(1000, 34)]


def test_an_empty_list_and_wrong_pages(spark, tmp_path, index):
    empty = PageIndex.build(spark.createDataFrame([], "id bigint, name string"), ["id"], f"{tmp_path}/empty")
    assert tuples(empty.page()) == [] and tuples(empty.page_after((1,))) == [] and tuples(empty.totals()) == [(0, 0)]
    for number, size in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            index.page(number, size)
