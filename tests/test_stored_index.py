"""An index kept in files: searches against a plain filter, files opened, and what a refresh writes."""

import pytest

from docloom.operators.extract import range_values
from docloom.operators.stored_index import StoredIndex


def _docs(spark, values):
    return spark.createDataFrame([(f"d{k:04}", f'{{"n": {v}, "m": {k % 7}}}') for k, v in values.items()], "uri string, content string")


def _extract(docs):
    return range_values(docs, {"type": "long", "path": ["n", "m"]}).good.select("uri", "name", "value")


@pytest.fixture
def index(spark, tmp_path):
    return StoredIndex(spark, f"{tmp_path}/index", _extract, file_rows=100)


def _search(index, *args, **options):
    return sorted((r.value, r.uri) for r in index.search(*args, **options).collect())


def test_searches_open_only_files_that_may_match(spark, index):
    values = {k: (k * 37) % 1000 for k in range(1000)}
    done = index.refresh(_docs(spark, values))
    assert (done.changed, done.removed, done.kept) == (1000, 0, 0) and done.written >= 15
    want = sorted((v, f"d{k:04}") for k, v in values.items())
    assert _search(index, "n", 100, 150) == [w for w in want if 100 <= w[0] <= 150]
    assert _search(index, "n", 100, 150, included=(False, False)) == [w for w in want if 100 < w[0] < 150]
    assert _search(index, "n") == want and _search(index, "n", low=990) == [w for w in want if w[0] >= 990]
    assert _search(index, "m", 3, 3) == sorted((3, f"d{k:04}") for k in range(1000) if k % 7 == 3)
    assert _search(index, "none") == _search(index, "n", 5000, None) == []
    files = len(index.search("n").inputFiles())
    assert 1 <= len(index.search("n", 100, 150).inputFiles()) <= 3 < files
    assert sum(r.rows for r in index.files().collect()) == 2000


def test_one_value_of_most_documents_is_many_files(spark, index):
    index.refresh(_docs(spark, dict.fromkeys(range(1000), 5)))
    sizes = [r.rows for r in index.files().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 400
    assert len(_search(index, "n", 5, 5)) == 1000


def test_a_refresh_touches_what_has_changed(spark, index):
    values = {k: k for k in range(1000)}
    first = index.refresh(_docs(spark, values))
    seen = []
    index.extract = lambda docs: seen.append(docs.count()) or _extract(docs)
    values[500] = -1
    del values[900]
    values[2000] = 77
    second = index.refresh(_docs(spark, values))
    assert seen == [2] and (second.changed, second.removed) == (2, 1)
    assert second.kept >= first.written - 6 and second.written < first.written / 2
    assert _search(index, "n") == sorted((v, f"d{k:04}") for k, v in values.items())
    assert _search(index, "m", 0, 6) == sorted((k % 7, f"d{k:04}") for k in values)
    assert index.refresh(_docs(spark, values)) == (0, 0, index.files().count(), 0) and index.generations() == [0, 1]
    assert index.vacuum() > 0 and index.generations() == [1]
    assert _search(index, "n") == sorted((v, f"d{k:04}") for k, v in values.items())


def test_odd_documents_and_unfinished_generations(spark, index, tmp_path):
    with pytest.raises(ValueError):
        index.search("n")
    rows = [("a", '{"n": 1}'), ("a", '{"n": 1}'), (None, '{"n": 2}'), ("b", None), ("c", "no json")]
    assert index.refresh(spark.createDataFrame(rows, "uri string, content string")).changed == 3
    assert _search(index, "n") == [(1, "a")]
    assert index.refresh(spark.createDataFrame([], "uri string, content string")).removed == 3
    assert _search(index, "n") == []
    (tmp_path / "index" / "generation-7" / "files").mkdir(parents=True)
    assert index.generations() == [0, 1]
    assert index.refresh(_docs(spark, {1: 4})).changed == 1 and _search(index, "n") == [(4, "d0001")]
