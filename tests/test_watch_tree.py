"""New, hidden and rewritten files arrive once each, also over a restart."""

from docloom.streaming.tree import TreeStreamReader, watch_tree


def _write(root, **files):
    for name, text in files.items():
        at = root / name.replace("__", "/").replace("DOT", ".")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_files_arrive_once(spark, tmp_path):
    root, got = tmp_path / "in", []
    _write(root, a="1", DOTx="2", _x="3", no__skip="4", sub__b="5")

    def start():
        stream = watch_tree(spark, str(root), str(tmp_path / "state"), exclude=["no/"])
        note = lambda rows, number: got.append(sorted((r.path, r.length) for r in rows.collect()))
        return stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(note).start()

    query = start()
    try:
        query.processAllAvailable()
        assert sorted(sum(got, [])) == [("/.x", 1), ("/_x", 1), ("/a", 1), ("/sub/b", 1)]
        _write(root, a="longer", sub__c="6", DOThidden__d="7")
        (root / "_x").unlink()
        query.processAllAvailable()
        assert sorted(sum(got[1:], []))[-3:] == [("/.hidden/d", 1), ("/a", 6), ("/sub/c", 1)]
    finally:
        query.stop()
    seen = len(sum(got, []))
    assert seen == 7
    _write(root, _x="again", late="8")
    query = start()
    try:
        query.processAllAvailable()
        assert sorted(sum(got, [])[seen:]) == [("/_x", 5), ("/late", 1)]
    finally:
        query.stop()


def test_a_batch_is_the_same_again(tmp_path):
    root = tmp_path / "in"
    options = {"path": str(root), "state": str(tmp_path / "state"), "page": "2"}
    _write(root, a="1", b="2", c="3")
    reader = TreeStreamReader(options)
    assert reader.initialOffset() == {"number": 0}
    first = reader.latestOffset()
    rows = [[r[1] for r in p.rows] for p in reader.partitions({"number": 0}, first)]
    assert rows == [["/a", "/b"], ["/c"]]
    _write(root, b="22", d="4")
    (root / "a").unlink()
    second = reader.latestOffset()
    assert second == {"number": 2} == reader.latestOffset()
    # another reader, as after a failure, knows the same and repeats the same
    again = TreeStreamReader(options)
    assert again.latestOffset() == second
    assert [[r[1] for r in p.rows] for p in again.partitions({"number": 0}, first)] == rows
    assert [[(r[1], r[4]) for r in p.rows] for p in again.partitions(first, second)] == [[("/b", 2), ("/d", 1)]]
    assert [[r[1] for r in p.rows] for p in again.partitions({"number": 0}, second)] == [["/b", "/c"], ["/d"]]
