import os

from veritrail.sources.document_store import DocumentStore

DOCS = "doc_id long, company_id long, filename string, note string"


def docs(spark, *rows):
    return spark.createDataFrame([(d, c, f, f"n{d}") for d, c, f in rows], DOCS)


def chunks(spark, *rows):
    return spark.createDataFrame([(d, i, f"{t} {i}") for d, n, t in rows for i in range(n)], "doc_id long, chunk_index int, content string")


def files(path):
    return {os.path.join(folder, f): os.stat(os.path.join(folder, f)).st_mtime_ns
            for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def state(store):
    return (sorted(r.doc_id for r in store.documents().collect()),
            sorted((r.doc_id, r.chunk_index, r.content) for r in store.chunks().collect()))


def test_replace_delete_compact(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=16)
    many = [(i, i % 7, f"f{i}.pdf") for i in range(100, 160)]
    store.put(docs(spark, (1, 1, "a.pdf"), (2, 1, "a.pdf"), (3, 2, "a.pdf"), (4, 1, None), *many), chunks(spark, (1, 2, "old"), (2, 2, "two"), (3, 1, "three"), *[(d, 1, "x") for d, *_ in many]))
    assert state(store)[0] == [2, 3, 4, *range(100, 160)]  # of one name the latest stays
    before = files(store.path)
    store.put(docs(spark, (9, 1, "a.pdf"), (3, 5, "moved.pdf")), chunks(spark, (9, 3, "nine"), (3, 2, "moved"), (77, 1, "nobody's")))
    expected = ([3, 4, 9, *range(100, 160)],
                sorted([(9, i, f"nine {i}") for i in range(3)] + [(3, i, f"moved {i}") for i in range(2)] + [(d, 0, "x 0") for d, *_ in many]))
    assert state(store) == expected
    assert before.items() <= files(store.path).items()  # no stored file was touched
    touched = store.compact()
    assert state(store) == expected and 1 <= len(touched) <= 2
    after = files(f"{store.path}/chunks")
    clean = {f: t for f, t in before.items() if "/chunks/bucket=" in f and int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert clean and clean.items() <= after.items()
    assert store.compact() == []


def test_removed_documents_can_come_back(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=4)
    store.put(docs(spark, (1, 1, "a"), (2, 2, "b"), (3, 2, "c")), chunks(spark, (1, 1, "a"), (2, 1, "b"), (3, 1, "c")))
    store.remove_companies(spark.createDataFrame([(2,)], "company_id long"))
    assert state(store) == ([1], [(1, 0, "a 0")])
    store.put(docs(spark, (2, 2, "b")), chunks(spark, (2, 1, "again")))
    expected = ([1, 2], [(1, 0, "a 0"), (2, 0, "again 0")])
    assert state(store) == expected
    store.compact()
    assert state(store) == expected
    store.remove(spark.createDataFrame([(1,), (2,), (8,)], "doc_id long"))
    store.compact()  # empties buckets
    assert state(store) == ([], []) and DocumentStore(spark, store.path).buckets == 64
    store.put(docs(spark, (5, 5, "z")), chunks(spark, (5, 1, "z")))
    assert state(store) == ([5], [(5, 0, "z 0")])


def test_a_failed_change_is_not_seen(spark, tmp_path, monkeypatch):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=4)
    store.put(docs(spark, (1, 1, "a")), chunks(spark, (1, 1, "a")))
    with monkeypatch.context() as broken:
        broken.setattr(DocumentStore, "_commit", lambda *a: 1 / 0)
        try:
            store.put(docs(spark, (2, 1, "a")), chunks(spark, (2, 1, "b")))
        except ZeroDivisionError:
            pass
    assert state(store) == ([1], [(1, 0, "a 0")])
    store.put(docs(spark, (2, 1, "a")), chunks(spark, (2, 1, "b")))
    assert state(store) == ([2], [(2, 0, "b 0")])
