import pytest

from orrery.llm import token_rollup as tr
from orrery.staging import Stages

SCHEMA = "source string, lang string, tokenizer string, tokens long"


def store_of(spark):
    return tr.RollupStore(spark, Stages(spark, "test-rollup").root)


def totals(store):
    return {tuple(r[:3]): tuple(r[3:]) for r in store.totals().collect()}


def test_inserts_deletes_and_revisions_add_up(spark):
    store = store_of(spark)
    assert totals(store) == {}
    rows = spark.createDataFrame([("a", "en", "v1", 5), ("a", "en", "v1", 7), (None, None, "v1", 3), ("b", "de", "v1", None)], SCHEMA)
    assert store.commit("b1", tr.signed(rows, 1))
    assert totals(store) == {("a", "en", "v1"): (2, 12), (None, None, "v1"): (1, 3), ("b", "de", "v1"): (1, 0)}
    old = spark.createDataFrame([("a", "en", "v1", 7)], SCHEMA)
    new = spark.createDataFrame([("a", "en", "v2", 9)], SCHEMA)
    assert store.commit("b2", tr.revised(old, new))
    assert store.commit("b3", tr.signed(rows.where("source is null"), -1))
    assert totals(store) == {("a", "en", "v1"): (1, 5), ("a", "en", "v2"): (1, 9), ("b", "de", "v1"): (1, 0)}


def test_a_batch_commits_once(spark):
    store = store_of(spark)
    rows = tr.signed(spark.createDataFrame([("a", "en", "v1", 5)], SCHEMA), 1)
    assert store.commit("b1", rows) and not store.commit("b1", rows.unionByName(rows))
    assert totals(tr.RollupStore(spark, store.path)) == {("a", "en", "v1"): (1, 5)}
    # A run that died before its marker leaves rows that do not count and are replaced.
    rows.unionByName(rows).write.parquet(f"{store.path}/deltas/b2")
    assert totals(store) == {("a", "en", "v1"): (1, 5)}
    assert store.commit("b2", rows)
    assert totals(store) == {("a", "en", "v1"): (2, 10)}
    with pytest.raises(ValueError):
        store.commit("../evil", rows)


def test_counts(spark):
    docs = spark.createDataFrame([("a b\x0bc", "s", "en"), (None, None, None), ("", "s", "en"), ("x1,é \U0001f600!", "s", "de")], "text string, source string, lang string")
    got = sorted((r["words_1"], r["words_2"]) for r in tr.measured(docs).collect())
    assert got == [(0, 0), (0, 0), (2, 5), (3, 3)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "text string, source string, lang string, tokens long")
    assert tr.roll_up(store_of(spark), tr.measured(empty)).count() == 0


def test_restored_totals_are_those_of_the_whole_table(spark, tmp_path):
    import duckdb

    from orrery.llm import queries, token_rollup

    rows = [(k, text, lang, source) for k, (text, lang, source) in enumerate([("a b, c", "en", "s"), ("w " * 30, "en", "s"), ("x y", "de", "s"), ("z. " * 25, "de", None), (None, None, "t")])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["source", "lang", "tokenizer", "n_docs", "n_tokens"]
    got = queries.QUERIES["op4_token_rollup_words"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(token_rollup.WORDS_SQL).fetchall(), key=str)
    assert sum(r["n_docs"] for r in got) == 2 * len(rows)


def test_ids_are_those_of_the_tokenizer(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from orrery.llm import queries

    texts = ["a b, c", "w " * 30, "Größe naïve \u4e2d\u6587 \U0001f600", "z. " * 25, None, "", " \n" * 40, "long word" * 50_000]
    rows = [(k, text, "en" if k % 2 else None, "s", 7) for k, text in enumerate(texts)] + [(0, "a b, c", "de", None, 7)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    slow, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for _, text, lang, source, _ in rows:
        counts = {"words-1": len((text or "").split()), "byte_bpe_50k": len(slow.encode(text or "", add_special_tokens=False).ids)}
        for version, n in counts.items():
            docs, tokens = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (docs + 1, tokens + n)
    got = queries.QUERIES["op4_token_rollup"](spark, str(tmp_path)).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert tr.roll_up_tokenized(store_of(spark), tr.tokenized(empty, public_tokenizers.path("byte_bpe_50k.json")), "v").count() == 0


def test_commits_fold_into_a_total_and_writers_do_not_disturb_each_other(spark):
    store = store_of(spark)
    row = lambda n: tr.signed(spark.createDataFrame([("a", "en", "v1", n)], SCHEMA), 1)
    for k in range(4):
        store.commit(f"b{k}", row(10**k))
    assert totals(store) == {("a", "en", "v1"): (4, 1111)}
    assert len(store._names("totals")) <= 2 and store._latest()[1] == {"b0", "b1", "b2", "b3"}
    # Two attempts at one batch, and a total that another writer wrote at the same time without it.
    for attempt in ("x", "y"):
        tr.reduced(row(5)).write.parquet(f"{store.path}/deltas/c/{attempt}")
        store._put(f"commits/c~{attempt}")
    assert totals(store) == {("a", "en", "v1"): (5, 1116)} and not store.commit("c", row(5))
    name = store._latest()[0]
    store.compact()
    late = f"totals/{int(name.split('-')[0]) + 1:012d}-zzz"
    spark.read.parquet(f"{store.path}/totals/{name}/rows").write.parquet(f"{store.path}/{late}/rows")
    store._put(f"{late}/batches.txt", "b0\nb1\nb2\nb3")
    store._put(f"{late}/_DONE")
    assert totals(store) == {("a", "en", "v1"): (5, 1116)}
    # One that is not whole is not read.
    store._put("totals/999999999999-half/batches.txt", "b0")
    assert totals(store) == {("a", "en", "v1"): (5, 1116)}


def _row(spark, n):
    return tr.signed(spark.createDataFrame([("a", "en", "v1", n)], SCHEMA), 1)


def test_a_reader_outlives_later_commits(spark):
    store = tr.RollupStore(spark, store_of(spark).path, fold_from=1)
    store.commit("b0", _row(spark, 1))
    held = store.totals()
    for k in range(1, 4):
        store.commit(f"b{k}", _row(spark, 10**k))
    assert [tuple(r) for r in held.collect()] == [("a", "en", "v1", 1, 1)]
    assert totals(store) == {("a", "en", "v1"): (4, 1111)}


def test_vacuum_keeps_totals_and_names(spark):
    store = tr.RollupStore(spark, store_of(spark).path, fold_from=2)
    for k in range(5):
        store.commit(f"b{k}", _row(spark, 10**k))
    assert store.vacuum() == 0 and len(store._names("totals")) == 2  # nothing is old enough
    assert store.vacuum(older_than_s=-60) > 0
    assert list(store._names("commits"))[0].startswith("b4~") and list(store._names("deltas")) == ["b4"] and len(store._names("totals")) == 1
    assert totals(store) == {("a", "en", "v1"): (5, 11111)} and store.batches() == [f"b{k}" for k in range(5)]
    assert not store.commit("b1", _row(spark, 7)) and not store.commit("b4", _row(spark, 7))
    assert store.commit("b5", _row(spark, 100000)) and totals(store) == {("a", "en", "v1"): (6, 111111)}


def test_listings_do_not_grow_with_batches(spark, monkeypatch):
    store = store_of(spark)
    store.commit("seed", _row(spark, 1))
    store.compact()
    name = store._latest()[0]
    fs, listed = store._at(f"totals/{name}/batches.txt")
    fs.delete(listed, False)
    store._put(f"totals/{name}/batches.txt", "\n".join(["seed", *(f"old{k:04d}" for k in range(1000))]))
    for k in range(1000):
        store._put(f"commits/old{k:04d}~x")
    seen = []
    names = tr.RollupStore._names
    monkeypatch.setattr(tr.RollupStore, "_names", lambda self, folder: seen.append(folder) or names(self, folder))
    assert store.commit("new", _row(spark, 2)) and len(seen) <= 2
    assert totals(store) == {("a", "en", "v1"): (2, 3)} and len(seen) <= 4
    assert not store.commit("old0500", _row(spark, 2))


def test_two_writers_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = store_of(spark).path
    stores = [tr.RollupStore(spark, path, fold_from=2) for _ in range(2)]
    jobs = [(stores[k % 2], f"b{k % 6}", 10 ** (k % 6)) for k in range(12)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda job: job[0].commit(job[1], _row(spark, job[2])), jobs))
    assert totals(stores[0]) == totals(stores[1]) == {("a", "en", "v1"): (6, 111111)}
