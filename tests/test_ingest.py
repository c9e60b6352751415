import pytest

from tabsight.sources import catalog, ingest, inspect


def test_csv_na_tokens_and_inference(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b,c,d,e\n1,1.5,True,2024-01-02,x\nNA,,False,null,y\n3,n/a,true,2024-01-03,None\n")
    df = ingest.read_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string"}
    rows = {r["e"]: r for r in df.collect()}
    assert rows["x"]["a"] == 1 and rows["y"]["a"] is None and rows["y"]["b"] is None
    assert rows[None]["a"] == 3 and rows[None]["b"] is None


def test_frozen_schema_roundtrips(spark):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, None)], "k long, v double, s string")
    back = ingest.read_csv(spark, ingest.write_csv(df, ingest.scratch_path(spark, "t")), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    js = ingest.read_json(spark, ingest.write_json(df, ingest.scratch_path(spark, "j")), df.schema)
    assert sorted(js.collect()) == sorted(df.collect())


def test_catalog_never_overwrites(spark):
    a = spark.createDataFrame([(1,)], "x long")
    b = spark.createDataFrame([(2,), (3,)], "x long")
    catalog.drop_dataset(spark, "t1")
    catalog.save_dataset(a, "t1")
    with pytest.raises(FileExistsError):
        catalog.save_dataset(b, "t1")
    assert catalog.save_dataset(b, "t1", if_exists="ignore").count() == 1
    assert "t1" in [r["key"] for r in catalog.list_datasets(spark).collect()]
    assert catalog.drop_dataset(spark, "t1") is True
    assert catalog.drop_dataset(spark, "t1") is False


def test_validate_rejects_empty(spark):
    with pytest.raises(inspect.EmptyDatasetError):
        inspect.validate(spark.createDataFrame([], "x double"))
    v = inspect.validate(spark.createDataFrame([(1.0, "ab")], "x double, s string")).first()
    assert v["data_bytes"] == 8 + 2 and v["dtypes"] == "x:double,s:string"


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('id,s\n1,"he said ""hi"", ok"\n2,"line1\nline2"\n3,plain\n')
    got = {r["id"]: r["s"] for r in ingest.read_csv(spark, str(p), multi_line=True).collect()}
    assert got == {1: 'he said "hi", ok', 2: "line1\nline2", 3: "plain"}
    with pytest.raises(ingest.UnbalancedQuote):
        ingest.read_csv(spark, str(p))
    df = spark.createDataFrame([(1, 'a "b" \\ c'), (2, "x\ny"), (3, ",")], "id long, s string")
    back = ingest.read_csv(spark, ingest.write_csv(df, ingest.scratch_path(spark, "q")), df.schema, multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_codes_are_not_numbers(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("seat,x,y\n12F,1e3,inf\n14D,.5,-2.\n9F,+7,3\n")
    assert dict(ingest.read_csv(spark, str(p)).dtypes) == {"seat": "string", "x": "double", "y": "double"}


def test_datasets_are_listed_and_kept_out_of_the_checkpoint_folder(spark):
    from tabsight.session import checkpoint_dir
    catalog.drop_dataset(spark, "t2")
    catalog.save_dataset(spark.range(3), "t2")
    keys = {r["key"]: r["is_temporary"] for r in catalog.list_datasets(spark).collect()}
    assert keys["t2"] is False
    place = spark.sql("describe extended ds_t2").where("col_name = 'Location'").first()["data_type"]
    assert checkpoint_dir(spark).split(":")[-1] not in place
    catalog.drop_dataset(spark, "t2")


def test_checkpoint_folder_of_the_session_is_kept(spark):
    from tabsight.session import checkpoint_dir
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir() == checkpoint_dir(spark)


def test_keys_that_look_alike_are_different_datasets(spark):
    keys = ["a-b", "a_b", "A_b", "a b", "it's \\ \"x\"", "ü", "a/b"]
    for n, k in enumerate(keys, 1):
        catalog.drop_dataset(spark, k)
        assert catalog.save_dataset(spark.range(n), k, if_exists="ignore").count() == n
    spark.range(1).write.mode("overwrite").saveAsTable("not_a_dataset")
    spark.range(1).createOrReplaceTempView("ds_view")
    listed = [r["key"] for r in catalog.list_datasets(spark).collect()]
    assert set(keys) <= set(listed) and len(listed) == len(set(listed)) and not {"not_a_dataset", "view"} & set(listed)
    assert [catalog.load_dataset(spark, k).count() for k in keys] == list(range(1, len(keys) + 1))
    assert all(catalog.drop_dataset(spark, k) for k in keys)
    assert not set(keys) & {r["key"] for r in catalog.list_datasets(spark).collect()}
    spark.sql("DROP TABLE not_a_dataset")
    spark.catalog.dropTempView("ds_view")
