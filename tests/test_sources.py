"""Readers and writers on small files."""

import pytest

from tessera.sources import readers, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fasta", ">id1 some text > more\nACDE\nFGH\n\n>id2\r\nKLM\r\n>id3\n")
    got = [tuple(r) for r in readers.read_fasta(spark, p, description=True).collect()]
    assert got == [("id1", "ACDEFGH", "id1 some text > more"), ("id2", "KLM", "id2"), ("id3", "", "id3")]
    assert readers.read_fasta(spark, p, whole_header=True).first().id == "id1 some text > more"


def test_broken_headers(spark, tmp_path):
    p = put(tmp_path / "n.fasta", ">tox1 long\n header, part\nACDE\nFG\n>tox2\nKLM\n")
    assert [tuple(r) for r in readers.read_fasta_broken_headers(spark, p).collect()] == [("tox1", "tox1 long header, part", "ACDEFG"), ("tox2", "tox2", "KLM")]


def test_pdb(spark, tmp_path):
    line = "ATOM  {:5d}  {:<3s} {:3s} {:1s}{:4d}    {:8.3f}{:8.3f}{:8.3f}"
    text = "\n".join([line.format(1, "N", "ALA", "B", 1, 0, 0, 0), line.format(2, "CA", "ALA", "B", 1, 0, 0, 0), line.format(3, "N", "GLY", "B", 2, 0, 0, 0), line.format(4, "N", "MSE", "B", 3, 0, 0, 0), line.format(5, "N", "LYS", " ", 1, 0, 0, 0), "HETATM    6  O   HOH B   9"])
    p = put(tmp_path / "x_1.pdb", text)
    assert sorted((r.chain, r.sequence) for r in readers.read_pdb(spark, p).collect()) == [("A", "K"), ("B", "AG")]
    assert sorted(r.sequence for r in readers.read_pdb(spark, p, standard_only=False).collect()) == ["AGX", "K"]
    files = spark.createDataFrame([(p,)], "path string")
    assert [tuple(r) for r in readers.file_membership(files, spark.createDataFrame([("x|1",)], "id string")).collect()] == [("x|1", True)]


def test_status_files(spark, tmp_path):
    put(tmp_path / "toxic/positive.csv", "sequence,srcA,srcB,counts_1,counts_0,positive,negative,only_unlabel,percentage_1\n acdef ,1,999,1,0,True,False,False,100\nACDEX,1,1,2,0,True,False,False,100\n")
    put(tmp_path / "cytolytic/only_unlabel.csv", "sequence,srcC,note\nGHIKL,2,x\n")
    long, rows, sources = readers.collect_inputs(spark, str(tmp_path))
    assert {tuple(sorted(v)) for v in sources.values()} == {("srcA", "srcB"), ("srcC",)}
    assert sorted((r.sequence, r.endpoint, r.source, r.label) for r in long.collect()) == [("ACDEF", "toxic", "srcA", 1), ("GHIKL", "cytolysis", "srcC", 2)]
    assert sorted((r.sequence, r.row_status, r.input_endpoint_folder) for r in rows.collect()) == [("ACDEF", "positive", "toxic"), ("GHIKL", "unlabeled", "cytolytic")]
    with pytest.raises(FileNotFoundError):
        readers.collect_inputs(spark, str(tmp_path / "none"))


def test_folders_and_inventory(spark, tmp_path):
    put(tmp_path / "one/two/a.csv", "sequence\nAC\n")
    assert [tuple(r) for r in readers.read_folders(spark, str(tmp_path), "t").collect()] == [("AC", "one", "two", "t")]
    assert readers.read_same_named(spark, str(tmp_path), "a.csv").count() == 1
    put(tmp_path / "s/toxic/random_kfold/seed_7/fold_2/train.csv", "id\n1\n")
    assert [tuple(r) for r in readers.split_inventory(spark, str(tmp_path / "s")).collect()] == [("toxic", "random_kfold", 7, 2)]


def test_gated_loading(spark, tmp_path):
    p = put(tmp_path / "p.csv", "sequence\nAC\n")
    assert readers.load_if_nonempty(spark, {"k": 0}, "k", p) is None and readers.load_if_nonempty(spark, {}, "k", p) is None
    for entry in (3, {"n_sequences": 1}, {"a": 0, "b": 2}):
        assert readers.load_if_nonempty(spark, {"k": entry}, "k", p).count() == 1
    assert readers.load_if_nonempty(spark, {"k": {"n_sequences": 0, "x": 5}}, "k", p) is None


def test_tables_and_metadata(spark, tmp_path):
    t = put(tmp_path / "m.tsv", "name source\ttask\nDb One\ta\ndb two\tb\n")
    assert readers.read_metadata(spark, t, "Db One").count() == 1 and readers.read_metadata(spark, t, "DB", exact=False, columns=["task"]).columns == ["task"]
    put(tmp_path / "j/a/metadata.json", '{"x": 1}')
    put(tmp_path / "j/b/metadata.json", "{broken")
    assert sorted((r.folder, r.valid) for r in readers.read_json_metadata(spark, str(tmp_path / "j")).collect()) == [("a", True), ("b", False)]
    put(tmp_path / "q/db/processed_HC50_dataset.csv", "sequence,source,label,unit\nAC,s,5,uM\n")
    assert [(r.measurement_type, r.source_dataset) for r in readers.read_measurements(spark, str(tmp_path / "q")).collect()] == [("HC50", "db")]
    skip = put(tmp_path / "skip.csv", "junk line\na,b\n1,2\n")
    assert [tuple(r) for r in readers.read_csv(spark, skip, skip_rows=1).collect()] == [("1", "2")]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xls")


def test_rows_side_by_side_and_features(spark):
    a, b = spark.createDataFrame([(i,) for i in range(10)], "x long"), spark.createDataFrame([(i * i,) for i in range(10)], "p_0 long")
    z = readers.zip_rows(a.repartition(3).sortWithinPartitions("x").orderBy("x"), b.orderBy("p_0"))
    assert sorted(map(tuple, z.collect())) == [(i, i * i) for i in range(10)]
    assert readers.feature_columns(spark.createDataFrame([(1, 2, 3)], "p_10 int, p_2 int, label int")) == ["p_2", "p_10"]
    with pytest.raises(ValueError):
        readers.zip_rows(a, b.limit(3))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b\"c"), (2, None)], "id int, t string")
    sinks.write_tsv(df, f"{tmp_path}/t")
    sinks.write_csv(df, f"{tmp_path}/c")
    assert readers.read_csv(spark, f"{tmp_path}/c").where("id = 1").first().t == 'a,b"c'
    sinks.write_document(spark, {"k": [1]}, f"{tmp_path}/d")
    assert spark.read.text(f"{tmp_path}/d").first()[0] == '{"k": [1]}'
    meta = sinks.output_metadata(spark, "c", df, f"{tmp_path}/c")
    assert meta["rows"] == 2 and len(meta["sha256"]) == 64 and meta["bytes"] > 0
    v = spark.createDataFrame([(2, [1.0, 2.0]), (1, [3.0, 4.0])], "id int, v array<double>")
    ids, m = sinks.to_numpy(v, "id", "v")
    assert ids.tolist() == [1, 2] and m.tolist() == [[3.0, 4.0], [1.0, 2.0]]
    with pytest.raises(ValueError):
        sinks.to_numpy(v, "id", "v", most=1)
