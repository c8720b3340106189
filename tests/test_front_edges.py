"""Errors, the manifest, token counts by a vocabulary, listings of all files, and what is left behind."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline import catalog, commands, engine, errors, shared, tools
from plumbline.functions import counting
from plumbline.operators import graph
from plumbline.plans import contexts
from plumbline.sources import config
from plumbline.sources.tree import EVERY, listed

DATA = Path("/root/testdata/sf0.001")


def test_errors(spark, tmp_path):
    for text in ("a = [", "boundaries = 3", "[boundaries.x]\nname = 'x'", "[thresholds]\n= 1"):
        with pytest.raises(errors.ConfigError):
            config.parse(text)
    (tmp_path / "bad.toml").write_text("a = [")
    with pytest.warns(UserWarning, match="bad.toml"):
        assert config.load(tmp_path / "bad.toml") == config.Config()
    with pytest.raises(errors.ImpactError):
        engine.impact(spark.createDataFrame([("a.rs", "")], "path string, content string"), "b.rs")
    assert issubclass(errors.ImpactError, errors.PathNotFound) and all(issubclass(x, errors.PlumblineError) for x in (errors.PathNotFound, errors.ConfigError, errors.ReadError))
    with pytest.raises(errors.ReadError):
        commands._write(["x"], str(tmp_path / "none" / "out"))


def test_exit_code_of_what_is_missing(tmp_path, capsys):
    assert commands.main(["init", str(tmp_path / "none")]) == 2
    assert "not found" in capsys.readouterr().err


def test_manifest():
    found = tools.manifest()
    assert found["version"] and found["command"][-1] == "mcp" and [t["name"] for t in found["tools"]] == ["analyze", "ai", "impact"]
    json.dumps(found)
    assert commands.parser().parse_args(["mcp", "--manifest"]).manifest


def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = vocabulary()
    encoder = Tokenizer.from_file(path)
    texts = [None, "", " ", "fn main() {}", "é漢字 <|endoftext|>", "word " * 20_000, "x"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    got = {r.id: r.n for r in df.select("id", counting.counted(F.col("t"), path).alias("n")).collect()}
    encoder.encode_special_tokens = True
    assert got == {k: None if x is None else len(encoder.encode(x, add_special_tokens=False).ids) for k, x in enumerate(texts)}
    assert df.where("false").select(counting.counted(F.col("t"), path)).collect() == []
    odd = spark.sql("SELECT CAST(X'61FF' AS STRING) AS t")
    assert odd.select(counting.counted(F.col("t"), path)).first()[0] == len(encoder.encode("a\N{REPLACEMENT CHARACTER}", add_special_tokens=False).ids)


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_token_counts_of_documents(spark):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(vocabulary())
    encoder.encode_special_tokens = True
    texts = {r.path: r.content for r in catalog.fx.sources(spark, str(DATA)).collect()}
    rows = catalog.QUERIES["token_counts"](spark, str(DATA)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.path]
        assert (r.estimated, r.counted) == ((None, None) if text is None else (len(text.encode()) // 4, len(encoder.encode(text, add_special_tokens=False).ids)))


def test_budget_by_vocabulary(spark, tmp_path):
    (tmp_path / "a.rs").write_text("pub fn long_name_of_a_function(value: u64) -> u64 { value }\n" * 30)
    (tmp_path / "b.rs").write_text("fn b() {}\n")
    found = commands.Project(spark, tmp_path)
    made = contexts.Context(found.analysis(), found.root)
    by_words = "".join(contexts.budgeted(made, 2000, vocabulary()))
    assert "long_name_of_a_function" in by_words and "a.rs" in "".join(contexts.budgeted(made, 801, vocabulary()))


def test_listing_of_all_files(tmp_path):
    for name in ("a.rs", "notes.txt", "plain", ".hidden", "sub/x.toml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda kinds: [os.path.relpath(x, tmp_path) for x in listed(str(tmp_path), kinds)]
    assert names(EVERY) == ["a.rs", "notes.txt", "plain", "sub/x.toml"] and names("") == ["a.rs"]


def test_no_table_stays_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    found = graph.impact(edges, spark.createDataFrame([("c",)], "path string"))
    assert {(r.path, r.depth) for r in found.collect()} == {("b", 1), ("a", 2)}
    assert {t.name for t in spark.catalog.listTables()} == before
    assert not [p for p in _folders(spark) if p.startswith("back-")]


def _folders(spark):
    root = spark._jvm.org.apache.hadoop.fs.Path(shared._root(spark))
    return [f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
