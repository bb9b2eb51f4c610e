"""The pipeline's stages and the registry on odd rows and without their libraries."""

import subprocess
import sys

import corpus_pipeline
import pytest

from conftest import DATA, ROOT

SF = str(DATA / "sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _found string, component_id long"


@pytest.fixture(scope="module")
def odd(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").limit(4).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "mine", 9) for r in good]
    more = [(900, None, None, None, None, None, None), (901, "", "en", "s", 0, "mine", 9), (None, "a text without a number of its own", "en", "s", 34, "mine", 9), rows[0], (902, "word " * 60_000, "en", "s", 300_000, "mine", 9)]
    return spark.createDataFrame(rows + more, SCHEMA)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows_and_on_none(spark, odd, name, stage):
    for docs in (odd, odd.limit(0)):
        got = stage(spark, docs, SF)
        if name == "packing":
            assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        else:
            assert got.columns == docs.columns and got.exceptAll(docs).count() == 0
            if name == "secrets":
                assert got.count() == docs.count()


def test_entry_imports_without_a_library_of_the_corpus_part():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 150 and int(out[1]) > 130 and out[2] == "False"
