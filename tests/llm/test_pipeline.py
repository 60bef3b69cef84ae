"""The pipeline's stages on odd rows and empty tables."""

import os
import subprocess
import sys
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

DATA = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "Le chat est dans la maison et il ne sait pas que le chien est sur le chemin avec les enfants du village qui jouent au bord de la petite rivière pendant que des oiseaux chantent dans un arbre et que leur mère prépare un repas pour toute la famille avant la nuit qui tombe très vite en hiver par ici."


def rows():
    other = GOOD.replace("chat", "cheval").replace("chien", "mouton").replace("oiseaux", "enfants").replace("arbre", "jardin").replace("repas", "lit").replace("village", "bourg").replace("hiver", "mai").replace("maison", "cour")
    some = [(1, ""), (2, None), (None, GOOD), (5, GOOD), (5, GOOD), (5, other), (6, GOOD + " fin"), (None, other), (7, "\u00a0 \n"), (8, "w " * 20000)]
    return [(i, t, "fr", None, len(t or "")) for i, t in some]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), KIND).withColumn("_key", F.lit("clash")).withColumn("band", F.lit(1))


@pytest.mark.parametrize("name, stage", p.STAGES)
def test_empty(spark, odd, name, stage):
    out = stage(spark, odd.where("false"), DATA)
    assert out.count() == 0
    if stage is not p.encoded:
        assert out.columns == p.COLUMNS


def test_rules(spark, odd):
    got = Counter((r.doc_id, r.text) for r in p.rules(spark, odd, DATA).collect())
    assert got == Counter((i, t) for i, t, *_ in rows() if t and len(t.split()) > 50 and "w w" not in t)


def test_classifier(spark, odd):
    got = Counter((r.doc_id, r.text) for r in p.classifier(spark, odd, DATA).collect())
    assert not got - Counter((i, t) for i, t, *_ in rows())
    assert len({got[i, t] > 0 for i, t, *_ in rows() if t == GOOD}) == 1  # alike for like texts


def test_near_duplicates(spark, odd):
    got = Counter((r.doc_id, r.text) for r in p.near_duplicates(spark, odd, DATA).collect())
    other = next(t for i, t, *_ in rows() if i == 5 and t != GOOD)
    assert got == Counter([(1, ""), (2, None), (5, GOOD), (5, other), (7, "\u00a0 \n"), (8, "w " * 20000)])


def test_decontaminated(spark, odd):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    leak = spark.createDataFrame([(None, f"a {item} b", "en", "x", 0), (5, f"c {item}", "en", "x", 0)], KIND)
    got = Counter((r.doc_id, r.text) for r in p.decontaminated(spark, odd.select(*p.COLUMNS).union(leak), DATA).collect())
    assert got == Counter((i, t) for i, t, *_ in rows())


def test_encoded(spark, odd):
    out = p.encoded(spark, odd, DATA).collect()
    assert len(out) == len(rows()) and all(r.lossless for r in out) and sum(r.n_tokens == 0 for r in out) == 2


SMALL_HEAP = """
import sys
from pyspark.sql import SparkSession
import corpus_pipeline as p
folder = sys.argv[1]
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.local.dir", f"{folder}/local").getOrCreate()
p.rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).write.parquet(f"{folder}/out")
print("kept", spark.read.parquet(f"{folder}/out").count())
"""


def test_small_heap(tmp_path):
    """Four tasks read 3000 texts of 60 KB each in a heap of 1 GB: by default a reader would hold all of them at once."""
    (tmp_path / "documents.parquet").mkdir()
    for f in range(4):
        ids = [3000 * f + i for i in range(3000)]
        texts = [GOOD if i % 3000 == 0 else f"{i:08d}" + ("x" * 600 + " ") * 100 for i in ids]
        pq.write_table(pa.table({"doc_id": ids, "text": texts, "lang": ["fr"] * 3000, "source": ["a"] * 3000, "n_chars": [len(t) for t in texts]}), tmp_path / "documents.parquet" / f"{f}.parquet", use_dictionary=False, write_batch_size=64)
    env = os.environ | {"PYTHONPATH": os.path.dirname(p.__file__), "PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell"}
    ran = subprocess.run([sys.executable, "-c", SMALL_HEAP, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert "kept 4" in ran.stdout, ran.stderr[-2000:]
