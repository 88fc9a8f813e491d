"""What Python workers keep when a kernel is done, and which queries start none."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark import SparkContext

from impulsar.llm.mixing import mix

from .tables import documents, frame

_CODE = r"""
import ctypes, gc, re
import numpy as np, pyarrow as pa
from impulsar.llm import ngram_jaccard, secret_scan, toxicity
from impulsar.llm.words import KEPT

def held():
    gc.collect()
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Task:
    get = staticmethod(lambda: Task)
    partitionId = staticmethod(lambda: 0)

ngram_jaccard.TaskContext = Task
words = np.array([f"w{i}" for i in range(50_000)])
rng = np.random.default_rng(1)
batch = pa.RecordBatch.from_pydict({"doc_id": range(4000), "text": [" ".join(words[rng.integers(0, len(words), 1000)]) for _ in range(4000)]})
given = pa.RecordBatch.from_arrays([batch.column("text")], names=["__text"])
model = toxicity.lexicon([], (0, 0))
KEPT["model",] = model
for kernel in (
    lambda: list(map(len, ngram_jaccard._post(5, 8, 64, 2_000_000, "doc_id", "text")(iter([batch])))),
    lambda: list(map(len, secret_scan._scan("x")(iter([given])))),
    lambda: [len(x) for x in toxicity._by_slices(model.score, batch.column("text"))],
):
    gc.collect()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    before = held()
    kernel()
    print(held() - before)
print(len(KEPT))
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="no memory map to read")
def test_kernels_keep_little():
    out = subprocess.run([sys.executable, "-c", _CODE], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout
    *grown, kept = map(float, out.split())
    assert len(grown) == 3 and max(grown) < 30 and kept == 0, out


def test_mixing_starts_no_python(spark, monkeypatch):
    docs = frame(spark, documents()).localCheckpoint()

    def never(*_, **__):
        raise AssertionError("an RDD of Python rows")

    monkeypatch.setattr(SparkContext, "parallelize", never)
    assert mix(docs).count() == docs.count() > 0
