"""What a worker that encodes holds beside its batch: two of them stand beside an executor's heap."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
GROWTH = """
import random, resource
import pyarrow as pa
import public_tokenizers
from brinewell.llm.tokenfiles import Encoder

rng, letters = random.Random(5), "абвгдежзиклмнопр"  # encoded whole
words = ["".join(rng.choices(letters, k=7)) for _ in range(20_000)]
texts = pa.array([" ".join(rng.choices(words, k=400)) for _ in range(2_000)])
encoder = Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert sum(len(counts) for _, counts in encoder.encode(texts)) == len(texts)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_texts_encoded_whole_take_little_memory():
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    run = subprocess.run([sys.executable, "-c", GROWTH], env=env, capture_output=True, text=True, check=True)
    assert int(run.stdout) < 40  # MB
