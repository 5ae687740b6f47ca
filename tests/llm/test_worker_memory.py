"""What a Python worker keeps between tasks: it lives on from stage to stage beside the executor's heap."""

import ctypes
import pickle
import random
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from seqdrift.llm import packing
from seqdrift.llm.queries import tokenizer_path


def words(n, seed):
    draw = random.Random(seed)
    known = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(40_000)]
    return [" ".join(draw.choices(known, k=300)) for _ in range(n)]


def private() -> int:
    """MB of this process that no file backs."""
    found = re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
    return int(found[0]) // 1024


def free_but_held() -> int:
    """MB that this process gives back when asked to, after tasks of three stages."""
    from seqdrift.llm import decontaminate, neardup

    windows = decontaminate.windows_of([(str(i), t) for i, t in enumerate(words(5, 1))], 10)
    steps = (neardup._signatures(5, 3, 32), decontaminate._without(windows), packing._tokenize(tokenizer_path(), 1024, False))
    for step in steps:
        texts = words(6000, 2)
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
        assert sum(b.num_rows for b in step(iter([batch]))) == len(texts)
        del texts, batch
    before = private()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    return before - private()


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_freed_memory_back_after_its_task():
    code = "import sys; sys.path.insert(0, sys.argv[1]); from tests.llm.test_worker_memory import free_but_held; print(free_but_held())"
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, timeout=300, cwd=root, check=True)
    assert int(out.stdout.split()[-1]) < 30


def test_a_worker_loads_the_tokenizer_once(tmp_path, monkeypatch):
    path = str(tmp_path / "tokenizer.json")
    shutil.copy(tokenizer_path(), path)
    calls, ranked = [], packing.ranked
    monkeypatch.setattr(packing, "ranked", lambda p: calls.append(p) or ranked(p))
    sent = cloudpickle.dumps(packing._tokenize(path, 1024, False))
    batch = pa.RecordBatch.from_pydict({"doc_id": ["a", "b"], "text": ["some words", None]})
    first, second = [pa.Table.from_batches(pickle.loads(sent)(iter([batch]))) for _ in range(2)]  # noqa: S301
    assert first.equals(second) and first["doc_tokens"].to_pylist() == [3, 1]
    assert calls == [path]
