"""What the tasks of the text operators hold and leave behind."""

import os
import re
import subprocess
import sys

import pyarrow as pa

from weekwise.llm._common import map_slices

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


class Tasks:
    """Stands for a DataFrame and keeps the function of a task."""

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def batches(count, held=None):
    for k in range(count):
        if held is not None:
            held.append(pa.total_allocated_bytes())
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array(["x" * (8 << 20)])], ["doc_id", "text"])


def test_one_batch_at_a_time():
    """A batch is gone before the next one is asked for."""
    held = []
    out = map_slices(Tasks(), lambda b: b.select([0]), "doc_id BIGINT").run(batches(4, held))
    assert sum(b.num_rows for b in out) == 4
    assert max(held) - held[0] < 1 << 20


KEPT = """
import re
import numpy as np, pyarrow as pa
from test_common import Tasks, batches
from weekwise.llm._common import map_slices

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

def work(batch):
    keep = [np.ones(1 << 12) for _ in range(3000)]  # many small arrays, 96 MB
    wall = np.ones(1 << 12)  # the end of the heap stays in use
    walls.append(wall)
    return pa.RecordBatch.from_arrays([pa.array([len(keep)])], ["n"])

walls, before = [], held()
for out in map_slices(Tasks(), work, "n BIGINT").run(batches(3)):
    pass
del out
print("kept", held() - before)
"""


def test_a_worker_keeps_no_unused_memory():
    env = os.environ | {"PYTHONPATH": os.pathsep.join([ROOT, os.path.dirname(os.path.abspath(__file__))])}
    out = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, env=env, timeout=120, check=True).stdout
    assert int(re.search(r"kept (-?\d+)", out)[1]) < 30
