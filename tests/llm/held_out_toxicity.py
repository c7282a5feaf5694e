"""Figures of op2 on labels that it never learns from, without Spark: python tests/llm/held_out_toxicity.py [FOLDER [SEEDS]].

FOLDER (default /root/testdata/sf0.01) holds documents.parquet and labels.parquet. Prints one line per seed:
area under the ROC curve, toxic documents found of all, clean ones called toxic of all.
"""

import sys
import zlib

import numpy as np
import pyarrow.parquet as pq

from tidewake.llm import toxicity


def _crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def labelled(folder: str) -> tuple[list, list]:
    """(id, text, label) that may be learned from, at most SAMPLE of a class, and those held out."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    marks = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist()
    rows = sorted((r["doc_id"], texts[r["doc_id"]], r["toxic"]) for r in marks if r["doc_id"] in texts and r["toxic"] in (0, 1))
    learn = sorted((r for r in rows if _crc(r[0]) % 3 != 1), key=lambda r: _crc(-r[0]))
    return sorted(r for label in (0, 1) for r in [x for x in learn if x[2] == label][: toxicity.SAMPLE]), [r for r in rows if _crc(r[0]) % 3 == 1]


def figures(learn: list, held: list, seed: int) -> tuple[float, int, int, int, int]:
    """Area under the curve, toxic found, toxic, clean called toxic, clean."""
    net = toxicity.train([t for _, t, _ in learn], [x for *_, x in learn], seed=seed)
    score, y = toxicity.Scorer(net).scores([t for _, t, _ in held]), np.array([x for *_, x in held])
    above = (score[y == 1][:, None] > score[y == 0]).mean() + (score[y == 1][:, None] == score[y == 0]).mean() / 2
    called = score >= toxicity.THRESHOLD
    return float(above), int(called[y == 1].sum()), int((y == 1).sum()), int(called[y == 0].sum()), int((y == 0).sum())


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = labelled(folder)
    for seed in range(5, 5 + int(sys.argv[2] if len(sys.argv) > 2 else 5)):
        auc, found, toxic, false, clean = figures(*parts, seed)
        print(f"seed {seed}: AUC {auc:.3f}, {found} of {toxic} toxic found, {false} of {clean} clean called toxic", flush=True)
