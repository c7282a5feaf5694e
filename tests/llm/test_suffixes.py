import hashlib
import random

import pytest

from tidewake.llm import suffixes


def brute_force(texts: list[bytes], length: int = suffixes.LENGTH) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans and kept_sha256 of each text by definition, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len([1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])])
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(45)
    out = [text(r.randint(1, 200)) for _ in range(30)]
    out += [text(20) + passage + text(r.randint(0, 50)) for _ in range(12)]
    out += [text(3) + other[:230] + text(9), text(5) + other[10:] + passage[:260]]
    out += [out[3], out[3], out[4][:-5], out[5][7:], "ab " * 400, "ab " * 90, passage + passage, None, "", "x" * 199, "x" * 200]
    return list(enumerate(out))


@pytest.mark.parametrize("batches", [1, 4, 5])
def test_against_brute_force(spark, batches):
    rows = corpus(batches)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), batches=batches).collect()}
    want = brute_force([(t or "").encode() for _, t in rows])
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True)}


def test_long_text_by_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "_CHUNK", 700)
    r = random.Random(3)
    text = bytes(r.choice(b"abcde ") for _ in range(5000))
    pieces = suffixes.segments([text])[0]
    monkeypatch.setattr(suffixes, "_CHUNK", 1 << 19)
    whole = suffixes.segments([text])[0]
    for a, b in zip(pieces, whole, strict=True):
        assert a.tolist() == b.tolist()


def test_null_ids_repeats_and_clashing_columns(spark):
    text = "".join(random.Random(5).choice("abcdef ") for _ in range(300))
    rows = [(None, text, "a"), (None, text, "b"), (7, text[:150], "c"), (7, None, "d")]
    out = suffixes.report(spark.createDataFrame(rows, "doc_id long, text string, rid string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out) == [(-1, 300, 300, 1), (-1, 300, 300, 1), (7, 0, 0, 0), (7, 150, 0, 0)]


def test_empty(spark):
    assert suffixes.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_grow_geometrically_and_are_kept(spark, tmp_path):
    r = random.Random(2)
    batches = [[(r.randrange(400),) for _ in range(n)] for n in (100, 100, 100, 300, 20, 20)]
    index = suffixes.LogIndex()
    for b in batches[:4]:
        index.add(spark.createDataFrame(b, "key long"))
    index.save(str(tmp_path / "index"))
    loaded = suffixes.LogIndex.load(spark, str(tmp_path / "index"))
    for i in (index, loaded):
        for b in batches[4:]:
            i.add(spark.createDataFrame(b, "key long"))
        sizes = [suffixes.measured(x)["rows"] for x in i.levels]
        assert sizes[0] == max(sizes) and len(sizes) <= 4
    every = [k for b in batches for (k,) in b]
    assert {x["key"] for x in index.repeated().collect()} == {k for k in every if every.count(k) > 1}
    late = {k for b in batches[4:] for (k,) in b}
    assert {x["key"] for x in loaded.repeated().collect()} == {k for k in late if every.count(k) > 1}


def test_text_ids_and_clashing_names(spark):
    text = "".join(random.Random(5).choice("abcdef ") for _ in range(300))
    out = suffixes.report(spark.createDataFrame([("a-1", text), ("b-2", text)], "doc_id string, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [("a-1", 300), ("b-2", 300)]
