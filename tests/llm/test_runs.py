"""Periodic runs against a brute-force search."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from ledgerloom.llm import periodic_runs, queries

from .fixtures import documents, texts


def brute(ws, least=12):
    """All runs by comparing every place with the one p later, for every p."""
    found = {}
    for p in range(1, len(ws) // 2 + 1):
        at = 0
        while at < len(ws) - p:
            end = at
            while end < len(ws) - p and ws[end] == ws[end + p]:
                end += 1
            if end + p - at >= max(least, 2 * p):
                found.setdefault((at, end + p), p)
            at = end + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapse(ws, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(ws) if i not in gone)


def awkward(rng):
    """Word lists with nested, overlapping, adjacent and shifted repetitions."""
    for k in range(120):
        ws = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            ws += (unit * 9)[: rng.randint(1, 8 * len(unit))]
            ws += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))]
        yield ws * rng.choice([1, 1, 2, 3]) if k % 2 else [rng.choice("ab") for _ in range(rng.randint(0, 90))]


def test_every_run_is_found():
    rng = random.Random(4)
    lists = [[w.encode() for w in ws] for ws in awkward(rng)] + [[], [b"x"] * 11, [b"x"] * 12, [b"x"] * 1000, [b"x", b"y"] * 300]
    a, b = b"a", b"ab"
    for _ in range(12):
        a, b = b, b + a  # words that repeat on all scales
    lists.append([bytes([c]) for c in b])
    for least in (12, 2):
        _, words, first, size = periodic_runs._numbered([b" ".join(ws) for ws in lists])
        got = periodic_runs.find(words, first, size, least)
        for k, ws in enumerate(lists):
            own = got[(got[:, 0] >= first[k]) & (got[:, 0] < first[k] + size[k])]
            assert [(int(s - first[k]), int(e - s), int(p)) for s, e, p in own] == brute(ws, least), ws


def test_small_pieces_find_the_same(monkeypatch):
    rng = random.Random(5)
    data = [b" ".join(w.encode() for w in ws) for ws in awkward(rng)]
    _, words, first, size = periodic_runs._numbered(data)
    whole = periodic_runs.find(words, first, size)
    monkeypatch.setattr(periodic_runs, "PROBES", 64)
    monkeypatch.setattr(periodic_runs, "CELLS", 32)
    assert (periodic_runs.find(words, first, size) == whole).all() and len(whole)


@pytest.mark.parametrize("unit", [["x"], ["a", "b", "c"], None])
def test_long_texts_take_seconds(unit):
    rng = random.Random(6)
    ws = unit * (300_000 // len(unit)) if unit else [rng.choice("ab") for _ in range(300_000)]
    began = time.time()
    _, words, first, size = periodic_runs._numbered([" ".join(ws).encode()])
    found = periodic_runs.find(words, first, size)
    assert time.time() - began < 60
    assert not unit or found.tolist() == [[0, len(ws), len(unit)]]


def planted(i, text):
    ws = [] if text is None else text.encode().split()
    h = None if i is None else zlib.crc32(str(i).encode())
    if ws and h is not None and h % 10 == 0:
        g, n = h // 10, len(ws)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[a + (j - a) % p] if j >= a else ws[j] for j in range(n)]
    return ws


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000], g) for i, t, g in texts()]
    rows += [(300 + k, " \n".join(ws), None) for k, ws in enumerate(awkward(random.Random(7)))]
    assert any(i is not None and t and zlib.crc32(str(i).encode()) % 10 == 0 for i, t, _ in rows)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for i, text, _ in rows:
        ws = planted(i, text)
        runs = brute(ws)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        wanted.append((i, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapse(ws, runs)).hexdigest()))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes][1:6] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_columns_stay_and_tables_may_be_empty(spark):
    docs = documents(spark, [(1, "a " * 20, "en"), (2, None, None)])
    got = {r.doc_id: r for r in periodic_runs.scan(docs, collapsed="keys").collect()}
    assert got[1].keys == "a" and got[1].hot == 2 and [tuple(x) for x in got[1].runs] == [(0, 20, 1)]
    assert got[2].keys == "" and got[2].runs == [] and got[2].text is None
    assert periodic_runs.digest(periodic_runs.scan(docs.limit(0))).count() == 0


def test_no_run_reaches_into_the_next_text():
    _, words, first, size = periodic_runs._numbered([b"x " * 8, b"x " * 8])
    assert len(periodic_runs.find(words, first, size)) == 0 and isinstance(words, np.ndarray)
