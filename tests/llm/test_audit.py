"""The source audit against brute force, in whole numbers of Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import source_audit

from .fixtures import documents, texts


def rows(n=260):
    """Two full languages, one whose terms are too rare to keep, one of a single source; nulls, empties, ties and repeated rows."""
    rng = random.Random(3)
    pool = ["the", "Of", "ÜBER", "café", "x1y", "naïve-te", "日本語", "A", "b'c"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 4))) for _ in range(80)]
    out = []
    for k in range(n):
        lang, source = rng.choice(["en", "en", "de"]), f"s{min(rng.randrange(9), rng.randrange(9))}"
        favourite = pool[10 + 7 * int(source[1:]) : 18 + 7 * int(source[1:])]
        out.append((k, " ".join(rng.choice(pool if rng.random() < 0.7 else favourite) for _ in range(rng.randint(0, 60))), lang, source))
    out += [(1000 + k, "ceci est rare", "fr", f"s{k % 3}") for k in range(9)]
    out += [(1100 + k, "solo voz " * (k + 1), "es", "only") for k in range(12)]
    out += [(None, None, "en", "s0"), (2000, "", "en", None), (2001, "the the", None, "s1"), (2002, "12 34 --", "de", "numbers"), out[5], out[5]]
    return out + [(3000, "the of " * 30000, "en", "s2")]


def brute(given, least=10, top=10):
    f = lambda p, q: (p - q) ** 2 // (p + q)
    counts, held, out = defaultdict(Counter), defaultdict(Counter), []
    for _, text, lang, source in given:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        groups = {s: counts[g, s] for g, s in counts if g == lang}

        def p_of(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = p_of(sum(groups.values(), Counter()))
        ps = {s: p_of(c) for s, c in groups.items()}
        for s in groups:
            scored = {"pair": [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in groups if o != s]}
            scored["term"] = [(t, f(ps[s][t], q[t])) for t in kept if groups[s][t] > 0 and ps[s][t] > q[t]]
            for part, items in scored.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k + 1) for k, x in enumerate(ranked[: top if part == "term" else None])]
    return sorted(out)


def table(spark, given):
    return spark.createDataFrame([(t, i, g, s, "x", 1, 2) for i, t, g, s in given], "text string, doc_id long, lang string, source string, item string, value long, p int")


@pytest.mark.parametrize("small", [False, True])
def test_report_equals_brute_force(spark, monkeypatch, small):
    if small:  # other ways for many groups and pairs, and counts that leave a task in parts
        monkeypatch.setattr(source_audit, "GROUPS", 0)
        monkeypatch.setattr(source_audit, "PAIRS", 5)
        monkeypatch.setattr(source_audit, "HELD", 20)
    given = rows()
    got = source_audit.report(table(spark, given))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute(given)


def test_fixture_rows(spark):
    given = [(i, t, g, "src0") for i, t, g in texts()]
    assert sorted(map(tuple, source_audit.report(documents(spark)).collect())) == brute(given)


def test_large_counts_stay_exact(spark):
    """Counts whose product with 10^9 passes 64 bits."""
    sizes = [(2**40 + 3, 2**41, 77), (5, 9 * 10**12, 1000), (0, 10, 3)]
    df = spark.createDataFrame(sizes, "n long, total long, kept long")
    got = [r[0] for r in df.select(source_audit._p("n", "total", "kept")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in sizes]


def test_buckets_with_smaller_bounds_are_left_out(spark):
    """Of a group with many terms few are evaluated, and none that could be among the best is left out."""
    given = [(k, " ".join(f"w{chr(97 + a)}{chr(97 + b)}" * (1 + (a == k % 26) * 3) if k % 2 else f"w{chr(97 + a)}{chr(97 + b)}" for a, b in itertools.product(range(26), range(9))), "en", f"s{k % 2}") for k in range(60)]
    given += [(100 + k, "peak " * 50, "en", "s1") for k in range(12)]
    assert sorted(map(tuple, source_audit.report(table(spark, given)).collect())) == brute(given)


def test_empty_table(spark):
    assert source_audit.report(table(spark, rows()).limit(0)).count() == 0
