import random
import re
from collections import Counter
from zlib import crc32

from flowmatch.llm import spelling
from flowmatch.llm.queries import QUERIES
from flowmatch.sources.tables import table

SF = "/root/testdata/sf0.01"


def near(a, b):
    """Exactly one inserted, deleted or replaced letter, by trying all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, thinned=31, min_count=2):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % thinned == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            if len(low) >= 7:
                counts[low] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}
    sides = {}
    for w in counts:  # words that can be near share the first or the last three letters, or differ by one letter only
        for key in {("a", w[:3]), ("z", w[-3:])}:
            sides.setdefault(key, []).append(w)
    out, forms = {}, {}
    for w, n in counts.items():
        found = {v for key in (("a", w[:3]), ("z", w[-3:])) for v in sides[key] if abs(len(v) - len(w)) < 2 and near(w, v)}
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 10 * n else None
        out[w] = [n, len(found)]
    result = []
    for w, (n, n_near) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        result.append((w, forms[w], root, n, n_near, counts[forms[w]] if forms[w] else None))
    return sorted(result, key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_all_words_as_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    expected = brute(rows)
    assert any(r[1] for r in expected)
    assert as_rows(QUERIES["op11_spelling_variants"](spark, SF)) == expected


def test_chains_ties_and_repeated_letters(spark):
    rnd = random.Random(4)
    text = ["colourful"] * 4000 + ["colorful"] * 300 + ["colorfull"] * 25 + ["colorffull"] * 2 + ["aaaaaaaa"] * 3 + ["aaaaaaa"] * 40
    text += ["Straßen", "strasen", "STRAßEN", "straßex", "straßey"] * 3 + ["aaaabaaa"] * 2 + ["aaaacaaa"] * 2
    text += ["".join(rnd.choice("ab") for _ in range(rnd.randrange(7, 10))) for _ in range(900)]
    rnd.shuffle(text)
    rows = [(i, " ".join(text[i::7])) for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = as_rows(spelling.variant_groups(docs, thinned=10 ** 9))
    assert found == brute(rows, thinned=10 ** 9)
    root = {r[0]: r[2] for r in found}
    assert root["colorffull"] == "colourful"  # by three forms


def test_edges(spark):
    long = "q" * 70_000
    rows = [(1, None), (2, ""), (None, "Wording wording 'wording"), (3, f"{long} {long} x{long}"), (3, f"{long} {long} x{long}"), (4, "short 1234567 "), (5, "ÀÉÎÕÜ×÷ÿ ÀÉÎÕÜ×÷ÿ")]
    docs = spark.createDataFrame([(d, t, "w", 5, 6) for d, t in rows], "doc_id long, text string, word string, n int, word_id int")
    got = as_rows(spelling.variant_groups(docs, thinned=10 ** 9))
    assert got == sorted([("wording", None, "wording", 3, 0, None), (long, None, long, 4, 1, None), ("x" + long, None, "x" + long, 2, 1, None),
                          ("ÀÉÎÕÜ×÷ÿ", None, "ÀÉÎÕÜ×÷ÿ", 2, 0, None)], key=str)
    empty = spelling.variant_groups(docs.where("doc_id = -1"))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_null_and_thinned_runs_as_brute_force(spark):
    rnd = random.Random(9)
    words = ["measure", "measures", "measured", "treasure", "pleasure", "leisurely", "éclairs"]
    rows = [(None if i % 9 == 0 else i, " ".join(rnd.choice(words) for _ in range(60))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(spelling.variant_groups(docs, thinned=3)) == brute(rows, thinned=3)
