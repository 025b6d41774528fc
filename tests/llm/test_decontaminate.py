import hashlib
import random
import re

from pyspark.sql import functions as F

from taskprep.llm import decontaminate as D
from tests.llm.fixtures import ascii_lower, corpus, corpus_rows, prose, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(ascii_lower(t or ""))


def brute(rows, items):
    out = []
    for r in rows:
        w, hit, got = split(r[1]), set(), set()
        for iid, t in items:
            x = split(t)
            n = min(13, len(x))
            if not n:
                continue
            wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit.update(range(p, p + n))
                    if iid is not None:
                        got.add(str(iid))
        s = ",".join(sorted(got))
        out.append((r[0], len(w), len(hit), len(got), hashlib.sha256(s.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


def fixture(spark):
    rng = random.Random(9)
    rows = corpus_rows()
    long = prose(rng, 40)
    items = [(1, long), (2, "Three short words"), (3, " ".join(words(rng, 13))), (4, None), (5, ""), (None, prose(rng, 20)), (6, rows[2][1]), (6, long), (7, "ümlaut É1 two"), (8, "aa " * 14)]
    rows = rows + [(900 + k, prose(rng, 30) + " " + t + " " + prose(rng, 10), None, None, 0) + (None,) * 11 for k, t in enumerate(
        [long.upper(), " ".join(long.split()[7:25]), " ".join(long.split()[:12]), "THREE, short... words!", items[2][1], items[5][1], "ümlaut é1 two", "ümlaut É1 two", "aa " * 30])]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    return rows, items, bench


def test_against_brute_force(spark):
    rows, items, bench = fixture(spark)
    got = D.decontaminate(corpus(spark, rows), bench).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, items)


def test_empty_tables(spark):
    rows, _, bench = fixture(spark)
    assert D.decontaminate(corpus(spark, []), bench).count() == 0
    none = D.decontaminate(corpus(spark, rows), bench.limit(0))
    assert none.filter("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(rows)


def test_input_row_is_kept_whole(spark):
    rows, _, bench = fixture(spark)
    out = D.decontaminate(corpus(spark, rows), bench).select("row.*")
    assert out.columns == corpus(spark, rows).columns and out.filter(F.col("doc_id").isNull()).count() == 3
