import hashlib
import random

import pytest
from pyspark.sql import functions as F

from taskprep.llm import merkle
from tests.llm.fixtures import SCHEMA, corpus, corpus_rows


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append([h("".join(x[i : i + fan])) for i in range(0, len(x), fan)])
    return out


def steps(levels, i, fan):
    out = []
    for x in levels[:-1]:
        at, own = i // fan * fan, i % fan
        out.append((own, "".join(x[at : at + own]), "".join(x[at + own + 1 : at + fan])))
        i //= fan
    return out


def brute(rows, fan=2, forged=lambda r: False):
    """(doc_id, leaf, subroot, root, siblings, folded_root) of rows (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, more: h("".join(map(framed, (r[0], r[3], r[2], r[4] if r[4] is None else r[4] + more, r[1]))))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r[0] is not None, r[0] or 0, leaf(r, 0), leaf(r, 1) if forged(r) else leaf(r, 0)) for r in rows if r[2] == lang)
        trees[lang] = own, levels_of([x[2] for x in own], fan)
    top = levels_of([trees[x][1][-1][0] for x in langs], fan)
    out = []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, (there, doc, leaf_, claimed) in enumerate(own):
            path, node = steps(levels, i, fan) + steps(top, k, fan), claimed
            for _, left, right in path:
                node = h(left + node + right)
            out.append((doc if there else None, leaf_, levels[-1][0], top[-1][0], h("".join(a + b for _, a, b in path)), node))
    return sorted(out, key=str)


def result(frame):
    rows = frame.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256), "folded_root", "verified").collect()
    assert all(r.verified == (r.folded_root == r.root) for r in rows)
    return sorted((tuple(r)[:6] for r in rows), key=str)


def forge(frame):
    return {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


@pytest.mark.parametrize("fan, slots", [(2, 1024), (2, 4), (3, 9), (5, 5)])
def test_odd_rows(spark, fan, slots):
    rows = corpus_rows() + [corpus_rows()[2]] * 11  # eleven equal rows over several slot arrays
    frame = corpus(spark, rows)
    got = result(merkle.merkle_manifest(frame, fan=fan, slots=slots, claimed=forge(frame)))
    assert got == brute([r[:5] for r in rows], fan, lambda r: r[0] is not None and r[0] % 3 == 0 and r[4] is not None)


def test_sparse_negative_and_missing_ids(spark):
    rng = random.Random(4)
    ids = [rng.randint(-(2**63), 2**63 - 1) for _ in range(150)] + [-(2**63), 2**63 - 1, 0, -1] + list(range(-70, 70, 3)) + [None] * 40 + [63] * 25
    rows = [(i, f"t{k % 31}", rng.choice(["en", "é", "z", None, ""]), "s", k) for k, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert result(merkle.merkle_manifest(frame, slots=8)) == brute(rows)


def test_directory_levels(spark):
    rng = random.Random(5)
    keys = sorted(rng.sample(range(-500, 500), 200))
    got = merkle.counts_before(spark.createDataFrame([("g", k, 1 + k % 3) for k in keys], "g string, k long, c long"), ["g"], (2, 3)).collect()
    assert {r.k: r.base for r in got} == {k: sum(1 + x % 3 for x in keys if x < k) for k in keys}


def test_a_changed_byte_anywhere_fails(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for claimed in ({"text": F.concat(F.col("text"), F.lit("."))}, {"source": F.lit(None).cast("string")}):
        assert merkle.merkle_manifest(frame, claimed=claimed).filter("verified").count() == 0
    assert merkle.merkle_manifest(frame).filter("verified").count() == 40


def test_one_row_and_empty_table(spark):
    one = spark.createDataFrame([(7, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = merkle.merkle_manifest(one).collect()
    assert (r.leaf, r.leaf, r.leaf, True) == (r.subroot, r.root, r.folded_root, r.verified) and r.siblings == []
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
