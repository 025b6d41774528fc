import base64
import random

import pytest

from taskprep.llm import token_counts as T
from tests.llm.fixtures import corpus, corpus_rows


def encode(text):
    with open(T.VOCABULARY, "rb") as f:
        enc, _ = T.encoding(f.read())
    return [enc.decode_single_token_bytes(t) for t in enc.encode_ordinary(text)]


def brute(fields, lines, rule):
    """Tokens a section by walking over the bytes; sections as (field, text)."""
    sections = []
    for k, f in enumerate(fields):
        parts = f.split("\n") if lines else [f]
        if lines and len(parts) > 1 and parts[-1] == "":
            parts.pop()
            parts[-1] += "\n"
            pieces = [p + "\n" for p in parts[:-1]] + [parts[-1]]
        else:
            pieces = [p + "\n" for p in parts[:-1]] + [parts[-1]]
        if k < len(fields) - 1:
            pieces[-1] += "\n"
        sections += pieces
    owner = [i for i, s in enumerate(sections) for _ in s.encode()]
    counts, at = [0] * len(sections), 0
    for t in encode("\n".join(fields)):
        own = owner[at : at + len(t)]
        to = own[0] if rule == "start" else max(sorted(set(own)), key=own.count)
        counts[to] += 1
        at += len(t)
    assert at == len(owner)
    return counts


@pytest.mark.parametrize("rule", ["start", "most"])
@pytest.mark.parametrize("fields,lines", [(("text",), True), (("source", "text"), True), (("lang", "text"), False)])
def test_against_byte_walk(spark, rule, fields, lines):
    rows = corpus_rows()
    rng = random.Random(3)
    rows += [(2000 + i, "".join(rng.choice(["a", " ", "\n", "  ", "é", "字", "\n\n ", "!"]) for _ in range(60)), "x\n", "\n\n", 0) + (None,) * 11 for i in range(20)]
    got = {}
    for r in T.token_counts(corpus(spark, rows), fields=fields, lines=lines, rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    at = {"text": 1, "lang": 2, "source": 3}
    ids = [r[0] for r in rows]
    for r in rows:
        if ids.count(r[0]) > 1:
            continue
        want = brute([r[at[f]] or "" for f in fields], lines, rule)
        mine = sorted(got[r[0]], key=lambda x: x.section)
        assert [x.n_tokens for x in mine] == want, r
        assert sum(want) == mine[0].doc_tokens and mine[0].char_start == 0
        assert mine[-1].char_end == len("\n".join(r[at[f]] or "" for f in fields))
        assert all(a.char_end == b.char_start for a, b in zip(mine, mine[1:]))


def test_repeated_rows_and_empty_table(spark):
    rows = corpus_rows()
    n = T.token_counts(corpus(spark, rows), lines=False).count()
    assert n == len(rows)
    assert T.token_counts(corpus(spark, [])).count() == 0
    with pytest.raises(ValueError):
        T.token_counts(corpus(spark), rule="end")


def test_vocabulary_is_read_from_its_path(tmp_path, spark):
    ranks = "\n".join(f"{base64.b64encode(bytes([i])).decode()} {i}" for i in range(256))
    path = tmp_path / "bytes.ranks"
    path.write_text(ranks)
    got = T.token_counts(corpus(spark), lines=False, vocabulary=str(path)).collect()
    lens = sorted(len((r[1] or "").encode()) for r in corpus_rows())
    assert sorted(r.doc_tokens for r in got) == lens
