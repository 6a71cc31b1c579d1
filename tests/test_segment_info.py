"""Segment statistics: grams leave a block packed by part, never as rows that are joined."""

import pytest

from pairlab.operators import scores as S
from pairlab.operators import vectors as V

ROWS = [(1, -1, "a b c a"), (1, 0, "a b a"), (1, 1, "c a b"), (2, -1, "a b"), (2, 0, ""), (None, -1, "b c"), (None, 0, "b c d"),
        (4, -1, "a b"), (4, -1, "a"), (4, 0, "a b c")]


def test_no_gram_is_a_row_of_a_table_or_join(spark, monkeypatch):
    def never(*_):
        raise AssertionError("grams written to a table")

    monkeypatch.setattr(S.Stats, "table", never)
    st = S.Stats(None, None, 3, "perl", texts=spark.createDataFrame(ROWS, "inst_id long, ref_no int, text string"))
    got = {(r.inst_id, r.n): r for r in S.perl_segment_stats(st).collect()}
    assert len(got) == 12
    # words: a 4, b 4, c 3, d 1 of 12 in the references; equal keys of a system's output are summed
    assert got[4, 1].match == 3 and got[4, 1].tst_count == 3
    assert got[None, 1].tst_info == pytest.approx(1.584963 + 2)
    assert got[2, 1].tst_info == 0 and got[2, 1].match == 0
    # "b c" stands twice behind b (4), "b c d" once
    assert got[None, 2].tst_info == pytest.approx(1.0) and got[None, 2].ref_info == pytest.approx(1 + 1.584963)


def test_parts_do_not_change_the_sums(spark, monkeypatch):
    texts = spark.createDataFrame(ROWS, "inst_id long, ref_no int, text string")
    told = []
    for bits in (1, 10):
        monkeypatch.setattr(V, "INFO_BITS", bits)
        rows = V.segment_info(V.by_instance(texts, "perl", 3), 3).collect()
        told.append({r.inst_id: [round(x, 9) for x in r.info] for r in rows})
    assert told[0] == told[1] and len(told[0]) == 4


def test_grams_that_begin_at_a_token_travel_together(spark, monkeypatch):
    """A row a token of a reference and a row where a hit begins, whatever the number of orders (a row a gram before)."""
    texts = spark.createDataFrame([(i, no, " ".join(f"w{(i * 31 + k * k) % 97}" for k in range(40 - 3 * no))) for i in range(6) for no in (-1, 0, 1)],
                                  "inst_id long, ref_no int, text string")
    rows = V.by_instance(texts, "perl", 9)
    told = V.frequent_tokens(rows)
    assert told[3] == 6 * (40 + 37) and [x.tolist() for x in told[:3]] == [x.tolist() for x in V.frequent_tokens(rows, texts)[:3]]
    sizes = []
    for max_n in (3, 9):
        cells = V._cells(rows, max_n, spark.sparkContext.broadcast(told), True).collect()
        sizes.append(sum(c.size for c in cells))
        assert len({(c.id, c.block) for c in cells}) == len(cells)
    assert max(sizes) <= 6 * (40 + 37 + 43)
    plain = {n: V.corpus_info(rows, n).orderBy("n").collect() for n in (2, 5)}
    assert all(abs(a.ref_info - b.ref_info) < 1e-9 and abs(a.tst_info - b.tst_info) < 1e-9 for a, b in zip(plain[2], plain[5]))
