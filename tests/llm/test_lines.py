"""Line dedup against brute force over every run of three lines."""

from __future__ import annotations

import random

from tally.llm import lines


def _removed(docs, min_run=3):
    """Places that go, by id; ids stand in order and no two documents are equal."""
    seen, gone = set(), {}
    for doc, text in docs:
        all_ = text.split("\n")
        runs = [tuple(all_[i : i + min_run]) for i in range(len(all_) - min_run + 1)]
        gone[doc] = set()
        for i, run in enumerate(runs):
            if run in seen:
                gone[doc] |= set(range(i, i + min_run))
            seen.add(run)
    return gone


def _held(spark, docs):
    gone = _removed(docs)
    got = {r["doc_id"]: r for r in lines.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for doc, text in docs:
        assert got[doc]["kept_text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[doc]), doc
        assert got[doc]["n_removed"] == len(gone[doc])


def test_a_shared_header_hides_no_run(spark):
    """Each pair of lines first stands before another third line; whichever pair a method picks, some of these hide a run."""
    docs = []
    for k in range(12):
        x, y, z = f"x{k}", f"y{k}", f"z{k}"
        docs += [f"{x}\n{y}\np{k}", f"q{k}\n{y}\n{z}", f"{x}\n{y}\n{z}", f"{x}\n{y}\n{z}\nend {k}"]
    _held(spark, list(enumerate(docs)))


def test_runs_equal_brute_force(spark):
    rng = random.Random(4)
    _held(spark, [(k, "\n".join([f"only {k}", *(rng.choice("abcde") for _ in range(rng.randrange(1, 40)))])) for k in range(60)])


def test_whole_documents_of_few_lines(spark):
    docs = [(1, "a"), (2, " A "), (3, "a\nb"), (4, "a\n\nb"), (5, "b"), (6, "a\nb\nc"), (7, "a\nb"), (8, "z"), (8, "z"), (9, ""), (10, "")]
    rows = lines.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 0), (2, 1), (3, 0), (4, 2), (5, 0), (6, 0), (7, 2), (8, 0), (8, 1), (9, 0), (10, 0)]


def test_long_and_repeated(spark):
    """Many equal lines in one text, and rows that repeat: the first occurrence stays."""
    docs = [(1, "\n".join(["a"] * 40_000)), (2, "x\ny\nz"), (2, "x\ny\nz"), (2, "x\ny\nz"), (None, "x\ny\nz"), (3, None), (3, None)]
    rows = lines.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 9, r["n_removed"], len(r["kept_text"])) for r in rows) == [(1, 39_999, 1), (2, 0, 5), (2, 3, 0), (2, 3, 0), (3, 0, 0), (3, 0, 0), (9, 3, 0)]
